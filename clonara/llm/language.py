"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the three- and four-byte pieces of the lower-cased UTF-8 text, white space and ASCII non-letters being word
edges; each is hashed to one of ``BUCKETS`` vectors. A text is the mean of its subwords' vectors. The model is trained on
every labelled row: a hash deals the rows to cells, a round takes one cell for each of its learners, these descend by
stochastic gradients from the same start in tasks of their own, and the mean of their parameters starts the next round.
Beside it two models are trained on half of the rows each, by a hash. Each row is scored by the one that did not learn
from it, as it is and with its characters shuffled. From these scores of all rows come the temperature and the score below
which the model rejects: it costs at most ``REJECT_SHARE`` of the rows that are labelled rightly, and is no higher than
``NOISE_SHARE`` of the shuffled texts reach.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonara.llm.common import stage

BUCKETS = 1 << 13
DIMENSIONS = 16
#: Rounds of training: where all rows are one cell, and where there are more.
EPOCHS, ROUNDS = 12, 8
#: Rows that a learner takes in a round, and the fewest of each language, whose rows are repeated in other cells for it.
CELL_ROWS, LANG_ROWS = 3072, 32
RATE = 40.0
BATCH = 32
#: The model of all rows, then for each half of the rows the one that does not learn from it.
MODELS = 3
#: Parameters that travel in one row when learners are averaged.
PIECE = 16384
TEMPERATURES = np.geomspace(0.25, 20, 60)
#: Share of rightly labelled rows that rejection may cost, and share of shuffled texts that it is to reject.
REJECT_SHARE, NOISE_SHARE = 0.0002, 0.99
BINS = 1000

_EDGES = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def _bytes(text: str | None) -> bytes:
    return f" {text or ''} ".lower().encode("utf-8", "replace")


def _pieces(text: bytes):
    """Start and bucket of every subword, by length. Texts that are joined share none, as each has a space at both ends."""
    a = _EDGES[np.frombuffer(text, np.uint8)].astype(np.uint32)
    inner = a != 32
    for n in (3, 4):
        if len(a) < n:
            continue
        m = len(a) - n + 1
        code = np.zeros(m, np.uint32)
        whole = np.ones(m, bool)
        for i in range(n):
            code = (code << np.uint32(8)) | a[i:i + m]
            if 0 < i < n - 1:
                whole &= inner[i:i + m]
        code = (code ^ np.uint32(n * 0x1000193)) * np.uint32(0x9E3779B1)
        yield np.flatnonzero(whole), code[whole] >> np.uint32(32 - 13)


def subwords(text: str) -> np.ndarray:
    """Bucket of every subword, repeats included."""
    found = [buckets for _, buckets in _pieces(_bytes(text))]
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def shares(texts) -> np.ndarray:
    """Share of every bucket among the subwords, a row per text."""
    parts = [_bytes(t) for t in texts]
    row = np.repeat(np.arange(len(parts)) * BUCKETS, [len(p) for p in parts])
    cells = [row[at] + buckets for at, buckets in _pieces(b"".join(parts))]
    counts = np.bincount(np.concatenate(cells) if cells else np.empty(0, int), minlength=len(parts) * BUCKETS).reshape(len(parts), BUCKETS)
    return (counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities for rows of mean bucket shares."""
        return _softmax((x @ self.vectors @ self.weights + self.bias) / self.temperature)


def _start(languages: int, seed: int = 7) -> np.ndarray:
    """Parameters that every model starts from, a row per model."""
    rng = np.random.default_rng(seed)
    one = np.concatenate([rng.uniform(-1, 1, BUCKETS * DIMENSIONS) / DIMENSIONS, rng.uniform(-1, 1, DIMENSIONS * languages), np.zeros(languages)])
    return np.tile(one.astype(np.float32), (MODELS, 1))


def _parts(state: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Views of vectors, weights and bias of every model."""
    a, b = BUCKETS * DIMENSIONS, (BUCKETS + languages) * DIMENSIONS
    n = len(state)
    return state[:, :a].reshape(n, BUCKETS, DIMENSIONS), state[:, a:b].reshape(n, DIMENSIONS, languages), state[:, b:]


def _descend(state: np.ndarray, languages: int, texts, y: np.ndarray, fold: np.ndarray, weight: np.ndarray, rate: float) -> None:
    """One step of all models, in place."""
    vectors, weights, bias = _parts(state, languages)
    x = shares(texts)
    learns = fold[None, :] != np.arange(-1, MODELS - 1)[:, None]
    hidden = x @ vectors
    p = _softmax(hidden @ weights + bias[:, None])
    p[:, np.arange(len(y)), y] -= 1
    p *= (learns * weight / np.maximum(learns.sum(1, keepdims=True), 1)).astype(np.float32)[..., None]
    back = p @ weights.transpose(0, 2, 1)
    weights -= 0.02 * rate * (hidden.transpose(0, 2, 1) @ p)
    bias -= 0.02 * rate * p.sum(1)
    vectors -= rate * (x.T @ back)


_CELL_KEY = ["cell", "draw", "doc_id", "lang", "copy"]


def _learner_rows(state: np.ndarray, languages: list[str], weight: dict[str, float], rate: float, turn: int):
    """Tasks that run the learners of their cells from sorted rows; repeated rows count once."""
    k = len(languages)
    number = {lang: i for i, lang in enumerate(languages)}

    def pieces(cell, own, rows):
        for m in range(MODELS):
            for i, a in enumerate(range(0, state.shape[1], PIECE)):
                yield m, i, cell, int(rows[m]), own[m, a:a + PIECE].tobytes()

    def run(batches):
        columns = ["model", "piece", "cell", "rows", "parameters"]
        cell, own, rows, last = None, None, None, None
        for pdf in batches:
            if pdf.empty:
                continue
            keys = pdf[_CELL_KEY]
            new = (keys != keys.shift()).any(axis=1).to_numpy()
            new[0] = tuple(keys.iloc[0]) != last
            last = tuple(keys.iloc[-1])
            for c, part in pdf[new].groupby("cell", sort=False):
                if c != cell:
                    if own is not None:
                        yield pd.DataFrame(pieces(cell, own, rows), columns=columns)
                    cell, own, rows = c, state.copy(), np.zeros(MODELS, int)
                part = part.iloc[np.random.default_rng((turn, int(c), int(rows[0]))).permutation(len(part))]
                y, fold = part["lang"].map(number).to_numpy(), part["fold"].to_numpy()
                w, texts = part["lang"].map(weight).to_numpy(), part["text"].to_numpy()
                for a in range(0, len(part), BATCH):
                    b = slice(a, a + BATCH)
                    _descend(own, k, texts[b], y[b], fold[b], w[b], rate)
                rows += [len(part), *((fold != f).sum() for f in range(MODELS - 1))]
        if own is not None:
            yield pd.DataFrame(pieces(cell, own, rows), columns=columns)

    return run


def _mean_piece(pdf: pd.DataFrame) -> pd.DataFrame:
    """Mean of one piece over the learners, by their rows."""
    total, rows = 0.0, 0
    for r in pdf.sort_values("cell").itertuples():
        total = total + r.rows * np.frombuffer(r.parameters, np.float32).astype(float)
        rows += r.rows
    mean = (total / max(rows, 1)).astype(np.float32)
    return pd.DataFrame({"model": pdf["model"][:1], "piece": pdf["piece"][:1], "rows": [rows], "parameters": [mean.tobytes()]})


def train(rows: DataFrame, sizes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Parameters of all models from every (doc_id, lang, draw, fold, text) row, and the rows a round that each learned from.

    ``sizes`` are the different rows of each language. Equal rows give equal parameters, whatever their order.
    """
    languages, n = sorted(sizes), sum(sizes.values())
    k = len(languages)
    slices = min(ROUNDS, max(1, n // CELL_ROWS))
    learners = max(1, n // (slices * CELL_ROWS))
    cells = slices * learners
    copies = {lang: -(-LANG_ROWS * cells // size) if size < LANG_ROWS * cells else 1 for lang, size in sizes.items()}
    most = sum(sizes[lang] * copies[lang] for lang in languages)
    weight = {lang: most / (k * sizes[lang] * copies[lang]) for lang in languages}
    copy = F.lit(0)
    if max(copies.values()) > 1:
        times = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(c)) for lang, c in copies.items()])
        copy = F.explode(F.sequence(F.lit(0), times - 1))
    rows = rows.select("*", copy.alias("copy")).withColumn("cell", F.pmod(F.col("draw") + F.col("copy"), F.lit(cells)))
    state, learned = _start(k), np.zeros(MODELS, int)
    rounds = EPOCHS if cells == 1 else ROUNDS
    for turn in range(rounds):
        own = rows.filter(F.pmod("cell", F.lit(slices)) == turn % slices)
        own = own.repartition(learners, "cell").sortWithinPartitions(*_CELL_KEY).select(*_CELL_KEY, "fold", "text")
        run = _learner_rows(state, languages, weight, RATE * (1 - turn / rounds), turn)
        found = own.mapInPandas(run, "model int, piece int, cell long, rows long, parameters binary")
        after = state.copy()
        for r in found.groupBy("model", "piece").applyInPandas(_mean_piece, "model int, piece int, rows long, parameters binary").collect():
            if r.rows:
                after[r.model, r.piece * PIECE:(r.piece + 1) * PIECE] = np.frombuffer(r.parameters, np.float32)
            learned[r.model] = max(learned[r.model], r.rows)
        state = after
    return state, learned


def rejection_bound(right: np.ndarray, noise: np.ndarray) -> float:
    """The score to reject below, from counts of right rows and of shuffled texts by score, in ``BINS`` steps."""
    if not right.sum():
        return 0.0
    spared = np.flatnonzero(np.cumsum(right) > REJECT_SHARE * right.sum())[0]
    enough = np.flatnonzero(np.cumsum(noise) >= NOISE_SHARE * noise.sum())[0] + 1 if noise.sum() else 0
    return float(min(spared, enough)) / BINS


def held_out() -> Column:
    """The documents no model may learn from: remainder zero of the checksum of the id's digits."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def shuffled(text: str) -> str:
    """The characters of a text in another order, which its checksum chooses."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    return np.random.default_rng(zlib.crc32(text.encode("utf-8", "replace"))).permutation(letters).tobytes().decode("utf-32-le", "surrogatepass")


def _unseen_rows(state: np.ndarray, languages: list[str]):
    """Logits of each text and of its shuffled letters, by the model that did not learn from the row's half."""
    vectors, weights, bias = (a[1:] for a in _parts(state, len(languages)))
    number = {lang: i for i, lang in enumerate(languages)}

    def logits(texts, fold):
        return (shares(texts) @ vectors @ weights + bias[:, None])[fold, np.arange(len(fold))]

    def run(batches):
        for pdf in batches:
            right, noise = [], []
            for a in range(0, len(pdf), BATCH):
                texts, fold = pdf["text"].iloc[a:a + BATCH], pdf["fold"].to_numpy()[a:a + BATCH]
                right += list(logits(texts, fold))
                noise += list(logits([shuffled(t) for t in texts], fold))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "draw": pdf["draw"], "y": pdf["lang"].map(number), "own": right, "noise": noise})

    return run


def _loss_rows(batches):
    """Sum of the logarithmic losses under every temperature."""
    for pdf in batches:
        if pdf.empty:
            continue
        z, y = np.stack(pdf["own"]), pdf["y"].to_numpy()
        losses = [-np.log(_softmax(z / t)[np.arange(len(y)), y].clip(1e-12)).sum(dtype=float) for t in TEMPERATURES]
        yield pd.DataFrame({"step": range(len(losses)), "loss": losses})


def _bin_rows(temperature: float):
    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            p = _softmax(np.stack(pdf["own"]) / temperature)
            own, noise = p.max(1)[p.argmax(1) == pdf["y"].to_numpy()], _softmax(np.stack(pdf["noise"]) / temperature).max(1)
            score = np.concatenate([own, noise])
            yield pd.DataFrame({"noise": np.repeat([0, 1], [len(own), len(noise)]), "bin": (score * BINS).clip(0, BINS - 1).astype(int)})

    return run


def _calibrate(model: Model, rows: DataFrame, state: np.ndarray) -> None:
    """Temperature and bound of rejection from all rows, each scored by the model that did not learn from it."""
    scored = rows.mapInPandas(_unseen_rows(state, model.languages), "doc_id long, draw long, y int, own array<float>, noise array<float>")
    scored = stage(scored.dropDuplicates(["doc_id", "draw", "y"]), "scored")
    losses = {r.step: r.loss for r in scored.mapInPandas(_loss_rows, "step int, loss double").groupBy("step").agg(F.sum("loss").alias("loss")).collect()}
    model.temperature = float(TEMPERATURES[min(losses, key=lambda step: (losses[step], step))])
    counts = np.zeros((2, BINS), np.int64)
    for r in scored.mapInPandas(_bin_rows(model.temperature), "noise int, bin int").groupBy("noise", "bin").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r.noise, r.bin] = r.n
    model.reject_below = rejection_bound(*counts)


def drawn(rows: DataFrame, most: int) -> DataFrame | None:
    """Different (doc_id, lang, text) rows with ``place`` in a random order of their language, ``most`` of all at most.

    Every language has the same share where it has the rows. A threshold on a hash, by the estimated number of
    different rows, leaves somewhat more than that, of which the first by the hash are kept, so no language brings more to a
    task. None without rows.
    """
    rows = rows.withColumn("draw", F.xxhash64("doc_id", "text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n")).collect()}
    if not sizes:
        return None
    each = max(1, most // len(sizes))
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, (1.1 * each + 5 * each**0.5 + 10) / n))) for lang, n in sizes.items()])
    some = rows.filter(F.col("draw").cast("double") <= share * 2.0**64 - 2.0**63)
    once = some.groupBy("lang", "doc_id", "draw").agg(F.min("text").alias("text"))
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id")))
    return placed.filter(F.col("place") <= each).withColumn("share", (F.col("place") - 1) / each)


def fit(docs: DataFrame, sample_rows: int | None = None, bound_rows: int | None = None) -> Model | None:
    """Learn from all labelled documents outside the held-out fold; None where there are none.

    Every different (doc_id, lang, text) row trains, and every one sets the temperature and the score to reject below.
    Only parameters and counts by score come back from the executors. ``docs`` is read in every round. Where some half of
    the rows is empty nothing is rejected by its score. Given ``sample_rows`` or ``bound_rows``, the caller restricts all
    of this to as many rows as both together, the same number for every language where it has them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}"))
    if sample_rows is not None or bound_rows is not None:
        rows = drawn(rows, (sample_rows or 0) + (bound_rows or 0))
        if rows is None:
            return None
        rows = stage(rows.select("doc_id", "lang", "text"), "sample")
    rows = rows.withColumn("draw", F.xxhash64("doc_id", "text")).withColumn("fold", F.pmod(F.xxhash64("draw"), F.lit(2)).cast("int"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.countDistinct("draw").alias("n")).collect()}
    if not sizes:
        return None
    state, learned = train(rows, sizes)
    languages = sorted(sizes)
    vectors, weights, bias = (a[0].copy() for a in _parts(state, len(languages)))
    model = Model(languages, vectors, weights, bias)
    if learned.all():
        _calibrate(model, rows, state)
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, rejected.

    lang_pred is ``und``, score 0 and rejected true where the text is null or has no letter, or nothing was learned.
    Otherwise lang_pred is the likeliest learned language (of equal ones the first by name) and rejected tells whether
    its score is under the calibrated bound. held_out is false for a null doc_id, which is never learned from. Equal
    texts get equal predictions; repeated rows give repeated results.
    """

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            lang, score, rejected = ["und"] * n, np.zeros(n), np.ones(n, bool)
            texts = batch.column(2)
            at = [i for i, known in enumerate(batch.column(3).to_pylist()) if known and model]
            for a in range(0, len(at), BATCH):
                part = at[a:a + BATCH]
                p = model.scores(shares([texts[i].as_py() for i in part]))
                best = p.argmax(1)
                for i, b, s in zip(part, best.tolist(), p.max(1).tolist()):
                    lang[i], score[i], rejected[i] = model.languages[b], min(1.0, s), s < model.reject_below
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                                             names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text",
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("known"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Documents that are not rejected, all columns kept; the model is fitted on all labelled ones of them unless given.

    Texts without a letter are dropped. Where no document is labelled nothing is known of languages, and all texts with
    letters stay. Rows are tested one by one, so repeated rows and null ids are kept or dropped by their own text.
    """
    model = model or fit(docs)
    names = docs.columns
    inner = docs.select("*", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_known"))

    def run(batches):
        for batch in batches:
            texts, known = batch.column(names.index("text")), batch.column(len(names)).to_pylist()
            keep = np.array(known, bool)
            for a in range(0, len(at := np.flatnonzero(keep)) if model else 0, BATCH):
                part = at[a:a + BATCH]
                p = model.scores(shares([texts[int(i)].as_py() for i in part]))
                keep[part] = p.max(1) >= model.reject_below
            yield batch.filter(pa.array(keep)).select(range(len(names)))

    return inner.mapInArrow(run, docs.schema)
