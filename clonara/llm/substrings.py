"""Substring deduplication: runs of words that already stand earlier are removed.

Seed: every window of ``MIN_WORDS`` words is filed under its anchor, the least hash of the five-word grams in it, so
equal windows share an anchor and neighbouring windows mostly have the same one. The anchor only deals windows out: those
of an anchor are compared by hashes of their whole word sequence, without extending a seed word by word, and windows that
match an earlier place are merged to maximal repeats, which cover all words to remove.

A task first settles repeats among the documents it reads; for each window only the first place it has seen travels
on. So a passage that a third of all documents share is shuffled once per piece of input, not once per document.
Windows that merely touch such a passage differ in their other words but share its anchors; anchors that many windows
have are found beforehand and their windows are dealt out by their own hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonara.llm.common import WordHashes, chunks_of_groups, known_id, mixed, packed, sliding_min, stage, window_hashes

MIN_WORDS = 20
GRAM = 5
#: Words of documents that are settled against each other inside a task.
CHUNK_WORDS = 600_000
#: Words whose hashes a task remembers.
REMEMBERED = 150_000
#: An anchor counts as frequent when it has more than this share of all anchor places (at most 1 / share of them).
FREQUENT_SHARE = 1 / 4096
#: Places of an anchor in one chunk from which it is reported as possibly frequent.
REPORT_FROM = 4
#: Rows of sorted anchors that a task compares at once.
CHUNK_ROWS = 60_000

KEYED = "shard long, doc long, textkey long, start int, kind int, body binary"
REPEATS = "doc long, textkey long, body binary"


class _Chunk:
    """Word hashes of documents held by a task, ordered by (doc, textkey) when read."""

    def __init__(self):
        self.docs, self.n = [], 0

    def add(self, doc, textkey, hashes):
        if len(hashes) >= MIN_WORDS:
            self.docs.append((doc, textkey, hashes))
            self.n += len(hashes)

    def windows(self):
        """doc, textkey, start, hash and anchor of every window, in document order."""
        self.docs.sort(key=lambda d: d[:2])
        lens = np.array([len(d[2]) for d in self.docs], np.int64)
        hashes = np.concatenate([d[2] for d in self.docs])
        at = np.repeat(np.arange(len(lens)), lens)
        begin = np.r_[0, np.cumsum(lens)[:-1]]
        place = np.arange(len(hashes)) - begin[at]
        count = len(hashes) - MIN_WORDS + 1
        valid = np.flatnonzero((place + MIN_WORDS <= lens[at])[:count])
        wh = window_hashes(hashes, MIN_WORDS)[valid]
        anchor = sliding_min(window_hashes(hashes, GRAM), MIN_WORDS - GRAM + 1)[valid]
        at = at[valid]
        docs, keys = np.array([d[0] for d in self.docs], np.int64), np.array([d[1] for d in self.docs], np.int64)
        return docs[at], keys[at], place[valid].astype(np.int32), wh, anchor


def _chunks(batches):
    chunk, cache = _Chunk(), WordHashes(REMEMBERED)
    for batch in batches:
        docs, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, text in enumerate(batch.column(2)):
            data = text.as_py()
            chunk.add(docs[i], keys[i], cache.array(data.split()) if data else ())
            if chunk.n >= CHUNK_WORDS:
                yield chunk
                chunk = _Chunk()
    if chunk.docs:
        yield chunk


def _anchor_counts(batches):
    """(anchor, runs of windows that have it) within a chunk, where it has several; and the number of all runs."""
    for chunk in _chunks(batches):
        doc, _, _, _, anchor = chunk.windows()
        runs = anchor[np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]]
        found, n = np.unique(runs, return_counts=True)
        some = n >= REPORT_FROM
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[found[some].view(np.int64), 0]), pa.array(np.r_[n[some], 0]), pa.array(np.r_[np.zeros(some.sum(), np.int64), len(runs)])], names=["anchor", "n", "runs"])


def frequent_anchors(docs: DataFrame) -> np.ndarray:
    """Anchors with more than a share of all places; the share bounds how many there can be."""
    counts = stage(docs.mapInArrow(_anchor_counts, "anchor long, n long, runs long"), "anchors")
    total = counts.agg(F.sum("runs")).first()[0] or 0
    rows = counts.groupBy("anchor").agg(F.sum("n").alias("n")).filter(F.col("n") > max(64, total * FREQUENT_SHARE)).select("anchor").collect()
    return np.sort(np.array([r.anchor for r in rows], np.int64).view(np.uint64))


def _later_places(order, same, doc, key, start):
    """Of windows sorted by hash and place: which stand later than the first place of their hash, and which are to be compared further.

    The latter are the first place of every hash, once for each text that holds it.
    """
    first = np.r_[True, ~same]
    head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    d, s = doc[order], start[order]
    later = (d != d[head]) | (s != s[head])
    k = key[order]
    return later, first | ~(later | np.r_[True, k[1:] == k[:-1]])


def _merged(doc, key, start):
    """Word intervals covered by windows in document order: (doc, key, from, to) of maximal ones."""
    if not len(doc):
        return doc, key, start, start
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] > start[:-1] + MIN_WORDS)])
    last = np.r_[cut[1:], len(doc)] - 1
    return doc[cut], key[cut], start[cut], start[last] + np.int32(MIN_WORDS)


def _interval_rows(doc, key, begin, end):
    """One (doc, key, packed pairs) per document."""
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]) if len(doc) else np.empty(0, np.int64)
    pairs = np.column_stack([begin, end]).astype(np.int32).reshape(-1)
    return doc[cut], key[cut], packed(pairs, 2 * np.r_[cut, len(doc)])


def _seeds(frequent: np.ndarray):
    def run(batches):
        for chunk in _chunks(batches):
            doc, key, start, wh, anchor = chunk.windows()
            order = np.lexsort((key, start, doc, wh)) if key.any() else np.argsort(wh, kind="stable")
            s = wh[order]
            later, first = _later_places(order, s[1:] == s[:-1], doc, key, start)
            repeats = np.sort(order[later])
            d, k, body = _interval_rows(*_merged(doc[repeats], key[repeats], start[repeats]))
            yield _keyed(mixed(d.view(np.uint64)), d, k, np.zeros(len(d), np.int32), 1, body)
            own = np.sort(order[first])
            hot = np.isin(anchor[own], frequent)
            alone = own[hot]
            yield _keyed(wh[alone], doc[alone], key[alone], start[alone], 0, packed(wh[alone], np.arange(len(alone) + 1)))
            own = own[~hot]
            if len(own):
                cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1] + 1) | (doc[own][1:] != doc[own][:-1]) | (key[own][1:] != key[own][:-1]) | (anchor[own][1:] != anchor[own][:-1])])
                at = own[cut]
                yield _keyed(anchor[at], doc[at], key[at], start[at], 0, packed(wh[own], np.r_[cut, len(own)]))

    return run


def _keyed(shard, doc, key, start, kind, body):
    return pa.RecordBatch.from_arrays(
        [pa.array(shard.view(np.int64)), pa.array(doc), pa.array(key), pa.array(start.astype(np.int32)), pa.array(np.full(len(doc), kind, np.int32)), body],
        names=["shard", "doc", "textkey", "start", "kind", "body"])


def _compared(batches):
    """Repeats across chunks: of the windows that share an anchor, those whose words stand at an earlier place."""
    for part in chunks_of_groups(batches, ["shard"], CHUNK_ROWS):
        kind = part["kind"].to_numpy()
        done = part.filter(pa.array(kind == 1)).combine_chunks()
        if done.num_rows:
            yield from done.select(["doc", "textkey", "body"]).to_batches()
        rest = part.filter(pa.array(kind == 0)).combine_chunks()
        shard = rest["shard"].to_numpy()
        same = shard[1:] == shard[:-1]
        shared = np.r_[False, same] | np.r_[same, False] if len(shard) else np.empty(0, bool)
        rest = rest.filter(pa.array(shared)).combine_chunks()
        if not rest.num_rows:
            continue
        bodies = [x.as_py() for x in rest["body"].chunk(0)]
        n = np.array([len(b) for b in bodies], np.int64) // 8
        wh = np.frombuffer(b"".join(bodies), np.uint64)
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(wh)) - np.repeat(np.cumsum(n) - n, n)
        doc, key = rest["doc"].to_numpy()[row], rest["textkey"].to_numpy()[row]
        start = (rest["start"].to_numpy()[row] + step).astype(np.int32)
        shard = rest["shard"].to_numpy()[row]
        order = np.lexsort((start, doc, wh, shard))
        s, w = shard[order], wh[order]
        later, _ = _later_places(order, (w[1:] == w[:-1]) & (s[1:] == s[:-1]), doc, key, start)
        hit = order[later]
        hit = hit[np.lexsort((start[hit], key[hit], doc[hit]))]
        d, k, body = _interval_rows(*_merged(doc[hit], key[hit], start[hit]))
        if len(d):
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(k), body], names=["doc", "textkey", "body"])


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """(doc, textkey, bodies) with the word intervals to remove, as packed pairs of 32-bit integers."""
    keyed = docs.select("doc", "textkey", F.col("text").cast("binary").alias("text"))
    seeds = keyed.mapInArrow(_seeds(frequent_anchors(keyed)), KEYED)
    repeats = seeds.repartition("shard").sortWithinPartitions("shard").mapInArrow(_compared, REPEATS)
    return repeats.groupBy("doc", "textkey").agg(F.collect_list("body").alias("bodies"))


def _kept(text: bytes | None, bodies: list[bytes] | None) -> tuple[int, list[bytes]]:
    words = text.split() if text else []
    if not bodies:
        return len(words), words
    edges = np.zeros(len(words) + 1, np.int32)
    pairs = np.frombuffer(b"".join(bodies), np.int32).reshape(-1, 2)
    np.add.at(edges, pairs[:, 0], 1)
    np.add.at(edges, pairs[:, 1], -1)
    keep = np.cumsum(edges[:-1]) == 0
    return len(words), [words[i] for i in np.flatnonzero(keep).tolist()]


def _with_keys(docs: DataFrame) -> DataFrame:
    """Documents with ``doc`` and ``textkey``, which together name a text.

    textkey is zero where a doc_id has one text, which is nearly always; only other ids need a hash of the text.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), known_id("doc_id").alias("doc"), "text")
    keys = named.select("doc", F.xxhash64("text").alias("k")).groupBy("doc").agg(F.min("k").alias("low"), F.max("k").alias("high"))
    several = stage(keys.filter("low <> high").select("doc", F.lit(True).alias("several")), "several")
    if not several.take(1):
        return named.withColumn("textkey", F.lit(0).cast("long"))
    return named.join(several, "doc", "left").withColumn("textkey", F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("several")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, kept_text (kept words joined by one space), n_words, n_removed, kept_sha256.

    Words are runs of anything but ASCII white space. A word goes when a window of 20 words over it also starts
    earlier: at a smaller doc_id, or earlier in the same document. Windows are judged on the input. A null text has no
    words; texts under 20 words stay whole. A null doc_id comes before all others. Rows of equal doc_id and text
    are one document: the same place in both is not earlier, so repeated rows give repeated results. Different texts
    under one doc_id are judged by their own places, of which equal ones are not earlier either. Other columns are not read.
    """

    def run(batches):
        for batch in batches:
            out = [_kept(t.as_py(), b.as_py()) for t, b in zip(batch.column(1), batch.column(2))]
            texts = [b" ".join(words) for _, words in out]
            n = [total for total, _ in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()), pa.array(n, pa.int64()), pa.array([t - len(w) for t, w in out], pa.int64()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                names=["doc_id", "kept_text", "n_words", "n_removed", "kept_sha256"])

    named = _with_keys(docs)
    marks = repeated_intervals(named)
    joined = named.join(marks, ["doc", "textkey"], "left").select("doc_id", F.col("text").cast("binary").alias("text"), "bodies")
    out = joined.mapInArrow(run, "doc_id long, kept_text binary, n_words long, n_removed long, kept_sha256 string")
    return out.withColumn("kept_text", F.col("kept_text").cast("string"))
