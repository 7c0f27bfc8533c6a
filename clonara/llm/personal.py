"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Seeds are the base spans. A lexical pattern is the word before a colon or equals sign ("mail:", "ip ="); its instances
are whatever stands behind that sign. Further patterns hold only what has the shape of one kind (a run of digits like a
local phone number, a written-out at sign): behind such a word, behind a plain word ("call"), or before one ("mobile").
Spark scores the graph of patterns and instances in turns: a pattern by the share of its instances that are known or
believed to be of a kind, an instance by the patterns it stands in. A pattern counts only if its word is specific: it
stands beside seeds of the kind far more often than among all words, or a good part of all its places are beside them.
So "the" is no cue, however many of the numbers behind it are known. Patterns of high confidence mark further instances
that look like identifiers; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate, chain

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonara.llm.common import known_id, stage

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: Least score of a pattern, least number of its different believed instances, least belief that counts for that number.
LEAST_SCORE, LEAST_INSTANCES, LEAST_BELIEF = 0.8, 5, 0.8
#: Least score of the instances of one shape behind a colon or equals sign: other words behind it are not counted there.
LEAST_SHAPED = 0.5
#: A word is specific to a kind if its rate beside base spans is this many times its rate among all words (log-odds of
#: ln 10), or if this share of all its places is beside them.
LEAST_LIFT, LEAST_PLACES = 10.0, 0.25
#: Different words that a task counts before it passes them on.
WORDS_HELD = 200_000

_WORD = re.compile(r"[^\W\d_]{2,24}")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CUE = re.compile(r"([^\W\d_]{2,24})[\"']?[ \t]{0,4}\Z")
_BEHIND = re.compile(r"[ \t]{0,4}[\"'<(]?")
_TOKEN = re.compile(r"[^\s\"'<>(),;]{4,}+")

_LEFT_CUE = re.compile(r"([^\W\d_]{2,24})[\"']?[ \t]{0,4}([:=])[ \t]{0,4}[\"'<(]?\Z")
_LEFT_WORD = re.compile(r"(?<![^\W\d_])([^\W\d_]{2,24})[ \t]{1,4}[\"'<(]?\Z")
_RIGHT_WORD = re.compile(r"[\"'>)]?[ \t]{1,4}([^\W\d_]{2,24})(?![^\W_])")
_DIGITS_LIKE = re.compile(r"(?<![\w.+-])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,18}(?![\w-]|\.[0-9])")
_IP_LIKE = re.compile(r"(?<![\w.])[0-9]{1,4}(?:\.[0-9xX*]{1,4}){3}(?![\w]|\.[0-9])")
_MAIL_LIKE = re.compile(r"(?<![\w.])[A-Za-z0-9_][A-Za-z0-9._%+-]{0,63}(?:@| ?[(\[{]at[)\]}] ?)[A-Za-z0-9-]+(?:(?:\.| ?[(\[{]dot[)\]}] ?)[A-Za-z0-9-]+)*")

FOUND = ("doc_id long, doc long, textkey long, n_email long, n_ip long, n_card long, n_phone long, base string, "
         "candidates array<struct<pattern:string, instance:long, kind:int, like:boolean, start:int, stop:int>>")


def _emails(text: str):
    """Leftmost matches around each at sign: the run of local characters before it that no match has used."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end:
            piece = _LOCAL.search(text, max(end, start - 256), start).start()
            if piece == start:
                break
            start = piece
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind, then start."""
    found = [(0, a, b) for a, b in _emails(text)]
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
            found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return found


def candidates(text: str, base: list[tuple[int, int, int]]):
    """(pattern, instance, kind or none, whether it looks like an identifier, start, end) behind every cue."""
    if not (":" in text or "=" in text):
        return
    starts = {a: (k, b) for k, a, b in reversed(base)}
    covered = sorted((a, b) for _, a, b in base)
    begins, reach = [a for a, _ in covered], list(accumulate((b for _, b in covered), max))
    for m in re.finditer("[:=]", text):
        cue = _CUE.search(text, max(0, m.start() - 32), m.start())
        if not cue:
            continue
        at = _BEHIND.match(text, m.end()).end()
        pattern = cue.group(1).lower() + m.group()
        if at in starts:
            kind, end = starts[at]
            yield pattern, text[at:end], kind, True, at, end
        elif token := _TOKEN.match(text, at):
            i = bisect_right(begins, at)
            stop = min(token.end(), begins[i]) if i < len(begins) else token.end()
            end = at + len(text[at:stop].rstrip(".:!?"))
            if end - at >= 4 and not (i and at < reach[i - 1]):
                word = text[at:end]
                yield pattern, word, None, any(c.isdigit() or c == "@" for c in word), at, end


def _like_spans(text: str):
    """(kind number, start, end) of what has the shape of a kind without being a base span of it."""
    for m in _DIGITS_LIKE.finditer(text):
        n = len(_digits(m.group()))
        if n <= 15:
            yield 3, m.start(), m.end()
        if n >= 13:
            yield 2, m.start(), m.end()
    for m in _IP_LIKE.finditer(text):
        yield 1, m.start(), m.end()
    for m in _MAIL_LIKE.finditer(text):
        yield 0, m.start(), m.end()


def shaped(text: str, base: list[tuple[int, int, int]]):
    """As ``candidates``, for base spans and what has the shape of a kind, by the words on both sides."""
    covered = sorted((a, b) for _, a, b in base)
    begins, reach = [a for a, _ in covered], list(accumulate((b for _, b in covered), max))
    unseen = [(k, a, b) for k, a, b in _like_spans(text) if not (i := bisect_left(begins, b)) or reach[i - 1] <= a]
    for known, spans in ((True, base), (False, unseen)):
        for kind, a, b in spans:
            before = text[max(0, a - 40):a]
            if cue := _LEFT_CUE.search(before):
                sides = [cue.group(1).lower() + cue.group(2)]
            else:
                sides = [w.group(1).lower() + "_"] if (w := _LEFT_WORD.search(before)) else []
            if w := _RIGHT_WORD.match(text, b):
                sides.append("_" + w.group(1).lower())
            for side in sides:
                yield f"{side}#{KINDS[kind]}", "#" + text[a:b], kind if known else None, True, a, b


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document row with its base spans and the instances behind cues (columns of ``FOUND``)."""

    def run(batches):
        for batch in batches:
            counts, base, cands = [], [], []
            for text in batch.column(3).to_pylist():
                spans = base_spans(text or "")
                counts.append([sum(k == kind for k, _, _ in spans) for kind in range(4)])
                base.append(written(spans))
                cands.append([{"pattern": p, "instance": xxhash.xxh64_intdigest(w) - 2**63, "kind": k, "like": like, "start": a, "stop": b}
                              for p, w, k, like, a, b in chain(candidates(text or "", spans), shaped(text or "", spans))])
            kind = pa.list_(pa.struct([("pattern", pa.string()), ("instance", pa.int64()), ("kind", pa.int32()), ("like", pa.bool_()), ("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), *[pa.array([c[k] for c in counts], pa.int64()) for k in range(4)], pa.array(base, pa.string()), pa.array(cands, kind)],
                names=["doc_id", "doc", "textkey", "n_email", "n_ip", "n_card", "n_phone", "base", "candidates"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), known_id("doc_id").alias("doc"), F.xxhash64("text").alias("textkey"), "text")
    return rows.mapInArrow(run, FOUND)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts: lower-cased runs of letters; of runs over 24 letters each piece of that length."""

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(_WORD.findall((text.as_py() or "").lower()))
                if len(held) >= WORDS_HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def specific_patterns(found: DataFrame, words: DataFrame) -> DataFrame:
    """(pattern, kind) whose word belongs to the kind, by places beside base spans against all places of the word."""
    places = found.select(F.explode("candidates").alias("c")).filter("c.kind is not null").groupBy("c.pattern", "c.kind").agg(F.count(F.lit(1)).alias("at"))
    counted = found.agg(*[F.sum(f"n_{k}").alias(k) for k in KINDS]).select(F.posexplode(F.array(*KINDS)).alias("kind", "spans"))
    total = words.agg(F.sum("n").alias("words"))
    rated = places.withColumn("word", F.regexp_extract("pattern", r"^_?([^:=_#]+)", 1)).join(words, "word", "left").join(F.broadcast(counted), "kind").join(F.broadcast(total))
    everywhere = F.greatest(F.coalesce("n", F.lit(0)), "at")
    lift = (F.col("at") / F.col("spans")) / (everywhere / F.greatest("words", everywhere))
    return rated.filter((lift >= LEAST_LIFT) | (F.col("at") / everywhere >= LEAST_PLACES)).select("pattern", "kind")


def score_patterns(found: DataFrame, specific: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind) of high confidence, by alternating scores on the graph of patterns and instances.

    Only ``specific`` patterns take part as cues of a kind.

    A pattern's score for a kind is the sum of its different instances' beliefs over their number plus one. A seed's
    belief is one for its kind; other instances that look like identifiers are believed by noisy-or over the other
    patterns they stand in, so that no pattern confirms itself. Patterns of one shape have instances of their own.
    """
    flat = found.select(F.explode("candidates").alias("c")).select("c.pattern", "c.instance", "c.kind", "c.like")
    edges = stage(flat.groupBy("pattern", "instance").agg(F.min("kind").alias("kind"), F.max("like").alias("like")), "edges")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    seeds = edges.filter("kind is not null").select("pattern", "instance", "kind", F.lit(1.0).alias("belief"))
    unseen = edges.filter("kind is null and like").select("pattern", "instance")
    beliefs, scores = seeds, None
    for last in [False] * (rounds - 1) + [True]:
        summed = beliefs.groupBy("pattern", "kind").agg(F.sum("belief").alias("sum"), F.sum(F.when(F.col("belief") >= LEAST_BELIEF, 1).otherwise(0)).alias("believed"))
        scores = stage(summed.join(specific, ["pattern", "kind"], "left_semi").join(sizes, "pattern").select("pattern", "kind", (F.col("sum") / (F.col("n") + 1)).alias("score"), "believed"), "scores")
        good = scores.filter((F.col("score") >= LEAST_SCORE / 2) & (F.col("believed") >= LEAST_INSTANCES)).select("pattern", "kind", F.log(1 - F.least("score", F.lit(0.99))).alias("doubt"))
        if last or not good.take(1):
            break
        doubts = unseen.join(good, "pattern").groupBy("instance", "kind").agg(F.sum("doubt").alias("doubts"))
        thought = unseen.join(doubts, "instance").join(good, ["pattern", "kind"], "left").select(
            "pattern", "instance", "kind", (1 - F.exp(F.col("doubts") - F.coalesce("doubt", F.lit(0.0)))).alias("belief"))
        beliefs = stage(seeds.unionByName(thought), "beliefs")
    least = F.when(F.col("pattern").rlike("[:=]#"), LEAST_SHAPED).otherwise(LEAST_SCORE)
    return scores.filter((F.col("score") >= least) & (F.col("believed") >= LEAST_INSTANCES)).groupBy("pattern").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("found_kind"))


def discovered(found: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(doc, textkey, more: array of (kind, start, stop)) for documents with spans beyond the base ones; None if none."""
    specific = stage(specific_patterns(found, stage(word_counts(docs), "words")), "specific")
    patterns = stage(score_patterns(found, specific), "patterns")
    if not patterns.take(1):
        return None
    flat = found.select("doc", "textkey", F.explode("candidates").alias("c")).filter("c.kind is null and c.like").select("doc", "textkey", "c.pattern", "c.start", "c.stop")
    return flat.join(patterns, "pattern").groupBy("doc", "textkey").agg(F.collect_set(F.struct(F.col("found_kind").alias("kind"), "start", "stop")).alias("more"))


def _all_spans(base: str, more) -> list[tuple[int, int, int]]:
    spans = {(KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(",") if s)}
    return sorted(spans | {(m["kind"], m["start"], m["stop"]) for m in more or []})


def find_personal(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and discovered).

    Spans are kind:start:end by kind and start, in code points. A null text is empty. Repeated rows give repeated
    results; a row's discovered spans are those of its own doc_id and text. A null doc_id stays null. Of equal scores
    a pattern takes the kind listed first. Other columns are not read.
    """
    found = stage(scan(docs), "found")
    more = discovered(found, docs)
    joined = found.join(more, ["doc", "textkey"], "left") if more is not None else found.withColumn("more", F.lit(None).cast("array<struct<kind:int, start:int, stop:int>>"))
    item = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))
    parts = F.filter(F.split("base", ","), lambda s: s != "")
    split = F.transform(parts, lambda s: F.struct((F.array_position(F.array(*map(F.lit, KINDS)), F.split_part(s, F.lit(":"), F.lit(1))) - 1).cast("int").alias("kind"),
                                                  F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("start"), F.split_part(s, F.lit(":"), F.lit(3)).cast("int").alias("stop")))
    every = F.array_join(F.transform(F.array_sort(F.array_union(split, F.col("more"))), item), ",")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(every)
    return joined.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Text with spans replaced by their kind in brackets; of overlapping ones the first, and the longest of those."""
    out, at = [], 0
    for a, b, k in sorted(((a, b, k) for k, a, b in spans), key=lambda s: (s[0], -s[1], s[2])):
        if b <= at:
            continue
        if a >= at:
            out.append(text[at:a])
            out.append(f"[{KINDS[k].upper()}]")
        at = b
    return "".join(out) + text[at:]


def mask_personal(docs: DataFrame) -> DataFrame:
    """All columns of the documents, with personal data in text masked and n_chars, if present, recounted.

    Null texts stay null. Rows are masked by the spans of their own doc_id and text.
    """
    more = discovered(stage(scan(docs), "found"), docs)
    names = docs.columns
    keyed = docs.withColumn("_doc", known_id("doc_id")).withColumn("_textkey", F.xxhash64("text"))
    if more is None:
        keyed = keyed.withColumn("_more", F.lit(None).cast("array<struct<kind:int, start:int, stop:int>>"))
    else:
        keyed = keyed.join(more.select(F.col("doc").alias("_doc"), F.col("textkey").alias("_textkey"), F.col("more").alias("_more")), ["_doc", "_textkey"], "left")

    def run(batches):
        for batch in batches:
            texts = []
            for text, more in zip(batch.column("text").to_pylist(), batch.column("_more").to_pylist()):
                texts.append(None if text is None else masked(text, _all_spans(written(base_spans(text)), more)))
            columns = {n: batch.column(n) for n in names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([c if t is None else len(t) for t, c in zip(texts, batch.column("n_chars").to_pylist())], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return keyed.select(*names, "_more").mapInArrow(run, docs.schema)
