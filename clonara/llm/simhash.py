"""Near-duplicates by SimHash fingerprints and pivot distance tables.

Fingerprints that differ in at most three of 64 bits agree on at least three of six bit blocks, so candidates meet in
one of twenty buckets; a pivot table alone would leave a share of all pairs that does not shrink with the data, as
distances to any reference spread over a dozen values only. Within a bucket the table of distances to reference
fingerprints discards a pair when a coordinate differs by more than three (triangle inequality), and survivors are
verified on their bits. Buckets too large for that are linked through common neighbours without looking at pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonara.llm.common import chunks_of_groups, stage
from clonara.llm.components import components

SEED = 42
BITS = 3
#: Distinct fingerprints in a bucket up to which its pairs are looked at inside one task.
PAIRS_UP_TO = 2048
#: Rows of sorted buckets that a task holds at once.
CHUNK_ROWS = 100_000

_EDGES = [0, 11, 22, 33, 44, 54, 64]
_BLOCKS = [((1 << b) - (1 << a)) for a, b in zip(_EDGES, _EDGES[1:])]
#: A mask for every choice of three blocks, as signed longs.
MASKS = [m - (1 << 64) if (m := a | b | c) >> 63 else m for a, b, c in combinations(_BLOCKS, 3)]
#: Reference fingerprints of the pivot table.
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(12)], np.uint64)


def shingle_hashes(data: bytes) -> list[int]:
    words = data.lower().split()
    if len(words) < 3:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    digest = xxhash.xxh64_intdigest
    return [digest(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:])]


def fingerprint(data: bytes | None) -> int:
    """Majority bits of the hashes of all three-word shingles, repeats included; zero without words."""
    hashes = np.array(shingle_hashes(data or b""), np.uint64)
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[a:a + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, textkey long) for every row; a null text has no words."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "textkey"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("textkey"))
    return rows.mapInArrow(run, "doc_id long, fp long, textkey long")


def _linked(fps: np.ndarray, run_end: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the runs whose fingerprints differ in at most ``bits`` bits."""
    table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    left, right = [], []
    at, k = np.arange(len(fps)), 1
    while True:
        at = at[at + k < run_end[at]]
        if not len(at):
            break
        near = at[np.abs(table[at] - table[at + k]).max(1) <= bits]
        near = near[np.bitwise_count(fps[near] ^ fps[near + k]) <= bits]
        left.append(near)
        right.append(near + k)
        k += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (at, at)


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least index connected to each index."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _bucket_links(batches, bits: int = BITS):
    for part in chunks_of_groups(batches, ["c", "v"], CHUNK_ROWS):
        c, v = part["c"].to_numpy(), part["v"].to_numpy()
        fps, reps = part["fp"].to_numpy().view(np.uint64), part["rep"].to_numpy()
        edge = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (v[1:] != v[:-1]), True])
        run_end = np.repeat(edge[1:], np.diff(edge))
        left, right = _linked(fps, run_end, bits)
        root = _roots(len(fps), left, right)
        hit = np.flatnonzero(root != np.arange(len(fps)))
        yield pa.RecordBatch.from_arrays([pa.array(reps[hit]), pa.array(reps[root[hit]])], names=["a", "b"])


def _star_links(points: DataFrame) -> DataFrame:
    """Links of (fp, rep) rows through points at most two bits from one and one bit from the other end.

    All fingerprints within two bits of a point are within three bits of every one that is within one bit of it, so
    they are linked to the least of those. A group has at most 2,081 rows, whatever the size of the cluster.
    """
    bit = lambda i: F.when(F.col(i) == 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftleft(1L, {i} - 1)"))
    near = (
        points.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(64))))
        .withColumn("j", F.explode(F.when(F.col("i") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("i") - 1))))
        .select("rep", F.col("fp").bitwiseXOR(bit("i")).bitwiseXOR(bit("j")).alias("z"), (F.col("j") == 0).alias("close"))
    )
    center = F.min(F.when(F.col("close"), F.col("rep"))).over(Window.partitionBy("z"))
    return near.select(F.col("rep").alias("a"), center.alias("b")).filter(F.col("a") != F.col("b")).distinct()


def near_links(distinct: DataFrame, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """Links (a, b) between representatives that connect the same rows as all pairs within three bits."""
    keys = F.array(*[F.struct(F.lit(k).cast("int").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(MASKS)])
    keyed = distinct.select("fp", "rep", F.explode(keys).alias("k")).select("k.c", "k.v", "fp", "rep")
    large = stage(keyed.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > pairs_up_to), "buckets")
    some = len(large.take(1)) > 0
    small = keyed.join(large, ["c", "v"], "left_anti") if some else keyed
    links = small.repartition("c", "v").sortWithinPartitions("c", "v").mapInArrow(_bucket_links, "a long, b long").distinct()
    if some:
        links = links.unionByName(_star_links(keyed.join(large, ["c", "v"], "left_semi").select("fp", "rep").distinct()))
    return links


def _classes(fps: DataFrame, pairs_up_to: int) -> DataFrame:
    """(fp, component_id, leads): least doc_id of the group of each fingerprint, and whether the fingerprint stands for it.

    A fingerprint is named by its least doc_id. Where an id is the least one of several, which is rare, pairs of id and
    fingerprint are the nodes instead, so that different texts under one id are not linked by it.
    """
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter(F.col("rep").isNotNull()), "distinct")
    if not distinct.groupBy("rep").count().filter("count > 1").take(1):
        roots = components(near_links(distinct, pairs_up_to))
        joined = distinct.join(roots, distinct["rep"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "rep").alias("component_id"))
        return joined.select("fp", "component_id", (F.col("rep") == F.col("component_id")).alias("leads"))
    node = F.struct("rep", "fp")
    links = near_links(distinct.select("fp", F.col("fp").alias("rep")), pairs_up_to)
    for end in ("a", "b"):
        links = links.join(distinct.select(F.col("fp").alias(end), node.alias(f"_{end}")), end)
    roots = components(links.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).select(F.col("node.fp").alias("fp"), "root")
    root = F.coalesce("root", node)
    return distinct.join(roots, "fp", "left").select("fp", root["rep"].alias("component_id"), (root["fp"] == F.col("fp")).alias("leads"))


def near_duplicates(docs: DataFrame, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links of three bits).

    Null and wordless texts have fingerprint zero and are linked like any other. Repeated rows give repeated results.
    Different texts under one doc_id are linked by their fingerprints only. Rows with a null doc_id get a fingerprint;
    they link nothing, and their component is that of their fingerprint, null if no row with an id has it. Other
    columns are not read.
    """
    fps = stage(fingerprints(docs), "fingerprints")
    return fps.join(_classes(fps, pairs_up_to), "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """Documents that stand for their group: the one with the least doc_id; all columns kept.

    Repeated rows of that id and text are kept once. Of different texts under one doc_id each is kept or dropped with
    its own group. Rows with a null doc_id cannot be told apart from others; they stay.
    """
    fps = stage(fingerprints(docs), "fingerprints")
    leading = fps.join(_classes(fps, pairs_up_to).filter("leads"), "fp").filter(F.col("doc_id") == F.col("component_id"))
    keep = leading.groupBy(F.col("doc_id").alias("_doc"), "fp").agg(F.min("textkey").alias("_key")).select("_doc", "_key")
    return keep_rows(docs, fps.select("doc_id", "textkey"), keep)


def keep_rows(docs: DataFrame, keys: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of the document ids and text hashes in ``keep`` (_doc, _key), repeated ones once, and all with a null doc_id.

    ``keys`` has doc_id and textkey of every row with an id.
    """
    named = docs.filter(F.col("doc_id").isNotNull()).withColumn("_textkey", F.xxhash64("text"))
    same = (F.col("doc_id").cast("long") == F.col("_doc")) & (F.col("_textkey") == F.col("_key"))
    # texts are neither sorted nor aggregated: keys alone tell which rows are repeated, and only those are looked at again
    repeated = keys.groupBy(F.col("doc_id").alias("_doc"), F.col("textkey").alias("_key")).count().filter("count > 1").drop("count")
    repeats = bool(repeated.take(1))
    once = keep.join(repeated, ["_doc", "_key"], "left_anti") if repeats else keep
    kept = named.join(once.hint("shuffle_hash"), same, "left_semi")
    if repeats:
        kept = kept.unionByName(named.join(keep.join(repeated, ["_doc", "_key"], "left_semi"), same, "left_semi").dropDuplicates(["doc_id", "_textkey"]))
    return kept.drop("_textkey").unionByName(docs.filter(F.col("doc_id").isNull()))
