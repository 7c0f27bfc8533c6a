"""Near copies: documents that share most of their word shingles, by wide SimHash fingerprints and pivot distance tables.

A fingerprint has 512 bits, the majority bits of the hashes of a text's different shingles. Bits differ in proportion
to the angle between the two sets, so a similarity means a radius in bits: at 0.8, 77 bits are expected and 90 allowed.
Fingerprints this far apart share no block of bits worth sorting by; candidates meet in bands of min-hashes of the same
shingles instead. Within a band's bucket a table of distances to some of its fingerprints discards whatever differs by
more than the radius in one of them (triangle inequality), and the rest is verified on all bits. No pair is written but
those that join two parts of a bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonara.llm.common import WordHashes, chunks_of_groups, mixed, stage, window_hashes
from clonara.llm.components import components
from clonara.llm.simhash import keep_rows

#: Words of a shingle, and the share of shingles (Jaccard) from which documents are copies of each other.
WIDTH = 5
SIMILARITY = 0.8
BANDS = 16
#: Rows of a bucket up to which one task holds it whole.
BUCKET_ROWS = 2048
#: Rows of sorted buckets that a task holds at once.
CHUNK_ROWS = 50_000

_LONGS = 8
_BITS = 64 * _LONGS
_FP = [f"f{i}" for i in range(_LONGS)]
_NODE = ["doc_id", "textkey"]
_LINK = [pa.field(name, pa.int64()) for name in ("a_doc", "a_key", "b_doc", "b_key")]
_TURNS = mixed(np.arange(1, _LONGS + 1, dtype=np.uint64))
#: Shingles whose bits are unpacked at once; a multiple of 255, so that bytes can hold the counts of a part.
_PART = 16 * 255
#: Rows of a bucket from which distances to pivots are tabulated, and their number.
_TABLE_FROM, _PIVOTS = 32, 4


def radius(similarity: float) -> int:
    """Bits in which the fingerprints of two sets of this similarity differ at most, in 19 of 20 cases."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return int(_BITS * p + 1.645 * math.sqrt(_BITS * p * (1 - p)))


def band_rows(similarity: float) -> int:
    """Min-hashes in a band: the most by which two sets of this similarity share one of the bands in 99 of 100 cases."""
    rows = 1
    while rows < 16 and 1 - (1 - similarity ** (rows + 1)) ** BANDS >= 0.99:
        rows += 1
    return rows


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    counts = np.zeros(_BITS, np.int64)
    for a in range(0, len(hashes), _PART):
        wide = mixed(hashes[a:a + _PART, None] ^ _TURNS[None, :])
        bits = np.unpackbits(wide.view(np.uint8), bitorder="little").reshape(-1, _BITS)
        whole = len(bits) // 255
        if whole:
            counts += bits[: whole * 255].reshape(whole, 255, _BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        counts += bits[whole * 255:].sum(0, dtype=np.uint8)
    return counts


def sketch(data: bytes | None, words: WordHashes, width: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint (8 longs) and band keys of a text; zeros without words. Fewer words than ``width`` are one shingle."""
    parts = words.array((data or b"").lower().split())
    if not len(parts):
        return np.zeros(_LONGS, np.uint64), np.zeros(BANDS, np.uint64)
    shingles = np.unique(window_hashes(parts, min(width, len(parts))))
    fp = np.packbits(2 * _bit_counts(shingles) > len(shingles), bitorder="little").view(np.uint64)
    factors = mixed(np.arange(1000, 1000 + BANDS * rows, dtype=np.uint64)) | np.uint64(1)
    least = np.full(BANDS * rows, 2**64 - 1, np.uint64)
    for a in range(0, len(shingles), _PART):
        least = np.minimum(least, (shingles[a:a + _PART, None] * factors[None, :]).min(0))
    keys = [xxhash.xxh64_intdigest(least[i:i + rows].tobytes()) for i in range(0, BANDS * rows, rows)]
    return fp, np.array(keys, np.uint64)


def sketches(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, textkey, f0..f7, bands) for every row with a doc_id."""
    rows = band_rows(similarity)
    schema = pa.schema([pa.field(c, pa.int64()) for c in (*_NODE, *_FP)] + [pa.field("bands", pa.list_(pa.int64()))])

    def run(batches):
        words = WordHashes()
        for batch in batches:
            made = [sketch(x.as_py(), words, width, rows) for x in batch.column(2)]
            fps = np.array([fp for fp, _ in made], np.uint64).reshape(-1, _LONGS).view(np.int64)
            keys = np.array([k for _, k in made], np.uint64).reshape(-1).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            columns = [batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(fps[:, i])) for i in range(_LONGS)), bands]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    texts = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("textkey"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, ", ".join(f"{c} long" for c in (*_NODE, *_FP)) + ", bands array<long>")


def _distance(fps: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps ^ one).sum(1, dtype=np.int16)


def forest(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join the same parts as all pairs of fingerprints within ``bits`` bits do."""
    table = None
    if len(fps) >= _TABLE_FROM:
        pivots = np.linspace(0, len(fps) - 1, _PIVOTS).astype(int)
        table = np.stack([_distance(fps, fps[p]) for p in pivots], 1)
    child, parent = [], []
    rest = np.arange(len(fps))
    while len(rest) > 1:
        lead, rest = rest[0], rest[1:]
        reached = [lead]
        while reached and len(rest):
            x = reached.pop()
            near = np.arange(len(rest)) if table is None else np.flatnonzero(np.abs(table[rest] - table[x]).max(1) <= bits)
            near = near[_distance(fps[rest[near]], fps[x]) <= bits]
            if len(near):
                hit = rest[near]
                child.append(hit)
                parent.append(np.full(len(hit), lead))
                reached.extend(hit)
                rest = np.delete(rest, near)
    none = np.empty(0, np.int64)
    return (np.concatenate(child), np.concatenate(parent)) if child else (none, none)


def _links_of(groups: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Links (a_doc, a_key, b_doc, b_key) inside the groups of equal keys."""

    def run(batches):
        for part in chunks_of_groups(batches, keys, CHUNK_ROWS):
            by = [part[k].to_numpy() for k in keys]
            new = np.zeros(part.num_rows - 1, bool)
            for k in by:
                new |= k[1:] != k[:-1]
            edge = np.flatnonzero(np.r_[True, new, True])
            fps = np.stack([part[c].to_numpy() for c in _FP], 1).view(np.uint64)
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for a, b in zip(edge, edge[1:]):
                if b - a > 1:
                    child, parent = forest(fps[a:b], bits)
                    left.append(child + a)
                    right.append(parent + a)
            left, right = np.concatenate(left), np.concatenate(right)
            node = [part[c].to_numpy() for c in _NODE]
            yield pa.RecordBatch.from_arrays([pa.array(n[side]) for side in (left, right) for n in node], schema=pa.schema(_LINK))

    rows = groups.select(*keys, *_NODE, *_FP).repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, "a_doc long, a_key long, b_doc long, b_key long")


def _large_links(rows: DataFrame, bits: int, bucket_rows: int) -> DataFrame:
    """Links in buckets that no task should hold whole; rows have the bucket's size ``n``.

    Rows within the radius of the bucket's least row are linked to it. Any other link has an end among the rest, which
    meets all rows of the bucket, one block of the rest and one of the bucket in a group.
    """
    bucket, size = ["c", "v"], F.lit(max(bucket_rows, 1))
    lead = stage(rows.groupBy(*bucket).agg(F.min(F.struct(*_NODE, *_FP)).alias("lead")), "leads")
    apart = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"lead.{f}"))) for f in _FP), F.lit(0))
    rows = stage(rows.join(lead, bucket).withColumn("far", apart > bits), "buckets")
    stars = rows.filter(~F.col("far")).select(
        F.col("doc_id").alias("a_doc"), F.col("textkey").alias("a_key"), F.col("lead.doc_id").alias("b_doc"), F.col("lead.textkey").alias("b_key"))
    rest = rows.filter("far").drop("lead")
    counts = rest.groupBy(*bucket).agg(F.count(F.lit(1)).alias("r"))
    blocks = lambda n: F.ceil(F.col(n) / size).cast("long")
    own = lambda n, seed: F.pmod(F.xxhash64(*_NODE, F.lit(seed)), blocks(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), blocks(n) - 1))
    whole = rows.drop("lead").join(counts, bucket).withColumn("i", own("n", 1)).withColumn("j", all_of("r"))
    some = rest.join(counts, bucket).withColumn("j", own("r", 2)).withColumn("i", all_of("n"))
    return stars.unionByName(_links_of(whole.unionByName(some), ["c", "v", "i", "j"], bits))


def one_of_each(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Documents that stand for their group of near copies: the one of the least doc_id; all columns kept.

    Groups are the connected parts of links between fingerprints within ``radius(similarity)`` bits. Texts are compared
    by their lower-cased words; those without any are one group. Repeated rows of one id and text are kept once, different
    texts under one doc_id are kept or dropped with their own groups, rows with a null doc_id stay.
    """
    bits = radius(similarity)
    made = stage(sketches(docs, width, similarity), "sketches")
    nodes = stage(
        made.groupBy(*_FP, "bands").agg(F.min(F.struct(*_NODE)).alias("node")).select("node.*", *_FP, "bands"), "different")
    keyed = nodes.select(*_NODE, *_FP, F.posexplode("bands").alias("c", "v"))
    large = stage(keyed.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket_rows), "large")
    some = bool(large.take(1))
    links = _links_of(keyed.join(large, ["c", "v"], "left_anti") if some else keyed, ["c", "v"], bits)
    if some:
        links = links.unionByName(_large_links(keyed.join(large, ["c", "v"]), bits, bucket_rows))
    node = lambda side: F.struct(F.col(f"{side}_doc").alias("doc_id"), F.col(f"{side}_key").alias("textkey"))
    copies = components(links.select(node("a").alias("a"), node("b").alias("b"))).select("node.*")
    keep = nodes.select(*_NODE).join(copies, _NODE, "left_anti").toDF("_doc", "_key")
    return keep_rows(docs, made.select(*_NODE), keep)
