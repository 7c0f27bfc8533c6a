"""Chat formatting after collapse of cumulative snapshots.

Logs often hold a conversation many times, once after each turn. A conversation that is the beginning of a longer one,
or equals another, adds nothing. Every prefix of every conversation gets a 128-bit hash: the exclusive or of its turns'
hashes, each salted with its place. A conversation whose whole hash is a shorter prefix of another goes by an anti-join;
of equal ones the least conv_id stays. What remains is rendered.

Running values are taken within segments of ``SEGMENT`` turn numbers and then over segments, so a conversation of any
length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonara.llm.common import stage

SEGMENT = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefix_hashes(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, place, n_turns, hash_a, hash_b, role, text): every turn with the hash of the conversation up to it."""
    t = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(2**62)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("seg", F.floor(F.col("turn") / segment)).withColumn("a", F.xxhash64("role", "text")).withColumn("b", F.xxhash64("text", F.lit("|"), "role"))
    order = Window.partitionBy("conv_id", "seg").orderBy("turn", "a", "b")
    same = F.struct("turn", "a", "b")
    t = t.withColumn("prev", F.lag(same).over(order)).filter(F.col("prev").isNull() | (F.col("prev") != same)).drop("prev")
    t = stage(t.withColumn("rn", F.row_number().over(order)), "turns")

    segments = Window.partitionBy("conv_id").orderBy("seg")
    whole = Window.partitionBy("conv_id")
    sizes = t.groupBy("conv_id", "seg").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("conv_id", "seg", (F.sum("n").over(segments) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("n_turns"))
    t = t.join(sizes, ["conv_id", "seg"]).withColumn("place", F.col("before") + F.col("rn"))
    t = t.withColumn("a", F.xxhash64("place", "a")).withColumn("b", F.xxhash64("place", "b"))
    so_far = Window.partitionBy("conv_id", "seg").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    t = stage(t.select("conv_id", "seg", "place", "n_turns", F.bit_xor("a").over(so_far).alias("a"), F.bit_xor("b").over(so_far).alias("b"), "role", "text"), "places")
    ends = t.groupBy("conv_id", "seg").agg(F.max_by(F.struct("a", "b"), "place").alias("end"))
    earlier = segments.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("conv_id", "seg", *[F.coalesce(F.bit_xor(f"end.{c}").over(earlier), F.lit(0).cast("long")).alias(f"before_{c}") for c in "ab"])
    t = t.join(ends, ["conv_id", "seg"])
    return t.select("conv_id", "place", "n_turns", F.col("a").bitwiseXOR(F.col("before_a")).alias("hash_a"), F.col("b").bitwiseXOR(F.col("before_b")).alias("hash_b"), "role", "text")


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_copies) of conversations that begin no longer one; of equal ones the least conv_id."""
    whole = prefixes.filter(F.col("place") == F.col("n_turns")).groupBy("n_turns", "hash_a", "hash_b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    begun = prefixes.filter(F.col("place") < F.col("n_turns")).select(F.col("place").alias("n_turns"), "hash_a", "hash_b").distinct()
    return whole.join(begun, ["n_turns", "hash_a", "hash_b"], "left_anti").select("conv_id", "n_copies")


def render(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Rendered maximal conversations: conv_id, segment, n_turns, n_copies, rendered.

    A conversation is one row, or one row for every ``segment`` turns of a longer one, to be joined in order. Turns go
    by turn number, those without one last; of one number by a hash of role and text. A turn repeated within a
    conversation counts once. Rows without conv_id belong to no conversation and go. Null roles and texts are empty.
    Marks of the template inside texts get a space, so they cannot open or close a turn. Other columns are not read.
    """
    prefixes = stage(prefix_hashes(turns, segment), "prefixes")
    kept = prefixes.select("conv_id", "place", "n_turns", "role", "text").join(maximal(prefixes), "conv_id")
    safe = lambda c: F.replace(F.col(c), F.lit("<|"), F.lit("< |"))
    piece = F.concat(F.lit(OPEN), safe("role"), F.lit("\n"), safe("text"), F.lit(CLOSE), F.lit("\n"))
    rows = kept.select("conv_id", F.floor((F.col("place") - 1) / segment).alias("segment"), "place", "n_turns", "n_copies", piece.alias("piece"))
    parts = rows.groupBy("conv_id", "segment", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("p"))
    return parts.select("conv_id", "segment", "n_turns", "n_copies", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("rendered"))
