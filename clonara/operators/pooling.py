"""Pooling of per-sequence embeddings to one vector per bag.

Vectors are exploded by position and folded per (bag, position) inside each task, so a
bag of any size shuffles at most one partial row per position and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def positions(df: DataFrame, bag: list[str], vector: str = "embedding", *keep: Column) -> DataFrame:
    return df.select(*bag, *keep, F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def pool(df: DataFrame, bag: list[str], method: str = "mean", vector: str = "embedding") -> DataFrame:
    """(bag, pos, value) rows; ``mean_max`` puts the maxima after the means, unknown methods use the mean."""
    parts = {"max": ["max"], "mean_max": ["mean", "max"], "stats": ["mean", "std", "min", "max"]}.get(method, ["mean"])
    agg = {"mean": F.avg("x"), "max": F.max("x"), "min": F.min("x"), "std": F.stddev_pop("x")}
    flat = positions(df, bag, vector).groupBy(*bag, "pos").agg(*[agg[p].alias(p) for p in parts])
    if len(parts) == 1:
        return flat.select(*bag, "pos", F.col(parts[0]).alias("value"))
    width = F.count(F.lit(1)).over(Window.partitionBy(*bag)).cast("int")
    cells = F.array(*[F.struct((F.col("pos") + i * F.col("_d")).alias("pos"), F.col(p).alias("value")) for i, p in enumerate(parts)])
    return flat.withColumn("_d", width).select(*bag, F.inline(cells))


def pool_softmax(df: DataFrame, bag: list[str], score: str = "score", vector: str = "embedding") -> DataFrame:
    """Sum of vectors weighted by the softmax of their scores inside the bag.

    The bag maximum and normaliser come from a grouped pass, not from a window over the bag.
    """
    peak = df.groupBy(*bag).agg(F.max(score).alias("_peak"))
    rows = df.join(peak, bag)
    w = F.exp(F.col(score) - F.col("_peak"))
    weighted = positions(rows, bag, vector, w.alias("w")).groupBy(*bag, "pos").agg(
        (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("value"))
    return weighted


def as_vectors(pooled: DataFrame, bag: list[str]) -> DataFrame:
    """One ordered array per bag."""
    cells = F.sort_array(F.collect_list(F.struct("pos", "value")))
    return pooled.groupBy(*bag).agg(cells.alias("_c")).select(*bag, F.col("_c.value").alias("vector"))


def pool_default(bags: DataFrame, pooled: DataFrame, bag: list[str], width: int) -> DataFrame:
    """Every bag with a vector; zeros where there is none."""
    return bags.join(as_vectors(pooled, bag), bag, "left").withColumn(
        "vector", F.coalesce("vector", F.array_repeat(F.lit(0.0), F.lit(width))))
