"""Ranking and top-k that stay distributed when a group is large."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

_SALTS = 64
# above this Spark no longer cuts each map task to the first k rows of a group
_WIDE = 1000


def _salt_rounds(df: DataFrame) -> list[int]:
    """Sub-groups per round: as many as shuffle partitions on a cluster, then few."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return [partitions, _SALTS] if partitions > 4 * _SALTS else [_SALTS]


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str | None = None,
          salt_on: list[str] | None = None) -> DataFrame:
    """First ``k`` rows per group; ``order`` must break every tie.

    For a small ``k`` Spark cuts every map task to ``k`` rows per group before the
    shuffle. For a large one rows are first ranked inside salted sub-groups, so a group
    of any size is sorted by many tasks and at most 64*k of its rows meet in the last one.
    """
    name = rank or "_rank"
    if k >= _WIDE:
        for salts in _salt_rounds(df):
            salt = F.pmod(F.xxhash64(*(salt_on or df.columns)), F.lit(salts))
            w = Window.partitionBy(*group, "_salt").orderBy(*order)
            df = (df.withColumn("_salt", salt).withColumn("_pre", F.row_number().over(w))
                  .where(F.col("_pre") <= k).drop("_salt", "_pre"))
    w = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def dense_numbers(df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Exact ``row_number`` per group without putting a whole group in one task.

    ``bucket`` is an integer that grows with the order. Rows are numbered inside their
    (group, bucket) and shifted by the sizes of the buckets before it; only the bucket
    sizes, one row per bucket, are cumulated per group.
    """
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    w = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return (df.withColumn("_in", F.row_number().over(w)).join(starts, [*group, "_bucket"])
            .withColumn(name, F.col("_in") + F.col("_start")).drop("_in", "_start", "_bucket"))


def counts_below(hist: DataFrame, group: list[str], value: str, counts: list[str], bin_: Column) -> DataFrame:
    """Add ``<c>_below`` (rows with a smaller value) and ``<c>_total`` to a histogram of distinct values.

    ``bin_`` is an integer that grows with the value. Counts below are those of lower bins
    plus those below inside the own bin, so no task sorts all values of a group.
    """
    hist = hist.withColumn("_bin", bin_)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole, lower = Window.partitionBy(*group), before(Window.partitionBy(*group).orderBy("_bin"))
    bins = hist.groupBy(*group, "_bin").agg(*[F.sum(c).alias(c) for c in counts])
    starts = bins.select(*group, "_bin", *[zero(F.sum(c).over(lower)).alias(f"_{c}_start") for c in counts],
                         *[F.sum(c).over(whole).alias(f"{c}_total") for c in counts])
    inside = before(Window.partitionBy(*group, "_bin").orderBy(value))
    ranked = hist.select("*", *[zero(F.sum(c).over(inside)).alias(f"_{c}_in") for c in counts]).join(starts, [*group, "_bin"])
    for c in counts:
        ranked = ranked.withColumn(f"{c}_below", F.col(f"_{c}_in") + F.col(f"_{c}_start"))
    return ranked.drop("_bin", *[f"_{c}_in" for c in counts], *[f"_{c}_start" for c in counts])


def quantiles(df: DataFrame, group: list[str], value: str, wanted: dict[str, float], bin_: Column) -> DataFrame:
    """Exact quantiles per group with linear interpolation, over distinct values in bins."""
    hist = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("c"))
    ranked = counts_below(hist, group, value, ["c"], bin_)
    aggs = []
    for name, q in wanted.items():
        at = q * (F.col("c_total") - 1)
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("c_below") <= index) & (index < F.col("c_below") + F.col("c"))
            aggs.append(F.max(F.when(here, F.col(value))).cast("double").alias(f"_{name}_{side}"))
        aggs.append(F.first(at - F.floor(at)).alias(f"_{name}_part"))
    out = ranked.groupBy(*group).agg(*aggs)
    mix = lambda n: F.col(f"_{n}_lo") + F.col(f"_{n}_part") * (F.col(f"_{n}_hi") - F.col(f"_{n}_lo"))
    return out.select(*group, *[mix(n).alias(n) for n in wanted])


def unit_bin(value: str) -> Column:
    """Bin of a probability; values outside [0, 1] go to the ends."""
    return F.floor(F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(1.0)) * 1024)


def log_bin(value: str) -> Column:
    """Bin of a positive size, 32 per doubling."""
    return F.floor(F.log2(F.greatest(F.col(value), F.lit(1))) * 32)


def densify(values: DataFrame, keys: DataFrame, vocabulary: DataFrame, on: list[str], item: list[str],
            value: str = "value") -> DataFrame:
    """One row per key and vocabulary item, absent values as zero.

    The vocabulary is a selected list (top-k), so it travels as one scalar array and is
    exploded next to each key.
    """
    listed = vocabulary.select(F.struct(*item).alias("_v")).agg(F.collect_list("_v").alias("_vs")).scalar()
    grid = keys.select(*on, F.explode(listed).alias("_v")).select(*on, *[F.col(f"_v.{i}").alias(i) for i in item])
    return grid.join(values.select(*on, *item, value), [*on, *item], "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(0.0)))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
