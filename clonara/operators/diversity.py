"""Diversity and clonality.

Clone sizes are first folded to (repertoire, size, how many clones have it). Sorting,
running sums and ranks then work on distinct sizes, whose number grows only with the
square root of a repertoire, so one huge repertoire never lands in one task row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clonara.constants import REP
from clonara.functions.text import alpha_seq, coerce_templates

_EPS = 1e-10


def row_sizes(df: DataFrame, value: Column | str = "templates", ones_if_missing: bool = False) -> DataFrame:
    """How many rows have each template count; a repertoire without any counts one per row if asked."""
    v = F.col(value) if isinstance(value, str) else value
    hist = df.select(*REP, v.cast("double").alias("size")).groupBy(*REP, "size").agg(F.count(F.lit(1)).alias("m"))
    if ones_if_missing:
        none = F.max("size").over(Window.partitionBy(*REP)).isNull()
        hist = hist.withColumn("size", F.when(none, F.lit(1.0)).otherwise(F.col("size")))
    return hist


def sequence_sizes(df: DataFrame, seq: str = "junction_aa") -> DataFrame:
    """How many distinct sequences occur each number of times; missing ones have no size."""
    counts = df.groupBy(*REP, seq).agg(F.count(F.lit(1)).alias("c"))
    size = F.when(F.col(seq).isNotNull(), F.col("c").cast("double"))
    return counts.groupBy(*REP, size.alias("size")).agg(F.count(F.lit(1)).alias("m"), F.sum("c").alias("rows"))


def size_statistics(hist: DataFrame, keep_zero: bool = False, over_rows: bool = False,
                    keep_empty: bool = False) -> DataFrame:
    """Per repertoire, every sum the diversity formulas need.

    ``n`` clones, ``total`` size, ``sq`` = sum of p^2, ``ln_sum`` = sum of size*ln(size),
    ``eps_sum`` = sum of p*ln(p+eps), ``eps_norm_sum`` = sum of (p+eps)*ln(p+eps),
    ``gini``, ``half`` = clones needed for half of the denominator, ``below_half`` = clones
    whose running share stays at or under a half, ``top1`` and ``top10`` shares.
    The denominator is the total, or all rows with ``over_rows``. With ``keep_empty``
    repertoires without any size stay, with missing statistics.
    """
    valid = F.col("size") >= 0 if keep_zero else F.col("size") > 0
    if keep_empty or over_rows:
        hist = hist.withColumn("m", F.when(valid, F.col("m"))).withColumn("size", F.when(valid, F.col("size")))
    else:
        hist = hist.where(valid)
    whole = Window.partitionBy(*REP)
    rising = whole.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mass = F.col("size") * F.col("m")
    h = (hist.withColumn("total", F.nullif(F.sum(mass).over(whole), F.lit(0.0)))
         .withColumn("n", F.sum("m").over(whole))
         .withColumn("up_mass", F.sum(mass).over(rising)).withColumn("up_n", F.sum("m").over(rising))
         .withColumn("denominator", F.sum("rows").over(whole) if over_rows else F.col("total")))
    if over_rows and not keep_empty:
        h = h.where(F.col("size").isNotNull())
    size, m = F.col("size"), F.col("m")
    larger, larger_n = F.col("total") - F.col("up_mass"), F.col("n") - F.col("up_n")
    missing = F.col("denominator") / 2 - larger
    p = size / F.col("total")
    q = size / F.col("denominator")
    before = F.col("up_n") - m
    crossing = (missing > 0) & (missing <= mass)
    steps = missing / F.nullif(size, F.lit(0.0))
    return h.groupBy(*REP).agg(
        F.first("n").alias("n"), F.first("total").alias("total"),
        F.sum(m * q * q).alias("sq"),
        F.sum(F.when(size > 0, mass * F.ln(size)).otherwise(0.0)).alias("ln_sum"),
        F.sum(m * p * F.ln(p + _EPS)).alias("eps_sum"),
        F.sum(m * (p + _EPS) * F.ln(p + _EPS)).alias("eps_norm_sum"),
        (2 * F.sum(size * (m * before + m * (m + 1) / 2)) / (F.first("n") * F.first("total"))
         - (F.first("n") + 1) / F.first("n")).alias("gini"),
        F.coalesce(F.min(F.when(crossing, larger_n + F.ceil(steps))), F.first("n") + 1).alias("half"),
        F.sum(F.least(m, F.greatest(F.floor(steps), F.lit(0)))).alias("below_half"),
        (F.max("size") / F.first("total")).alias("top1"),
        (F.sum(size * F.least(m, F.greatest(10 - larger_n, F.lit(0)))) / F.first("total")).alias("top10"))


def _ln_entropy() -> Column:
    """Shannon entropy in nats; rounding noise below zero is cut."""
    return F.greatest(F.ln("total") - F.col("ln_sum") / F.col("total"), F.lit(0.0))


def _bits() -> Column:
    return _ln_entropy() / F.ln(F.lit(2.0))


def _clonality(entropy: Column, largest: Column) -> Column:
    return F.when(F.col("n") == 1, F.lit(1.0)).otherwise(1 - entropy / largest)


def _gini() -> Column:
    return F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.col("gini"))


def _simpson() -> Column:
    return 1 - F.col("sq")


_INDEX = {
    "shannon": lambda: _bits(),
    "gini": lambda: _gini(),
    "simpson": lambda: _simpson(),
    "d50": lambda: F.col("half") / F.col("n"),
    "clonality": lambda: _clonality(_bits(), F.log2(F.col("n"))),
}


def index(df: DataFrame, name: str, value: str = "templates") -> DataFrame:
    """One index over the template counts; repertoires without any are zero."""
    stats = size_statistics(row_sizes(df, value), keep_empty=True)
    return stats.select(
        *REP, F.coalesce(_INDEX[name](), F.lit(0.0)).alias(name))


def diversity_set(df: DataFrame, count_source: str = "templates") -> DataFrame:
    """All indices; sizes come from a count column, or from sequence multiplicity."""
    hist = sequence_sizes(df) if count_source == "sequence" else row_sizes(df, count_source, ones_if_missing=True)
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return size_statistics(hist, keep_empty=True).select(
        *REP, zero(_bits(), "shannon_entropy"), zero(_gini(), "gini_coefficient"), zero(_simpson(), "simpson_index"),
        zero(F.col("half") / F.col("n"), "d50_index"), zero(_INDEX["clonality"](), "clonality"),
        zero(F.col("n").cast("double"), "n_unique_clones"), zero(F.col("top1"), "top_clone_fraction"),
        zero(F.col("top10"), "top10_clone_fraction"))


def clone_size(df: DataFrame) -> DataFrame:
    """Entropy (smoothed and renormalised), Gini-Simpson and largest share of the template counts."""
    stats = size_statistics(row_sizes(df, coerce_templates("templates")), keep_zero=True).where(F.col("total") > 0)
    s = 1 + F.col("n") * _EPS
    return stats.select(*REP, (F.ln(s) - F.col("eps_norm_sum") / s).alias("clone_entropy"),
                        _simpson().alias("clone_gini"), F.col("top1").alias("clone_max_freq"))


def clone_size_extended(df: DataFrame) -> DataFrame:
    """Smoothed Shannon bits, sum of squares, non-negative Gini, D50, clonality, richness."""
    stats = size_statistics(row_sizes(df, coerce_templates("templates")), keep_zero=True)
    shannon = -F.col("eps_sum") / F.ln(F.lit(2.0))
    largest = F.when(F.col("n") > 1, F.log2(F.col("n"))).otherwise(F.lit(1.0))
    some = F.col("total") > 0
    pick = lambda c, empty, name: F.when(some, c).otherwise(F.lit(empty)).alias(name)
    return stats.select(*REP, pick(shannon, 0.0, "shannon"), pick(F.col("sq"), 1.0, "simpson"),
                        pick(F.greatest(F.lit(0.0), F.col("gini")), 0.0, "gini"),
                        pick(F.col("half") / F.col("n"), 0.0, "d50"), pick(1 - shannon / largest, 0.0, "clonality"),
                        pick(F.col("n").cast("double"), 0.0, "richness"))


def sequence_diversity(df: DataFrame) -> DataFrame:
    """Indices over sequence multiplicity, natural log with smoothing."""
    stats = size_statistics(sequence_sizes(df), keep_empty=True)
    shannon = -F.col("eps_sum")
    largest = F.when(F.col("n") > 1, F.ln(F.col("n"))).otherwise(F.lit(1.0))
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return stats.select(
        *REP, zero(shannon, "shannon"), zero(_simpson(), "gini_simpson"), zero(1 - shannon / largest, "clonality"),
        zero(F.col("half") / F.col("n"), "d50"), F.coalesce("n", F.lit(0)).cast("bigint").alias("richness"),
        zero(F.log1p(F.col("n")), "richness_log"))


def sequence_clonality(df: DataFrame) -> DataFrame:
    """D50 as a number of clones; shares are over all rows, missing sequences included."""
    stats = size_statistics(sequence_sizes(df), over_rows=True)
    clonality = F.when(F.col("n") > 1, 1 - _bits() / F.log2(F.col("n"))).otherwise(F.lit(0.0))
    return stats.select(*REP, _bits().alias("shannon_entropy"), _simpson().alias("gini_simpson"),
                        F.col("half").cast("bigint").alias("d50"), clonality.alias("clonality_score"))


def sequence_clonality_cumulative(df: DataFrame) -> DataFrame:
    """Natural log, D50 as the clones at or under half, plus top share and length summary."""
    stats = size_statistics(sequence_sizes(df))
    clonality = F.when(F.col("n") > 1, 1 - _ln_entropy() / F.ln(F.col("n"))).otherwise(F.lit(0.0))
    length = F.length("junction_aa")
    lengths = df.groupBy(*REP).agg(
        F.avg(length).alias("mean_length"), F.coalesce(F.stddev_samp(length), F.lit(0.0)).alias("std_length"),
        F.min(length).cast("double").alias("min_length"), F.max(length).cast("double").alias("max_length"))
    return stats.join(lengths, REP).select(
        *REP, _ln_entropy().alias("shannon_entropy"), _simpson().alias("gini_simpson"),
        F.col("below_half").cast("double").alias("d50"), clonality.alias("clonality"),
        "mean_length", "std_length", "min_length", "max_length", F.col("top1").alias("top_clone_freq"))


def richness(df: DataFrame) -> DataFrame:
    """Distinct and total alphabetic sequences and their ratio."""
    counts = (df.where(alpha_seq("junction_aa")).groupBy(*REP, "junction_aa").agg(F.count(F.lit(1)).alias("c"))
              .groupBy(*REP).agg(F.count(F.lit(1)).alias("u"), F.sum("c").alias("t")))
    return counts.select(*REP, F.col("u").cast("double").alias("n_unique_seqs"),
                         F.col("t").cast("double").alias("n_total_seqs"), (F.col("u") / F.col("t")).alias("diversity_ratio"))


def clonality_index(df: DataFrame) -> DataFrame:
    """(templates - rows) / (templates - 1), zero without more than one template."""
    t, n = F.coalesce(F.sum("templates"), F.lit(0.0)), F.count(F.lit(1))
    return df.groupBy(*REP).agg(F.when(t > 1, (t - n) / (t - 1)).otherwise(F.lit(0.0)).alias("clonality_index"))
