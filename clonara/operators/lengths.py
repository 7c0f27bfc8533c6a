"""Sequence lengths and physico-chemical summaries.

Lengths fold to (repertoire, length, rows) before any percentile or moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clonara.constants import AMINO_ACIDS, ATCHLEY, ATCHLEY_NAMES, CHARGE, HYDROPATHY, REP, VOLUME
from clonara.functions.text import alpha_seq, loose_aa
from clonara.operators.kmers import aa_composition


def length_counts(df: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Rows per length; ``keep_empty`` leaves a zero row for repertoires without sequences."""
    rows = df if keep_empty else df.where(F.col("junction_aa").isNotNull())
    return rows.groupBy(*REP, F.length("junction_aa").alias("l")).agg(F.count("junction_aa").alias("c"))


def _n() -> Column:
    return F.nullif(F.sum("c"), F.lit(0))


def _moment(power: int) -> Column:
    return F.sum(F.pow(F.col("l").cast("double"), F.lit(power)) * F.col("c"))


def _mean() -> Column:
    return _moment(1) / _n()


def _variance() -> Column:
    """Population variance from integer sums, exactly zero for equal lengths."""
    return (_n() * _moment(2) - _moment(1) * _moment(1)) / (_n() * _n())


def _quantile(q: float) -> Column:
    return F.percentile("l", F.lit(q), F.col("c"))


def _least() -> Column:
    return F.min("l").cast("double")


def _most() -> Column:
    return F.max("l").cast("double")


def length_weighted(df: DataFrame, weight: str = "templates") -> DataFrame:
    """Statistics with each row weighted by its templates (missing weight is one)."""
    w = F.coalesce(F.col(weight), F.lit(1.0))
    ok = (F.length("junction_aa") > 0) & (w > 0)
    hist = df.groupBy(*REP, F.when(ok, F.length("junction_aa")).alias("l")).agg(F.sum(F.when(ok, w)).alias("c"))
    whole = Window.partitionBy(*REP)
    hist = (hist.withColumn("total", F.sum("c").over(whole))
            .withColumn("up", F.sum("c").over(whole.orderBy("l").rowsBetween(Window.unboundedPreceding, 0))))
    p = F.col("c") / F.col("total")
    stats = hist.groupBy(*REP).agg(
        _mean().alias("mean_cdr3_length"), F.sqrt(F.greatest(_variance(), F.lit(0.0))).alias("std_cdr3_length"),
        F.min(F.when(F.col("up") >= F.col("total") / 2, F.col("l"))).cast("double").alias("median_cdr3_length"),
        _least().alias("min_cdr3_length"), _most().alias("max_cdr3_length"),
        (-F.sum(p * F.log2(p))).alias("cdr3_length_entropy"))
    names = [c for c in stats.columns if c not in REP]
    return stats.na.fill(0.0, names)


def length_stats(df: DataFrame) -> DataFrame:
    """Alphabetic sequences: mean, population deviation, extremes and quartiles."""
    return length_counts(df.where(alpha_seq("junction_aa"))).groupBy(*REP).agg(
        _mean().alias("len_mean"), F.sqrt(_variance()).alias("len_std"), _least().alias("len_min"), _most().alias("len_max"),
        _quantile(0.25).alias("len_p25"), _quantile(0.75).alias("len_p75"))


def length_distribution(df: DataFrame) -> DataFrame:
    """The above with the median, shares of lengths 10..15 and of short and long sequences."""
    share = lambda cond: F.sum(F.when(cond, F.col("c")).otherwise(0)) / _n()
    l = F.col("l")
    return length_counts(df.where(alpha_seq("junction_aa"))).groupBy(*REP).agg(
        _mean().alias("len_mean"), F.sqrt(_variance()).alias("len_std"), _least().alias("len_min"), _most().alias("len_max"),
        _quantile(0.25).alias("len_p25"), _quantile(0.5).alias("len_p50"), _quantile(0.75).alias("len_p75"),
        *[share(l == n).alias(f"len_freq_{n}") for n in range(10, 16)],
        share(l <= 11).alias("len_short_ratio"), share(l >= 15).alias("len_long_ratio"))


def length_shape(df: DataFrame) -> DataFrame:
    """Mean, sample deviation, quartiles, population skewness and excess kurtosis."""
    mu, e2, e3, e4 = _mean(), _moment(2) / _n(), _moment(3) / _n(), _moment(4) / _n()
    var = _variance()
    m3 = e3 - 3 * mu * e2 + 2 * mu * mu * mu
    m4 = e4 - 4 * mu * e3 + 6 * mu * mu * e2 - 3 * mu * mu * mu * mu
    spread = var > 0
    stats = length_counts(df, keep_empty=True).groupBy(*REP).agg(
        mu.alias("cdr3_length_mean"),
        F.when(_n() > 1, F.sqrt(var * _n() / (_n() - 1))).alias("cdr3_length_std"),
        _quantile(0.5).alias("cdr3_length_median"), _quantile(0.25).alias("cdr3_length_q25"),
        _quantile(0.75).alias("cdr3_length_q75"),
        F.when(spread, m3 / F.pow(var, F.lit(1.5))).alias("cdr3_length_skewness"),
        F.when(spread, m4 / (var * var) - 3).alias("cdr3_length_kurtosis"))
    names = [c for c in stats.columns if c not in REP]
    return stats.na.fill(0.0, names)


def length_stats_full(df: DataFrame) -> DataFrame:
    """All non-missing sequences; repertoires without any are zero."""
    stats = length_counts(df, keep_empty=True).groupBy(*REP).agg(
        _mean().alias("len_mean"), F.sqrt(_variance()).alias("len_std"), _quantile(0.5).alias("len_median"),
        _quantile(0.25).alias("len_q25"), _quantile(0.75).alias("len_q75"), _least().alias("len_min"), _most().alias("len_max"))
    names = [c for c in stats.columns if c not in REP]
    return stats.na.fill(0.0, names)


def sequence_stats(df: DataFrame) -> DataFrame:
    """Counts and length summary of loosely valid sequences plus letter shares, as features."""
    stats = length_counts(df.where(loose_aa("junction_aa"))).groupBy(*REP).agg(
        _n().cast("double").alias("n"), _mean().alias("mean"), F.sqrt(_variance()).alias("std"), _least().alias("min"),
        _most().alias("max"), _quantile(0.25).alias("p25"), _quantile(0.5).alias("p50"), _quantile(0.75).alias("p75"))
    names = [c for c in stats.columns if c not in REP]
    long = stats.select(*REP, F.inline(F.array(*[
        F.struct(F.lit(f"len_{c}").alias("feature"), F.col(c).alias("value")) for c in names])))
    letters = aa_composition(df).select(*REP, F.concat(F.lit("aa_"), "letter").alias("feature"), "value")
    return long.unionByName(letters)


def repertoire_basics(df: DataFrame, count_col: str | None = "templates") -> DataFrame:
    """Rows with a sequence, summed counts and length summary; a missing sequence reads ``nan``."""
    l = F.length(F.coalesce("junction_aa", F.lit("nan")))
    total = F.coalesce(F.sum(count_col), F.lit(0.0)) if count_col else F.count(F.lit(1)).cast("double")
    return df.groupBy(*REP).agg(
        F.count("junction_aa").alias("seq_count"), total.alias("total_count"), F.avg(l).alias("len_mean"),
        F.stddev_samp(l).alias("len_std"), F.max(l).cast("bigint").alias("len_max"))


def _codes(df: DataFrame) -> DataFrame:
    """Character codes of each alphabetic sequence (null for others)."""
    letters = F.split(F.when(alpha_seq("junction_aa"), F.col("junction_aa")), "")
    return df.select(*REP, F.transform(letters, lambda c: F.ascii(c)).alias("_codes"))


def _sum_of(values: dict[str, float]) -> Column:
    """Sum of a per-letter value, read from a table by character code; unknown letters add nothing."""
    table = F.lit([float(values.get(chr(i), 0.0)) for i in range(128)])
    return F.aggregate("_codes", F.lit(0.0), lambda acc, c: acc + F.coalesce(F.get(table, c), F.lit(0.0)))


def _letter_means(df: DataFrame, properties: dict[str, dict[str, float]]) -> DataFrame:
    """Mean of each property over the known letters of a sequence; null when there is none."""
    known = F.nullif(_sum_of(dict.fromkeys(AMINO_ACIDS, 1.0)), F.lit(0.0))
    sums = _codes(df).select(*REP, known.alias("_known"), *[_sum_of(v).alias(f"_{n}") for n, v in properties.items()])
    return sums.select(*REP, *[(F.col(f"_{n}") / F.col("_known")).alias(n) for n in properties])


def physchem(df: DataFrame) -> DataFrame:
    """Mean and deviation over sequences of mean hydropathy and volume, and mean charge."""
    per_seq = _letter_means(df, {"h": HYDROPATHY, "v": VOLUME, "c": CHARGE})
    return per_seq.groupBy(*REP).agg(
        F.avg("h").alias("phys_hydro_mean"), F.stddev_pop("h").alias("phys_hydro_std"), F.avg("v").alias("phys_vol_mean"),
        F.stddev_pop("v").alias("phys_vol_std"), F.avg("c").alias("phys_charge_mean")).where(F.col("phys_hydro_mean").isNotNull())


def atchley(df: DataFrame) -> DataFrame:
    """Five factor means per sequence, summarised per repertoire; empty has only mean and deviation."""
    factors = {n: {a: f[i] for a, f in ATCHLEY.items()} for i, n in enumerate(ATCHLEY_NAMES)}
    per_seq = _letter_means(df, factors)
    aggs = []
    for n in ATCHLEY_NAMES:
        aggs += [F.avg(n).alias(f"atchley_{n}_mean"), F.stddev_pop(n).alias(f"atchley_{n}_std"),
                 F.min(n).alias(f"atchley_{n}_min"), F.max(n).alias(f"atchley_{n}_max")]
    return per_seq.groupBy(*REP).agg(*aggs).na.fill(0.0, [f"atchley_{n}_{s}" for n in ATCHLEY_NAMES for s in ("mean", "std")])
