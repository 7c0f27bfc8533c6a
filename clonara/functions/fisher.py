"""Fisher's exact test with built-in expressions, once for every different table.

Callers filter by frequency first, so only sequences shared by several repertoires are tested.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from clonara.session import materialize

TABLE = ["n_pos", "n_neg", "pos", "neg"]


def log_factorial(x: Column) -> Column:
    """Natural logarithm of x!, exact below 16 and by Stirling's series (error under 1e-12) from there."""
    v = x.cast("double")
    small = F.get(F.lit([math.lgamma(i + 1.0) for i in range(16)]), x.cast("int"))
    inverse = 1.0 / v
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680)))
    return F.when(x < 16, small).otherwise(v * F.ln(v) - v + 0.5 * F.ln(2 * math.pi * v) + series)


def _tested(tables: DataFrame, alternative: str) -> DataFrame:
    lf = log_factorial
    a, c, n_pos, n_neg = F.col("pos"), F.col("neg"), F.col("n_pos"), F.col("n_neg")
    b, d, hits = n_pos - a, n_neg - c, a + c
    # log P(x) = base - the four factorials that change with x
    base = lf(n_pos) + lf(n_neg) + lf(hits) + lf(b + d) - lf(n_pos + n_neg)
    log_p = lambda x: F.col("_base") - lf(x) - lf(n_pos - x) - lf(hits - x) - lf(n_neg - hits + x)
    hi = F.least(n_pos, hits)
    if alternative == "greater":
        terms = F.transform(F.sequence(a, hi), log_p)
    else:
        lo = F.greatest(F.lit(0).cast("bigint"), hits - n_neg)
        terms = F.filter(F.transform(F.sequence(lo, hi), log_p), lambda v: v <= F.col("_seen") + math.log1p(1e-7))
    p = F.aggregate("_terms", F.lit(0.0), lambda acc, v: acc + F.exp(v))
    empty = (n_pos == 0) | (n_neg == 0) | (hits == 0) | (b + d == 0)
    odds = (F.when(empty, F.lit(float("nan"))).when((b > 0) & (c > 0), a * d / F.nullif(b * c, F.lit(0)))
            .otherwise(F.lit(float("inf"))))
    return (tables.withColumn("_base", base).withColumn("_seen", log_p(a)).withColumn("_terms", terms)
            .withColumn("odds_ratio", odds)
            .withColumn("p_value", F.when(empty, F.lit(1.0)).otherwise(F.least(p, F.lit(1.0))))
            .drop("_base", "_seen", "_terms"))


def with_fisher(tables: DataFrame, alternative: str = "two-sided") -> DataFrame:
    """Add ``odds_ratio`` and ``p_value`` of [[pos, n_pos-pos], [neg, n_neg-neg]].

    Many sequences have the same counts, so each different table is tested once and joined back. The candidates are
    a stage of their own, as both sides of that join read them. An empty margin has no odds ratio and p = 1.
    """
    tables = materialize(tables, "tables")
    return tables.join(_tested(tables.select(*TABLE).distinct(), alternative), TABLE)
