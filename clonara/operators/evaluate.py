"""Scores of predictions and sequence lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clonara.operators.ranks import counts_below, unit_bin

_EPS = 2.220446049250313e-16


def roc_auc(df: DataFrame, group: list[str], label: str = "label_positive", score: str = "p") -> DataFrame:
    """Exact tie-aware area under the ROC curve per group.

    Rows fold to distinct scores. Negatives below a score are those in lower value bins
    plus those below it in its own bin, so no task ever sorts a whole group.
    """
    y = F.col(label).cast("boolean")
    hist = df.groupBy(*group, F.col(score).alias("s")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    ranked = counts_below(hist, group, "s", ["neg"], unit_bin("s"))
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    return ranked.groupBy(*group).agg((wins / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def log_loss(df: DataFrame, group: list[str], label: str = "label_positive", score: str = "p") -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(_EPS)), F.lit(1 - _EPS))
    return df.groupBy(*group).agg(F.avg(F.when(F.col(label).cast("boolean"), -F.ln(p)).otherwise(-F.ln(1 - p))).alias("log_loss"))


def balanced_accuracy(df: DataFrame, group: list[str], label: str = "label_positive", score: str = "p",
                      threshold: float = 0.5) -> DataFrame:
    """Mean of the two class recalls."""
    y, hit = F.col(label).cast("boolean"), F.col(score) >= threshold
    recall = lambda right, of: F.count_if(right & of) / F.nullif(F.count_if(of), F.lit(0))
    return df.groupBy(*group).agg(((recall(hit, y) + recall(~hit, ~y)) / 2).alias("balanced_accuracy"))


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation as an aggregate; missing when either side is constant."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0))


def jaccard(a: DataFrame, b: DataFrame, on: list[str], group: list[str]) -> DataFrame:
    """Overlap over union of two sets per group."""
    sides = a.select(*on, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*on, F.lit(0).alias("x"), F.lit(1).alias("y")))
    items = sides.groupBy(*on).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return items.groupBy(*group).agg((F.sum(F.col("x") * F.col("y")) / F.count(F.lit(1))).alias("jaccard"))


def combined_score(scores: DataFrame, value: str = "value", weight: str = "weight") -> DataFrame:
    """Weighted mean over datasets and both measures."""
    w = F.col(weight)
    return scores.where(F.col(value).isNotNull()).agg((F.sum(F.col(value) * w) / F.sum(w)).alias("combined_score"))
