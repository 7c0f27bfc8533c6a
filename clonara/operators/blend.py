"""Weighted blends of two submissions and reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clonara.constants import BLEND_WEIGHT, BLEND_WEIGHT_DEFAULT
from clonara.functions.text import dataset_id
from clonara.operators.align import join_submissions


def _blended(pairs: DataFrame, weight: Column) -> DataFrame:
    return pairs.select("ID", "dataset", (F.col("p_a") * weight + F.col("p_b") * (1 - weight)).alias("label_positive_probability"))


def blend_global(a: DataFrame, b: DataFrame, weight: float = 0.9) -> DataFrame:
    return _blended(join_submissions(a, b), F.lit(weight))


def blend_by_dataset(a: DataFrame, b: DataFrame, weights: dict[int, float] | None = None,
                     default: float = BLEND_WEIGHT_DEFAULT) -> DataFrame:
    """Weight of the first submission by dataset number."""
    w = F.lit(default)
    for number, value in (BLEND_WEIGHT if weights is None else weights).items():
        w = F.when(dataset_id("dataset") == number, F.lit(value)).otherwise(w)
    return _blended(join_submissions(a, b), w)


def blend_drift(a: DataFrame, blended: DataFrame, large: float = 0.05) -> DataFrame:
    """Mean and largest change, and how many changed by more than ``large``."""
    d = F.abs(F.col("p") - F.col("q"))
    pairs = (a.select("ID", F.col("label_positive_probability").alias("p"))
             .join(blended.select("ID", F.col("label_positive_probability").alias("q")), "ID"))
    return pairs.agg(F.avg(d).alias("mean_diff"), F.max(d).alias("max_diff"), F.count_if(d > large).alias("n_large"))
