"""Joins, set operations and alignment of features, labels and submissions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from clonara.constants import REP, SENTINEL, SENTINEL_PROBABILITY, SUBMISSION_COLUMNS
from clonara.operators.ranks import densify


def align_labels(features: DataFrame, labels: DataFrame, on: list[str] = REP, check: bool = False) -> DataFrame:
    """Features of repertoires that have a label; ``check`` fails when none has."""
    out = features.join(labels.select(*on, "label_positive"), on)
    if check and out.isEmpty():
        raise ValueError("features and labels share no repertoire")
    return out


def unique_by(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per key; the job fails when a key repeats."""
    n = F.count(F.lit(1))
    kept = [F.first(c).alias(c) for c in columns]
    repeated = F.raise_error(F.concat(F.lit(f"repeated {key}: "), F.col(key).cast("string")))
    return (df.groupBy(key).agg(*kept, n.alias("_n"))
            .where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(repeated.cast("boolean"))).drop("_n"))


def task_a(submission: DataFrame) -> DataFrame:
    """Prediction rows: a probability, or a sequence column holding the sentinel."""
    return submission.where((F.col("label_positive_probability") != SENTINEL_PROBABILITY)
                            | (F.col("junction_aa").try_cast("double") == SENTINEL_PROBABILITY))


def task_b(submission: DataFrame) -> DataFrame:
    """Sequence rows."""
    return submission.where((F.col("label_positive_probability") == SENTINEL_PROBABILITY)
                            & ~F.coalesce(F.col("junction_aa").try_cast("double") == SENTINEL_PROBABILITY, F.lit(False)))


def join_submissions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Probabilities of two submissions side by side, matched on ID only."""
    right = unique_by(task_a(b), "ID", "label_positive_probability").withColumnRenamed("label_positive_probability", "p_b")
    left = unique_by(task_a(a), "ID", "dataset", "label_positive_probability").withColumnRenamed("label_positive_probability", "p_a")
    return left.join(right, "ID")


def align_features(features: DataFrame, vocabulary: DataFrame, repertoires: DataFrame) -> DataFrame:
    """Exactly the training features for every repertoire: absent ones zero, extra ones dropped."""
    return densify(features, repertoires, vocabulary, REP, ["feature"])


def members(df: DataFrame, listed: DataFrame, on: list[str]) -> DataFrame:
    return df.join(listed, on, "left_semi")


def non_members(df: DataFrame, listed: DataFrame, on: list[str]) -> DataFrame:
    return df.join(listed, on, "left_anti")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Concatenate by name; columns a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def crosstab(df: DataFrame, row: str, column: str, values: list, by: list[str] = ()) -> DataFrame:
    """Share of each column value per row value."""
    counts = [F.count_if(F.col(column) == v) for v in values]
    total = F.count(column)
    shares = [(c / F.nullif(total, F.lit(0))).alias(f"{column}_{str(v).lower()}") for c, v in zip(counts, values)]
    return df.where(F.col(row).isNotNull()).groupBy(*by, row).agg(*shares)


def pivot_features(features: DataFrame, names: list[str]) -> DataFrame:
    """Long to wide over a selected list of features, absent values zero."""
    wide = features.groupBy(*REP).pivot("feature", names).agg(F.first("value"))
    return wide.na.fill(0.0, names)


def submission_rows(df: DataFrame, probability: Column | None = None, sequence: bool = False) -> DataFrame:
    """Lay a result out in the output columns, filling what it lacks with the sentinel."""
    text = lambda c: (F.coalesce(F.col(c), F.lit(SENTINEL)) if c in df.columns else F.lit(SENTINEL)).alias(c)
    p = F.lit(SENTINEL_PROBABILITY) if sequence else probability
    return df.select("ID", "dataset", p.cast("double").alias("label_positive_probability"),
                     text("junction_aa"), text("v_call"), text("j_call"))


def build_submission(predictions: DataFrame, sequences: DataFrame) -> DataFrame:
    """Predictions and ranked sequences as one table in the expected column order."""
    return predictions.unionByName(sequences).select(*SUBMISSION_COLUMNS)
