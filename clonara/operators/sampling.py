"""Deterministic samples and limits: every random choice is a seeded hash of the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clonara.constants import REP
from clonara.functions.text import coerce_templates
from clonara.operators.ranks import top_k


def uniform(cols: list[str], seed: int) -> Column:
    """A number in (0, 1) fixed by the row's columns and the seed: 48 bits of a digest that other engines have too."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / float(2 ** 48)


def weighted_sample(df: DataFrame, n: int, key: list[str], weight: str = "templates", seed: int = 42) -> DataFrame:
    """At most ``n`` rows per repertoire without replacement, likelier with more templates.

    Each row draws an exponential waiting time with its weight as rate and the smallest
    win; rows of weight zero come last, so a repertoire of zero weights is sampled evenly.
    """
    u, w = uniform([*REP, *key], seed), coerce_templates(weight)
    wait = F.when(w > 0, -F.ln(u) / F.nullif(w, F.lit(0.0))).otherwise(F.lit(float("inf")))
    rows = df.withColumn("_wait", wait).withColumn("_u", u)
    return top_k(rows, REP, [F.asc("_wait"), F.asc("_u"), *[F.asc(k) for k in key]], n, salt_on=[*REP, *key]).drop("_wait", "_u")


def uniform_sample(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """At most ``n`` rows per repertoire, all equally likely."""
    rows = df.withColumn("_u", uniform([*REP, *key], seed))
    return top_k(rows, REP, [F.asc("_u"), *[F.asc(k) for k in key]], n, salt_on=[*REP, *key]).drop("_u")


def order_columns(metadata: DataFrame) -> list[str]:
    """The column of file order, where there is one."""
    return [c for c in metadata.columns if c == "file_order"]


def first_repertoires(metadata: DataFrame, n: int | None, order: str | None = None, by_label: bool = True) -> DataFrame:
    """The first ``n`` repertoires of each dataset (and class) by ``order``: file order where the metadata has it, else the id."""
    group = ["dataset", "label_positive"] if by_label else ["dataset"]
    order = order or ("file_order" if "file_order" in metadata.columns else "repertoire_id")
    return metadata if n is None else top_k(metadata, group, [F.asc(order), F.asc("repertoire_id")], n)


def top_rows(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """Global top ``k``: each task keeps ``k`` rows, the driver-side plan merges them."""
    return df.orderBy(*order).limit(k)
