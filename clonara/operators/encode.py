"""Fixed-size integer encodings of sequences and bags."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clonara.constants import REP
from clonara.functions.text import encode_tokens
from clonara.operators.sampling import uniform_sample


def encode_bags(df: DataFrame, n: int, key: list[str], max_len: int = 20, seed: int = 42) -> DataFrame:
    """One row per repertoire: ``n`` encoded sequences, sampled when there are more, padded with zeros."""
    rows = df.where(F.col("junction_aa").isNotNull())
    drawn = uniform_sample(rows, n, ["junction_aa", *key], seed).select(*REP, encode_tokens("junction_aa", max_len).alias("t"))
    blank = F.array_repeat(F.lit(0), F.lit(max_len))
    # a bag never holds more than n sequences here
    packed = drawn.groupBy(*REP).agg(F.collect_list("t").alias("ts"))
    return packed.select(*REP, F.concat("ts", F.array_repeat(blank, n - F.size("ts"))).alias("tokens"))
