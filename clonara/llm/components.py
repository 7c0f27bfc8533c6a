"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonara.llm.common import stage


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) for every node of the links (a, b) but the roots; root is the least node connected to it.

    Each round links all larger neighbours of a node to its least neighbour, then all smaller ones. The number of
    rounds grows with the logarithm of the longest chain. Every round is a table in the shared folder. Loops and
    repeated links do no harm; rows with a null end are left out.
    """
    edges = stage(
        links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("n"), F.least("u", "low").alias("low"))
        large = both.join(low, both["u"] == low["n"]).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low")).withColumnRenamed("u", "n")
        small = large.join(low, large["u"] == low["n"]).select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v"))
        edges = stage(small.filter(F.col("u") != F.col("v")).distinct(), name)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0
