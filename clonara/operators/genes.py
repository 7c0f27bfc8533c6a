"""V, J and V-J pair usage.

Every variant starts from one grouped count over (repertoire, kind, gene); shares and
ranks then run over a few hundred genes per repertoire.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from clonara.constants import REP
from clonara.functions.text import gene_family, gene_family_alt, gene_norm, gene_sanitize
from clonara.operators.ranks import densify, top_k

_KIND = [*REP, "kind"]
from clonara.session import materialize


def gene_counts(df: DataFrame, kinds: dict[str, Column], keys: list[str] = REP) -> DataFrame:
    """Rows per gene of each kind, all kinds in one shuffle; a missing gene keeps its count."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("gene")) for k, c in kinds.items()])
    return df.select(*keys, F.inline(pairs)).groupBy(*keys, "kind", "gene").agg(F.count(F.lit(1)).alias("n"))


def _share(counts: DataFrame) -> DataFrame:
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*_KIND)))


def _head(counts: DataFrame, keep: dict[str, int]) -> DataFrame:
    """Most frequent genes of each kind; missing genes are not ranked."""
    w = Window.partitionBy(*_KIND).orderBy(F.desc("n"), F.asc("gene"))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in keep.items() for x in kv]), F.col("kind"))
    return (counts.where(F.col("gene").isNotNull()).withColumn("_r", F.row_number().over(w))
            .where(F.col("_r") <= limit).drop("_r"))


def _features(shares: DataFrame, prefix: dict[str, str] | None = None) -> DataFrame:
    if prefix:
        head = F.element_at(F.create_map(*[F.lit(x) for kv in prefix.items() for x in kv]), F.col("kind"))
    else:
        head = F.concat(F.col("kind"), F.lit("_"))
    return shares.select(*REP, F.concat(head, "gene").alias("feature"), F.col("share").alias("value"))


def _norm_kinds() -> dict[str, Column]:
    v, j = gene_norm("v_call"), gene_norm("j_call")
    pair = F.concat_ws("_", v, j)
    known = lambda c: F.when(c != "UNKNOWN", c)
    return {"v": known(v), "j": known(j), "vj": F.when(~F.contains(pair, F.lit("UNKNOWN")), pair)}


def usage(df: DataFrame, kind: str, normalize: bool = True) -> DataFrame:
    """Gene usage without unknown genes (``kind`` is ``v`` or ``j``)."""
    counts = gene_counts(df, {kind: _norm_kinds()[kind]}).where(F.col("gene").isNotNull())
    out = _share(counts) if normalize else counts.withColumn("share", F.col("n").cast("double"))
    return out.select(*REP, "gene", F.col("share").alias("value"))


def pair_usage(df: DataFrame, keep: int | None = 50, normalize: bool = True) -> DataFrame:
    """V-J pairs without unknowns; the most frequent are kept first, then shares are taken among them."""
    counts = gene_counts(df, {"vj": _norm_kinds()["vj"]}).where(F.col("gene").isNotNull())
    if keep is not None:
        counts = _head(counts, {"vj": keep})
    out = _share(counts) if normalize else counts.withColumn("share", F.col("n").cast("double"))
    return out.select(*REP, F.col("gene").alias("pair"), F.col("share").alias("value"))


def gene_vocabulary(df: DataFrame, keep: dict[str, int] | None = None) -> DataFrame:
    """Most frequent V genes, J genes and pairs over all repertoires, ranked per kind."""
    keep = keep or {"v": 50, "j": 15, "vj": 100}
    pooled = gene_counts(df, _norm_kinds(), keys=[]).where(F.col("gene").isNotNull())
    ranked = top_k(pooled, ["kind"], [F.desc("n"), F.asc("gene")], max(keep.values()), rank="rank")
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in keep.items() for x in kv]), F.col("kind"))
    return ranked.where(F.col("rank") <= limit)


def gene_transform(df: DataFrame, vocabulary: DataFrame, repertoires: DataFrame | None = None) -> DataFrame:
    """Shares over all known genes of each kind, read at the vocabulary's genes."""
    counts = gene_counts(df, _norm_kinds()).where(F.col("gene").isNotNull())
    shares = _share(counts).select(*_KIND, "gene", F.col("share").alias("value"))
    shares = shares.join(vocabulary.select("kind", "gene"), ["kind", "gene"])
    return shares if repertoires is None else densify(shares, repertoires, vocabulary, REP, ["kind", "gene"])


@dataclass
class GeneFeaturizer:
    """Learns the common genes, then turns repertoires into usage over them."""

    top_v: int = 50
    top_j: int = 15
    top_vj: int = 100
    vocabulary: DataFrame | None = field(default=None, repr=False)

    def fit(self, df: DataFrame) -> "GeneFeaturizer":
        self.vocabulary = materialize(gene_vocabulary(df, {"v": self.top_v, "j": self.top_j, "vj": self.top_vj}), "genes")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.vocabulary is None:
            raise ValueError("call fit first")
        return gene_transform(df, self.vocabulary, df.select(*REP).distinct())

    def feature_names(self) -> DataFrame:
        return self.vocabulary.select(F.concat_ws("_", "kind", "gene").alias("feature"), "kind", "rank")


def gene_diversity(df: DataFrame) -> DataFrame:
    """Shannon (natural log), Simpson and Gini of V and J usage."""
    kinds = {k: c for k, c in _norm_kinds().items() if k != "vj"}
    shares = _share(gene_counts(df, kinds).where(F.col("gene").isNotNull()))
    order = Window.partitionBy(*_KIND).orderBy("n", "gene")
    p = F.col("share")
    n = F.count(F.lit(1))
    return shares.withColumn("_i", F.row_number().over(order)).groupBy(*_KIND).agg(
        (-F.sum(p * F.ln(p + 1e-10))).alias("shannon"), (1 - F.sum(p * p)).alias("simpson"),
        (2 * F.sum(F.col("_i") * p) / (n * F.sum(p)) - (n + 1) / n).alias("gini"))


def family_usage(df: DataFrame, keep: dict[str, int] | None = None) -> DataFrame:
    """Family shares over all rows, unknown included; cut to the most frequent afterwards."""
    counts = gene_counts(df, {"v_fam": gene_family("v_call"), "j_fam": gene_family("j_call")})
    return _features(_head(_share(counts), keep or {"v_fam": 40, "j_fam": 20}))


def family_pairs(df: DataFrame, keep: int = 30) -> DataFrame:
    """Most frequent family pairs plus number of pairs, their entropy and the top share."""
    pair = F.concat_ws("_", gene_family("v_call"), gene_family("j_call"))
    shares = _share(gene_counts(df, {"vj_pair": pair}))
    a = F.col("share") + 1e-10
    totals = shares.groupBy(*REP).agg(
        F.count(F.lit(1)).cast("double").alias("unique"),
        (F.ln(F.sum(a)) - F.sum(a * F.ln(a)) / F.sum(a)).alias("entropy"), F.max("share").alias("top1"))
    extra = totals.select(*REP, F.inline(F.array(*[
        F.struct(F.lit(f"vj_pair_{c}").alias("feature"), F.col(c).alias("value")) for c in ("unique", "entropy", "top1")])))
    return _features(_head(shares, {"vj_pair": keep})).unionByName(extra)


def raw_usage(df: DataFrame, keep: dict[str, int] | None = None, drop_unknown: bool = False) -> DataFrame:
    """Unmodified calls over all rows (missing ones included in the denominator)."""
    both = F.col("v_call").isNotNull() & F.col("j_call").isNotNull()
    kinds = {"v_usage": F.col("v_call"), "j_usage": F.col("j_call"),
             "vj_pair": F.when(both, F.concat_ws("_", gene_sanitize("v_call"), gene_sanitize("j_call")))}
    out = _head(_share(gene_counts(df, kinds)), keep or {"v_usage": 20, "j_usage": 20, "vj_pair": 50})
    if drop_unknown:
        out = out.where((F.col("gene") != "unknown") & ~F.col("gene").rlike("^unknown_|_unknown$"))
    return _features(out)


def raw_usage_pairs(df: DataFrame, keep: int = 50) -> DataFrame:
    """As above with 50 of each; a missing call is spelled ``nan`` inside a pair and kept."""
    pair = F.concat_ws("_", F.coalesce("v_call", F.lit("nan")), F.coalesce("j_call", F.lit("nan")))
    kinds = {"v": F.col("v_call"), "j": F.col("j_call"), "vj": pair}
    return _features(_head(_share(gene_counts(df, kinds)), dict.fromkeys(kinds, keep)))


def family_pair_usage(df: DataFrame) -> DataFrame:
    """Alternate families and their pairs, each over its own known total."""
    v, j = gene_family_alt("v_call"), gene_family_alt("j_call")
    kinds = {"v": v, "j": j, "vj": F.when(v.isNotNull() & j.isNotNull(), F.concat_ws("_", v, j))}
    return _features(_share(gene_counts(df, kinds).where(F.col("gene").isNotNull())))


def top_calls(df: DataFrame, keep: int = 20) -> DataFrame:
    """Most frequent V and J calls over all rows, no pairs."""
    kinds = {"v": F.col("v_call"), "j": F.col("j_call")}
    return _features(_head(_share(gene_counts(df, kinds)), dict.fromkeys(kinds, keep)))
