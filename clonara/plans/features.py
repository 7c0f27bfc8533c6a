"""Feature sets: named lists of parts, each part one long table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from clonara.constants import REP
from clonara.functions.text import dataset_id, finite, metadata_features
from clonara.operators import align, clonotypes, diversity, genes, kmers, lengths
from clonara.session import materialize

NEEDED = [*REP, "junction_aa", "v_call", "j_call", "templates"]


def long_table(wide: DataFrame, prefix: str = "") -> DataFrame:
    """Numeric columns of one row per repertoire as (feature, value) rows; missing ones are left out."""
    names = [c for c in wide.columns if c not in REP]
    cells = F.array(*[F.struct(F.lit(prefix + n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    return wide.select(*REP, F.inline(cells)).where(F.col("value").isNotNull())


@dataclass
class Source:
    """What parts read: rows, mined sequences, metadata and the k-mer lengths."""

    rows: DataFrame
    mined: DataFrame | None = None
    metadata: DataFrame | None = None
    ks: tuple[int, ...] = (3, 4)


def _metadata(s: Source) -> DataFrame | None:
    if s.metadata is None:
        return None
    return metadata_features(s.metadata.withColumn("_number", dataset_id("dataset")), "_number")


def _hits(operator) -> Callable[[Source], DataFrame | None]:
    return lambda s: None if s.mined is None else long_table(operator(s.rows, s.mined))


def _wide(operator, prefix: str = "") -> Callable[[Source], DataFrame]:
    return lambda s: long_table(operator(s.rows), prefix)


def _hashed(s: Source) -> DataFrame:
    stats = kmers.hashed_statistics(s.rows, s.ks)
    cells = F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).alias("value")) for n in ("mean", "std", "max")])
    name = F.concat_ws("_", F.lit("hash"), F.col("k"), F.col("bucket"), F.col("stat"))
    return stats.select(*REP, "k", "bucket", F.inline(cells)).select(*REP, name.alias("feature"), "value")


PARTS: dict[str, Callable[[Source], DataFrame | None]] = {
    "kmer_shares": lambda s: kmers.kmer_frequencies(s.rows, s.ks),
    "kmer_shares_raw": lambda s: kmers.kmer_frequencies(s.rows, s.ks, valid_only=False, prefix="k{k}_"),
    "kmer_counts": lambda s: kmers.kmer_multiscale(s.rows, s.ks),
    "kmer_hashes": _hashed,
    "ends": lambda s: kmers.positional_kmers(s.rows),
    "chemistry": _wide(lengths.physchem),
    "atchley": _wide(lengths.atchley),
    "families": lambda s: genes.family_usage(s.rows),
    "family_pairs": lambda s: genes.family_pairs(s.rows),
    "families_known": lambda s: genes.family_pair_usage(s.rows),
    "calls": lambda s: genes.raw_usage(s.rows),
    "calls_50": lambda s: genes.raw_usage_pairs(s.rows),
    "calls_only": lambda s: genes.top_calls(s.rows),
    "lengths": _wide(lengths.length_stats),
    "length_shares": _wide(lengths.length_distribution),
    "length_shape": _wide(lengths.length_shape),
    "lengths_all": _wide(lengths.length_stats_full),
    "sequence_stats": lambda s: lengths.sequence_stats(s.rows),
    "richness": _wide(diversity.richness),
    "clone_size": _wide(diversity.clone_size),
    "clone_size_more": _wide(diversity.clone_size_extended, "div_"),
    "sequence_diversity": _wide(diversity.sequence_diversity),
    "sequence_clonality": _wide(diversity.sequence_clonality),
    "sequence_clonality_more": _wide(diversity.sequence_clonality_cumulative),
    "metadata": _metadata,
    "hits": _hits(clonotypes.public_hits),
    "hits_signed": _hits(clonotypes.public_hits_signed),
    "hits_significant": _hits(clonotypes.public_hits_significant),
}

_BASE = ["kmer_shares", "ends", "chemistry", "families", "lengths", "richness", "clone_size", "metadata"]
SETS: dict[str, list[str]] = {
    "base": [*_BASE, "hits"],
    "significant": [*_BASE, "hits_significant"],
    "extended": ["kmer_shares", "ends", "atchley", "chemistry", "families", "lengths", "richness", "clone_size_more", "metadata", "hits_signed"],
    "pairs": ["kmer_shares", "ends", "chemistry", "families", "family_pairs", "length_shares", "richness", "clone_size", "metadata", "hits"],
    "counts": ["kmer_counts", "calls", "sequence_clonality", "length_shape"],
    "stacked": ["kmer_counts", "families_known", "sequence_diversity", "lengths_all"],
    "usage": ["kmer_counts", "calls_50", "sequence_clonality_more"],
    "simple": ["kmer_shares_raw", "calls_only", "lengths_all"],
    "hashed": ["kmer_hashes", "sequence_stats"],
}


def extract_features(rows: DataFrame, mined: DataFrame | None = None, metadata: DataFrame | None = None, ks=(3, 4),
                     feature_set: str = "base") -> DataFrame:
    """(dataset, repertoire_id, feature, value) of a named set; every value is finite.

    The few columns that parts read become a stage of their own, so that the source, which may be text or a join, is
    read once however many parts there are.
    """
    narrow = materialize(rows.select(*[c for c in NEEDED if c in rows.columns]), "rows")
    source = Source(narrow, mined, metadata, tuple(ks))
    parts = [PARTS[name](source) for name in SETS[feature_set]]
    return align.union_all([p for p in parts if p is not None]).select(*REP, "feature", finite("value").alias("value"))
