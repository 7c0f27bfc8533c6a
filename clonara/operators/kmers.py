"""k-mer counting, vocabularies and derived features.

The rows of a repertoire meet once and its windows are counted there, without a shuffle of windows. Of a very large
repertoire each task folds its own rows to (repertoire, k, k-mer) before the shuffle, so it stays spread out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clonara.constants import AMINO_ACIDS, REP
from clonara.functions.text import STRICT, alpha_seq, loose_aa
from clonara.operators import windows as blocks
from clonara.operators.align import union_all
from clonara.operators.ranks import dense_numbers, densify, top_k
from clonara.session import materialize

# a k-mer list of at most this many rows (some tens of bytes each) may be broadcast
BROADCAST_ROWS = 200_000


def windows(seq: Column, k: int) -> Column:
    """All windows of length ``k`` as an array; null when the sequence is too short."""
    return F.when(F.length(seq) >= k,
                  F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substring(seq, i, F.lit(k))))


def explode_kmers(df: DataFrame, ks, seq: str = "junction_aa", valid_only: bool = False,
                  once_per_row: bool = False) -> DataFrame:
    """Add ``k`` and ``kmer``, one row per window (or per distinct window of a row)."""
    ks = [ks] if isinstance(ks, int) else list(ks)
    s = F.col(seq)
    df = df.where(F.length(s) >= min(ks))
    if valid_only:
        df = df.withColumn("_valid", s.rlike(STRICT))
    if once_per_row:
        per_k = [F.struct(F.lit(k).alias("k"), F.array_distinct(windows(s, k)).alias("ws")) for k in ks]
        out = (df.withColumn("_w", F.explode(F.array(*per_k)))
               .withColumn("k", F.col("_w.k")).withColumn("kmer", F.explode("_w.ws")).drop("_w"))
    else:
        out = df.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))) if len(ks) > 1 else df.withColumn("k", F.lit(ks[0]))
        out = (out.where(F.length(s) >= F.col("k"))
               .withColumn("_i", F.explode(F.sequence(F.lit(1), F.length(s) - F.col("k") + 1)))
               .withColumn("kmer", F.substring(s, F.col("_i"), F.col("k"))).drop("_i"))
    if valid_only:
        out = out.where(F.col("_valid") | F.col("kmer").rlike(STRICT)).drop("_valid")
    return out


def collapse(df: DataFrame, keys: list[str] = (), seq: str = "junction_aa") -> DataFrame:
    """Distinct sequences per key with the number ``n`` of their rows.

    Windows are taken from these, so a sequence is cut up once per repertoire, and the work is spread by the shuffle
    of this fold whatever the files look like.
    """
    return df.where(F.col(seq).isNotNull()).groupBy(*keys, seq).agg(F.count(F.lit(1)).alias("n"))


def kmer_extract(df: DataFrame, k: int) -> DataFrame:
    """Distinct sequences with each window and its position."""
    seqs = df.select("junction_aa").where(F.length("junction_aa") >= k).distinct()
    return (seqs.withColumn("pos", F.explode(F.sequence(F.lit(1), F.length("junction_aa") - k + 1)))
            .withColumn("kmer", F.substring(F.col("junction_aa"), F.col("pos"), F.lit(k))))


def kmer_counts(df: DataFrame, ks=(3, 4), valid_only: bool = False, once_per_row: bool = False,
                keys: list[str] = REP) -> DataFrame:
    """Occurrences (or rows with it) of each k-mer per repertoire."""
    return _counts(df, ks, valid_only, once_per_row, list(keys)).select(*keys, "k", "kmer", "count")


def _counts(df: DataFrame, ks, valid_only: bool, once_per_row: bool, keys: list[str], share: bool = False) -> DataFrame:
    """Counts of each k-mer; with ``share`` also ``value``, their share of the group's total for the length."""
    ks = [ks] if isinstance(ks, int) else list(ks)
    rows = df.select(*keys, "junction_aa").where(F.length("junction_aa") >= min(ks))
    if share:
        # a group without a name has no total
        rows = rows.dropna(subset=keys)
    usual, large = blocks.split_by_size(rows, keys)
    parts = []
    if usual is not None:
        counts = blocks.counted(usual, keys, ks, valid_only, once_per_row)
        parts.append((counts.withColumn("value", F.col("count") / F.col("_total")) if share else counts).drop("_total"))
    if large is not None:
        spread = explode_kmers(collapse(large, keys), ks, valid_only=valid_only, once_per_row=once_per_row)
        counts = spread.groupBy(*keys, "k", "kmer").agg(F.sum("n").alias("count"))
        parts.append(_with_share(counts, [*keys, "k"]) if share else counts)
    return union_all(parts)


def _with_share(counts: DataFrame, group: list[str]) -> DataFrame:
    """Counts with ``value``, their share of the group's total, which is a grouped sum of its own."""
    total = counts.groupBy(*group).agg(F.sum("count").alias("_total"))
    return counts.join(total, group).withColumn("value", F.col("count") / F.col("_total")).drop("_total")


def kmer_frequencies(df: DataFrame, ks=(3, 4), valid_only: bool = True, prefix: str = "kmer_{k}_") -> DataFrame:
    """Share of each k-mer among the repertoire's windows of the same length, as features."""
    source = df.where(alpha_seq("junction_aa")) if valid_only else df
    counts = _counts(source, ks, valid_only, False, list(REP), share=True)
    head, tail = prefix.split("{k}")
    return counts.select(*REP, F.concat(F.lit(head), F.col("k"), F.lit(tail), F.col("kmer")).alias("feature"), "value")


def kmer_multiscale(df: DataFrame, ks=(3, 4, 5)) -> DataFrame:
    """Raw counts keyed ``k{k}_{kmer}``."""
    return kmer_counts(df, ks).select(*REP, F.concat(F.lit("k"), F.col("k"), F.lit("_"), F.col("kmer")).alias("feature"),
                                      F.col("count").cast("double").alias("value"))


def full_vocabulary(spark: SparkSession, k: int) -> DataFrame:
    """All 20^k k-mers with their index, decoded from the index digit by digit."""
    digits = [F.substring(F.lit(AMINO_ACIDS), (F.floor(F.col("id") / 20 ** (k - 1 - j)) % 20 + 1).cast("int"), F.lit(1))
              for j in range(k)]
    return spark.range(20 ** k).select(F.concat(*digits).alias("kmer"), F.col("id").alias("index"))


def full_vocabulary_counts(df: DataFrame, k: int) -> DataFrame:
    """Every possible k-mer with its pooled count, zero when unseen."""
    seen = explode_kmers(collapse(df), k).groupBy("kmer").agg(F.sum("n").alias("count"))
    return (full_vocabulary(df.sparkSession, k).join(seen, "kmer", "left")
            .select("kmer", "index", F.coalesce("count", F.lit(0)).alias("count")))


def learn_vocabulary(df: DataFrame, ks=(3, 4), per_k: int = 500, once_per_row: bool = True) -> DataFrame:
    """The ``per_k`` most frequent k-mers of each length, ranked."""
    totals = (explode_kmers(collapse(df), ks, once_per_row=once_per_row)
              .groupBy("k", "kmer").agg(F.sum("n").alias("count")))
    return top_k(totals, ["k"], [F.desc("count"), F.asc("kmer")], per_k, rank="rank", salt_on=["kmer"])


def index_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """Feature positions: lengths in order, k-mers by rank inside a length."""
    sizes = vocabulary.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("k", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return vocabulary.join(offsets, "k").select(
        F.concat(F.lit("kmer_"), F.col("k"), F.lit("_"), F.col("kmer")).alias("feature"), "k", "kmer",
        (F.col("offset") + F.col("rank") - 1).alias("index"))


def vocabulary_transform(df: DataFrame, vocabulary: DataFrame, ks, repertoires: DataFrame | None = None,
                         once_per_row: bool = True, size: int | None = None) -> DataFrame:
    """Shares over the vocabulary only; k-mers a repertoire lacks are zero.

    ``size`` is an upper bound on the vocabulary. A bounded one is broadcast and drops
    other windows before they are counted; otherwise windows are counted first. With
    ``repertoires`` the result is dense, else only non-zero rows are kept.
    """
    listed = vocabulary.select("k", "kmer")
    if size is not None and size <= BROADCAST_ROWS:
        windows_ = explode_kmers(collapse(df, REP), ks, once_per_row=once_per_row)
        counts = windows_.join(F.broadcast(listed), ["k", "kmer"]).groupBy(*REP, "k", "kmer").agg(F.sum("n").alias("count"))
    else:
        counts = kmer_counts(df, ks, once_per_row=once_per_row).join(listed, ["k", "kmer"])
    shares = _with_share(counts, [*REP, "k"]).select(*REP, "k", "kmer", "value")
    return shares if repertoires is None else densify(shares, repertoires, vocabulary, REP, ["k", "kmer"])


@dataclass
class KmerFeaturizer:
    """Learns a vocabulary per length, then turns repertoires into shares over it."""

    k_range: tuple[int, int] = (3, 5)
    per_k: int = 5000
    once_per_row: bool = True
    vocabulary: DataFrame | None = field(default=None, repr=False)

    @property
    def ks(self) -> list[int]:
        return list(range(self.k_range[0], self.k_range[1] + 1))

    def fit(self, df: DataFrame) -> "KmerFeaturizer":
        self.vocabulary = materialize(learn_vocabulary(df, self.ks, self.per_k, self.once_per_row), "kmers")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.vocabulary is None:
            raise ValueError("call fit first")
        return vocabulary_transform(df, self.vocabulary, self.ks, once_per_row=self.once_per_row, size=self.per_k * len(self.ks))

    def feature_names(self) -> DataFrame:
        return index_vocabulary(self.vocabulary)


def hashed_statistics(df: DataFrame, ks=(3, 4), buckets: int = 4096) -> DataFrame:
    """Mean, standard deviation and maximum over sequences of hashed k-mer shares.

    Per sequence and bucket: windows in the bucket / max(len-k+1, 1). Sequences without
    the bucket count as zero, so the moments divide by all sequences of the repertoire.
    """
    rows = df.where(loose_aa("junction_aa")).select(*REP, F.upper("junction_aa").alias("junction_aa")).dropna(subset=REP)
    ks = [ks] if isinstance(ks, int) else list(ks)
    usual, large = blocks.split_by_size(rows, list(REP))
    parts = []
    if usual is not None:
        parts.append(blocks.hashed_sums(usual, list(REP), ks, buckets))
    if large is not None:
        parts.append(_hashed_sums(large, ks, buckets))
    mean = F.col("s") / F.col("n_seqs")
    return union_all(parts).select(
        *REP, "k", "bucket", mean.alias("mean"),
        F.sqrt(F.greatest(F.col("ss") / F.col("n_seqs") - mean * mean, F.lit(0.0))).alias("std"), "max")


def _hashed_sums(rows: DataFrame, ks, buckets: int) -> DataFrame:
    """Sums over the rows of large repertoires, which stay spread over tasks."""
    seqs = rows.groupBy(*REP, "junction_aa").agg(F.count(F.lit(1)).alias("n"))
    sizes = seqs.groupBy(*REP).agg(F.sum("n").alias("n_seqs"))
    hits = (explode_kmers(seqs, ks, valid_only=True)
            .withColumn("bucket", F.pmod(F.crc32(F.col("kmer").cast("binary")), F.lit(buckets)))
            .groupBy(*REP, "k", "junction_aa", "n", "bucket").agg(F.count(F.lit(1)).alias("c"))
            .withColumn("x", F.col("c") / F.greatest(F.length("junction_aa") - F.col("k") + 1, F.lit(1))))
    sums = hits.groupBy(*REP, "k", "bucket").agg(
        F.sum(F.col("x") * F.col("n")).alias("s"), F.sum(F.col("x") * F.col("x") * F.col("n")).alias("ss"),
        F.max("x").alias("max"))
    return sums.join(sizes, REP).select(*REP, "k", "bucket", "s", "ss", "max", "n_seqs")


def positional_kmers(df: DataFrame, k: int = 3, keep: int = 30) -> DataFrame:
    """Shares of the first and last k-mer; shares first, then the most frequent ``keep``."""
    s = F.col("junction_aa")
    ends = F.array(F.struct(F.lit("start").alias("side"), F.substring(s, 1, k).alias("kmer")),
                   F.struct(F.lit("end").alias("side"), F.right(s, F.lit(k)).alias("kmer")))
    rows = (df.where(alpha_seq("junction_aa") & (F.length(s) >= k)).select(*REP, F.inline(ends))
            .where(F.col("kmer").rlike(STRICT)))
    counts = rows.groupBy(*REP, "side", "kmer").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(*REP, "side"))
    shares = counts.withColumn("value", F.col("count") / total)
    best = top_k(shares, [*REP, "side"], [F.desc("count"), F.asc("kmer")], keep)
    return best.select(*REP, F.concat(F.lit("pos_"), F.col("side"), F.lit("_"), F.col("kmer")).alias("feature"), "value")


def global_kmers(df: DataFrame, k: int = 3, keep: int = 64, weight: str | None = None) -> DataFrame:
    """Weight of a repertoire's rows that contain each of the most common k-mers overall."""
    rows = df.where(F.col("junction_aa").isNotNull())
    pooled = explode_kmers(collapse(rows), k).groupBy("kmer").agg(F.sum("n").alias("c"))
    best = materialize(pooled.orderBy(F.desc("c"), "kmer").limit(keep).select("kmer"), "best")
    only = F.broadcast(best) if keep <= BROADCAST_ROWS else best
    w = F.col(weight) if weight else F.lit(1.0)
    # An absent weight adds nothing, as a summed missing value.
    inside = (explode_kmers(rows.select(*REP, "junction_aa", w.alias("w")), k, once_per_row=True).join(only, "kmer")
              .groupBy(*REP, "kmer").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("value")))
    return densify(inside, df.select(*REP).distinct(), best, REP, ["kmer"])


def aa_composition(df: DataFrame) -> DataFrame:
    """Share of each letter over all characters of the repertoire."""
    letters = (df.where(loose_aa("junction_aa")).select(*REP, F.explode(F.split("junction_aa", "")).alias("letter"))
               .groupBy(*REP, "letter").agg(F.count(F.lit(1)).alias("c")))
    total = F.sum("c").over(Window.partitionBy(*REP))
    return letters.select(*REP, "letter", (F.col("c") / total).alias("value")).where(F.col("letter").rlike(STRICT))


def column_index(features: DataFrame) -> DataFrame:
    """(feature, index): place of every feature name in the sorted list of all, numbered through buckets of a prefix."""
    names = materialize(features.select("feature").distinct(), "names").withColumn("_all", F.lit(0))
    # names that share their first letters are neighbours in the order, and buckets grow with it; what follows a
    # letter beyond ASCII does not count
    plain = F.regexp_replace("feature", r"(?s)[^\x00-\x7E].*$", "\x7f")
    code = lambda i: F.ascii(F.substring(plain, i, 1)).cast("long")
    bucket = code(1) * 128 ** 4 + code(2) * 128 ** 3 + code(3) * 128 ** 2 + code(4) * 128 + code(5)
    numbered = dense_numbers(names, ["_all"], bucket, [F.asc("feature")], "_n")
    return numbered.select("feature", (F.col("_n") - 1).cast("long").alias("index"))


def sparse_rows(features: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Sorted index and value arrays per repertoire; ``vocabulary`` maps feature to index.

    A vocabulary of at most ``BROADCAST_ROWS`` names comes to the features, which are not shuffled by name then.
    """
    listed = vocabulary.select("feature", "index")
    cells = features.join(F.broadcast(listed) if vocabulary.count() <= BROADCAST_ROWS else listed, "feature")
    packed = cells.groupBy(*REP).agg(F.sort_array(F.collect_list(F.struct("index", "value"))).alias("_c"))
    return packed.select(*REP, F.col("_c.index").alias("indices"), F.col("_c.value").alias("values"))
