"""Ranking of the sequences that explain the label.

k-mer weights come as (k, kmer, weight) rows, with a dataset when each has its own. Sequences are made distinct before their
windows are exploded, and all windows of a sequence come from one row, so their sum folds
inside the task that exploded them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clonara.constants import DEFAULT_J, DEFAULT_V, PLACEHOLDER_SEQUENCE, REP, SENTINEL
from clonara.functions.text import STRICT, alpha_seq, default_j, default_v, sentinel_fill, valid_aa
from clonara.operators.align import submission_rows
from clonara.operators.kmers import BROADCAST_ROWS, explode_kmers, windows
from clonara.operators.ranks import top_k
from clonara.operators.sampling import first_repertoires, order_columns, uniform
from clonara.session import materialize

SEQ = ["dataset", "junction_aa"]
TRIPLE = ["dataset", "junction_aa", "v_call", "j_call"]
_SALTS = 16


def _rows_of(df: DataFrame, metadata: DataFrame, positive: bool | None, n: int | None) -> DataFrame:
    """Rows of the repertoires (of one class), or of the first ``n`` of them."""
    m = metadata.select(*REP, "label_positive", *order_columns(metadata))
    if positive is not None:
        m = m.where(F.col("label_positive") == positive)
    return df.drop("label_positive").join(first_repertoires(m, n, by_label=positive is not None).drop("file_order"), REP)


def _ranked(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """Top ``k`` per dataset by score, names breaking ties, with their rank."""
    names = list(ties) or ["junction_aa"]
    order = [F.desc(F.round("score", 6)), *[F.asc_nulls_first(c) for c in names]]
    return top_k(scored, ["dataset"], order, k, rank="rank", salt_on=["dataset", *names])


def with_kmer_score(seqs: DataFrame, weights: DataFrame, ks: list[int], once: bool) -> DataFrame:
    """Add the sum of window weights (zero without any) to rows with distinct keys.

    Windows are exploded from the rows themselves and folded back by all columns, so the
    rows are computed once and never joined with themselves. Weights are counted: up to
    ``BROADCAST_ROWS`` they are broadcast and no window is shuffled, beyond that the join
    is salted.
    """
    s = F.col("junction_aa")

    def listed(k: int) -> Column:
        found = F.array_distinct(windows(s, k)) if once else windows(s, k)
        return F.coalesce(F.transform(found, lambda w: F.struct(F.lit(k).alias("k"), w.alias("kmer"))),
                          F.array().cast("array<struct<k:int,kmer:string>>"))

    keep = seqs.columns
    exploded = seqs.withColumn("_w", F.explode_outer(F.concat(*[listed(k) for k in ks]))).select(*keep, "_w.k", "_w.kmer")
    on = [c for c in ("dataset", "k", "kmer") if c in weights.columns]
    table = materialize(weights.where(F.col("k").isin(list(ks))).select(*on, "weight"), "weights")
    if table.count() <= BROADCAST_ROWS:
        joined = exploded.join(F.broadcast(table), on, "left")
    else:  # a k-mer that stands in nearly every sequence is dealt over several tasks
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        spread = exploded.withColumn("_salt", F.pmod(F.xxhash64(*keep), F.lit(_SALTS)).cast("int"))
        joined = spread.join(salted, [*on, "_salt"], "left")
    return joined.groupBy(*keep).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("kmer_score"))


def _occurrences(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*SEQ).agg(F.count(F.lit(1)).alias("n"))


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def rank_clone_scores(df: DataFrame, metadata: DataFrame, mined: DataFrame, k: int = 50000, files: int | None = None) -> DataFrame:
    """Mined sequences by score; other sequences of positive repertoires follow with zero."""
    others = _rows_of(df, metadata, True, files).where(F.length("junction_aa") > 0).select(*SEQ).distinct()
    scored = mined.select(*SEQ, "score").join(others, SEQ, "full").select(*SEQ, _zero("score").alias("score"))
    return _ranked(scored, k)


def rank_gain(df: DataFrame, metadata: DataFrame, mined: DataFrame, weights: DataFrame, k: int = 50000, files: int | None = None) -> DataFrame:
    """Twice the mined score plus, per occurrence in positive repertoires, the k-mer gains."""
    seen = _occurrences(_rows_of(df, metadata, True, files).where(valid_aa("junction_aa")))
    gains = with_kmer_score(seen, weights, [3, 4], once=False)
    scored = (gains.join(mined.select(*SEQ, "score"), SEQ, "full")
              .where(valid_aa("junction_aa"))
              .select(*SEQ, (2 * _zero("score") + F.coalesce("n", F.lit(0)) * _zero("kmer_score")).alias("score")))
    return _ranked(scored, k)


def rank_gain_bonus(df: DataFrame, metadata: DataFrame, mined: DataFrame, weights: DataFrame, k: int = 50000, files: int | None = None) -> DataFrame:
    """Mined score, two more when significant, plus k-mer gains; invalid sequences leave after the cut."""
    seen = _occurrences(_rows_of(df, metadata, True, files).where(alpha_seq("junction_aa")))
    pooled = weights.groupBy("kmer").agg(F.sum("weight").alias("weight")).withColumn("k", F.length("kmer"))
    gains = with_kmer_score(seen, pooled, [3, 4], once=False)
    base = F.col("score") + F.when(F.col("significant"), 2.0).otherwise(0.0)
    scored = (gains.join(mined.select(*SEQ, base.alias("base")), SEQ, "full")
              .select(*SEQ, (_zero("base") + F.coalesce("n", F.lit(0)) * _zero("kmer_score")).alias("score")))
    return _ranked(scored, k).where(valid_aa("junction_aa"))


def rank_difference(df: DataFrame, metadata: DataFrame, mined: DataFrame, weights: DataFrame, k: int = 50000,
                    pos_files: int | None = None, neg_files: int | None = None) -> DataFrame:
    """Positive mined score doubled, plus the class difference of row counts, plus a tenth of the k-mer weights."""
    pos = _occurrences(_rows_of(df, metadata, True, pos_files).where(F.length("junction_aa") >= 8)).withColumnRenamed("n", "p")
    neg = _occurrences(_rows_of(df, metadata, False, neg_files).where(F.col("junction_aa").isNotNull())).withColumnRenamed("n", "q")
    q = F.coalesce("q", F.lit(0))
    diff = pos.join(neg, SEQ, "left").select(*SEQ, ((F.col("p") - q) / (F.col("p") + q + 1)).alias("diff"))
    base = mined.where(F.col("direction") == "positive").select(*SEQ, (2 * F.col("score")).alias("base"))
    both = diff.join(base, SEQ, "full")
    scored = with_kmer_score(both, weights, [3, 4], once=False).select(
        *SEQ, (_zero("base") + _zero("diff") + 0.1 * _zero("kmer_score")).alias("score"))
    return _ranked(scored, k)


def rank_frequency(df: DataFrame, metadata: DataFrame, k: int = 50000, files: int | None = None) -> DataFrame:
    """Most frequent long alphabetic sequences of positive repertoires, with default genes."""
    rows = _rows_of(df, metadata, True, files).where((F.length("junction_aa") >= 8) & alpha_seq("junction_aa"))
    return (_ranked(rows.groupBy(*SEQ).agg(F.count(F.lit(1)).cast("double").alias("score")), k)
            .withColumn("v_call", F.lit(DEFAULT_V)).withColumn("j_call", F.lit(DEFAULT_J)))


def rank_distinct_kmers(df: DataFrame, metadata: DataFrame, k: int = 50000) -> DataFrame:
    """Distinct valid 4-mers of each sequence of positive repertoires (the same at every occurrence)."""
    seqs = _rows_of(df, metadata, True, None).where(F.col("junction_aa").isNotNull()).select(*SEQ).distinct()
    found = F.filter(F.array_distinct(windows(F.upper("junction_aa"), 4)), lambda w: w.rlike(STRICT))
    return _ranked(seqs.select(*SEQ, F.coalesce(F.size(found), F.lit(0)).cast("double").alias("score")), k)


def distinct_rearrangements(df: DataFrame) -> DataFrame:
    """Distinct (sequence, V, J) with a sequence."""
    return df.where(F.col("junction_aa").isNotNull()).select(*TRIPLE).distinct()


def _rank_triples(df: DataFrame, weights: DataFrame, ks: list[int], once: bool, k: int) -> DataFrame:
    scored = with_kmer_score(distinct_rearrangements(df), weights, ks, once).select(*TRIPLE, F.col("kmer_score").alias("score"))
    return _ranked(scored, k, "junction_aa", "v_call", "j_call")


def rank_linear(df: DataFrame, coefficients: DataFrame, k: int = 50000, ks=(3, 4, 5)) -> DataFrame:
    """Coefficient over scale, summed over the distinct k-mers present."""
    w = coefficients.select("k", "kmer", (F.col("coefficient") / F.nullif(F.col("scale"), F.lit(0.0))).alias("weight"))
    return _rank_triples(df, w, list(ks), True, k)


def rank_importance(df: DataFrame, weights: DataFrame, k: int = 50000, ks=(3, 4, 5)) -> DataFrame:
    """Importance summed over distinct k-mers."""
    return _rank_triples(df, weights, list(ks), True, k)


def rank_occurrence(df: DataFrame, weights: DataFrame, k: int = 50000, ks=(3,)) -> DataFrame:
    """Importance summed over every window."""
    return _rank_triples(df, weights, list(ks), False, k)


def rank_top_weights(df: DataFrame, coefficients: DataFrame, n: int = 1000, k: int = 50000, ks=(3,)) -> DataFrame:
    """Only the ``n`` largest coefficients count, by absolute value."""
    w = (coefficients.select("k", "kmer", F.abs("coefficient").alias("weight"))
         .orderBy(F.desc("weight"), "k", "kmer").limit(n))
    return _rank_triples(df, w, list(ks), False, k)


def rank_quota(df: DataFrame, important: DataFrame, key: list[str], k: int = 50000, kmer: int = 3, seed: int = 42,
               positive_share: float = 0.7) -> DataFrame:
    """Rows with any important k-mer, drawn evenly from each class: most from the positive one."""
    seqs = explode_kmers(df.select("junction_aa").where(F.col("junction_aa").isNotNull()).distinct(), kmer)
    chosen = seqs.join(important.select("kmer"), "kmer", "left_semi").select("junction_aa").distinct()
    rows = df.join(chosen, "junction_aa", "left_semi")
    counts = rows.groupBy("dataset").agg(F.count_if("label_positive").alias("np"), F.count_if(~F.col("label_positive")).alias("nn"))
    take_pos = F.least(F.lit(int(k * positive_share)), F.col("np"))
    quota = F.when(F.col("label_positive"), take_pos).otherwise(F.least(k - take_pos, F.col("nn")))
    draw = uniform([*REP, *key], seed)
    ranked = top_k(rows.withColumn("_d", draw), ["dataset", "label_positive"], [F.asc("_d"), *[F.asc(c) for c in key]], k,
                   rank="_r", salt_on=[*REP, *key])
    return (ranked.join(counts, "dataset").where(F.col("_r") <= quota)
            .select(*REP, "label_positive", "junction_aa", "v_call", "j_call", F.col("_r").alias("rank")))


def _first_call(c: str, order: Column) -> Column:
    return F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", order))


def rank_weighted_frequency(df: DataFrame, k: int = 50000, positive: float = 2.0, negative: float = 0.5) -> DataFrame:
    """Rows weighted by class, ties by count; first known genes, else the defaults."""
    order = F.struct("repertoire_id", "row_order", "v_call", "j_call")
    n = F.count(F.lit(1))
    scored = df.where(F.col("junction_aa").isNotNull()).groupBy(*SEQ).agg(
        F.sum(F.when(F.col("label_positive"), F.lit(positive)).otherwise(F.lit(negative))).alias("score"), n.alias("count"),
        _first_call("v_call", order).alias("v_call"), _first_call("j_call", order).alias("j_call"))
    ranked = top_k(scored, ["dataset"], [F.desc("score"), F.desc("count"), F.asc("junction_aa")], k, rank="rank", salt_on=SEQ)
    return ranked.select(*SEQ, "score", "count", "rank", default_v("v_call").alias("v_call"), default_j("j_call").alias("j_call"))


def rank_first_seen(df: DataFrame, k: int = 50000) -> DataFrame:
    """Distinct sequences in reading order, positive repertoires before the rest."""
    order = F.struct((~F.col("label_positive")).alias("neg"), "repertoire_id", "row_order", "v_call", "j_call")
    first = df.where(F.length("junction_aa") > 0).groupBy(*SEQ).agg(F.min(order).alias("o"))
    ranked = top_k(first, ["dataset"], [F.asc("o.neg"), F.asc("o.repertoire_id"), F.asc("o.row_order"), F.asc("junction_aa")], k,
                   rank="rank", salt_on=SEQ)
    fill = lambda c: F.coalesce(F.col(f"o.{c}"), F.lit(SENTINEL)).alias(c)
    return ranked.select(*SEQ, fill("v_call"), fill("j_call"), "rank")


def rank_attention(weights: DataFrame, k: int = 50000) -> DataFrame:
    """Attention mass of each sequence over positive bags (``weights``: rows with ``weight``)."""
    scored = weights.where(F.col("label_positive") & F.col("junction_aa").isNotNull()).groupBy(*SEQ).agg(F.sum("weight").alias("score"))
    return _ranked(scored, k)


def vj_lookup(seqs: DataFrame, df: DataFrame, metadata: DataFrame, pos_files: int | None = None, any_files: int | None = None) -> DataFrame:
    """First (V, J) with a known V per sequence: positive repertoires first, then the others."""
    pos = first_repertoires(metadata.where("label_positive").select(*REP, *order_columns(metadata)), pos_files, by_label=False).drop("file_order").withColumn("late", F.lit(0))
    some = first_repertoires(metadata.select(*REP, *order_columns(metadata)), any_files, by_label=False).drop("file_order").withColumn("late", F.lit(1))
    files = pos.unionByName(some).groupBy(*REP).agg(F.min("late").alias("late"))
    rows = df.where((F.col("v_call") != "") & F.col("junction_aa").isNotNull()).select(*TRIPLE, "repertoire_id", "row_order").join(files, REP)
    # fold to one row per sequence before the join, so a frequent sequence stays spread out
    found = rows.groupBy(*SEQ).agg(F.min(F.struct("late", "repertoire_id", "row_order", "v_call", "j_call")).alias("o"))
    return found.join(seqs.select(*SEQ), SEQ, "left_semi").select(*SEQ, F.col("o.v_call").alias("v_call"), F.col("o.j_call").alias("j_call"))


def pad_top_k(ranked: DataFrame, datasets: DataFrame, k: int = 50000) -> DataFrame:
    """Exactly ranks 1..k per dataset; missing ranks hold the placeholder sequence."""
    grid = datasets.select("dataset").distinct().select("dataset", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return grid.join(ranked, ["dataset", "rank"], "left").withColumn("junction_aa", F.coalesce("junction_aa", F.lit(PLACEHOLDER_SEQUENCE)))


def pad_variable(ranked: DataFrame, datasets: DataFrame, k: int = 50000) -> DataFrame:
    """The same with a placeholder whose run of X depends on the position."""
    filler = F.concat(F.lit("CASS"), F.repeat(F.lit("X"), (F.col("rank") - 1) % 10 + 5), F.lit("F"))
    grid = datasets.select("dataset").distinct().select("dataset", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return grid.join(ranked, ["dataset", "rank"], "left").withColumn("junction_aa", F.coalesce("junction_aa", filler))


def with_ids(ranked: DataFrame, infix: str = "_seq_top_") -> DataFrame:
    return ranked.withColumn("ID", F.concat("dataset", F.lit(infix), F.col("rank").cast("string")))


def repair_sequences(submission: DataFrame) -> DataFrame:
    """Sequences with an unknown letter become the placeholder; the sentinel stays."""
    s = F.col("junction_aa")
    return submission.withColumn("junction_aa", F.when((s != SENTINEL) & ~valid_aa("junction_aa"), F.lit(PLACEHOLDER_SEQUENCE)).otherwise(s))


def sequence_rows(ranked: DataFrame, calls: DataFrame | None = None, datasets: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """A ranking as output rows: numbered without gaps, genes looked up, padded to ``k``."""
    w = Window.partitionBy("dataset").orderBy("rank")
    out = ranked.withColumn("rank", F.row_number().over(w))
    if calls is not None:
        out = out.drop("v_call", "j_call").join(calls, SEQ, "left")
    if k is not None:
        out = pad_top_k(out.where(F.col("rank") <= k), datasets, k)
    for c in ("v_call", "j_call"):
        out = out.withColumn(c, sentinel_fill(c)) if c in out.columns else out.withColumn(c, F.lit(SENTINEL))
    return submission_rows(with_ids(out), sequence=True)
