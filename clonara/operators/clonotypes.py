"""Sequences shared between repertoires and enriched in one class.

Rows are reduced to distinct (repertoire, sequence) before they meet by sequence, so a
sequence found everywhere contributes at most one row per repertoire, and class counts
are folded inside each task before that shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from clonara.constants import (MINE_ENRICH, MINE_ENRICH_DEFAULT, MINE_MIN_FREQ, MINE_MIN_FREQ_DEFAULT, MINE_TOP_N,
                               MINE_TOP_N_DEFAULT, REP)
from clonara.functions.fisher import with_fisher
from clonara.functions.text import alpha_seq, dataset_id
from clonara.operators.ranks import top_k
from clonara.operators.sampling import first_repertoires, order_columns
from clonara.session import materialize

SEQ = ["dataset", "junction_aa"]


def presence(df: DataFrame, *extra: str) -> DataFrame:
    """Distinct sequences of each repertoire."""
    return df.where(F.col("junction_aa").isNotNull()).select(*REP, *extra, "junction_aa").distinct()


def _per_sequence(present: DataFrame) -> DataFrame:
    positive = F.col("label_positive")
    return present.groupBy(*SEQ).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


# ---- sharing between individuals ---------------------------------------------------


def public_sequences(df: DataFrame, min_individuals: int = 2) -> DataFrame:
    """Sequences found in at least ``min_individuals`` repertoires of a dataset."""
    return (presence(df).groupBy(*SEQ).agg(F.count(F.lit(1)).alias("n_repertoires"))
            .where(F.col("n_repertoires") >= min_individuals))


def disease_enrichment(df: DataFrame, min_individuals: int = 2, min_count: int = 5) -> DataFrame:
    """Share of positive repertoires among those with a public sequence."""
    total = F.col("pos") + F.col("neg")
    return (_per_sequence(presence(df, "label_positive")).where((total >= min_individuals) & (total >= min_count))
            .select(*SEQ, (F.col("pos") / (total + 1e-6)).alias("enrichment")))


@dataclass
class PublicClones:
    """Public sequences and their enrichment, learned on labelled repertoires."""

    min_individuals: int = 2
    min_count: int = 5
    threshold: float = 0.6
    table: DataFrame | None = field(default=None, repr=False)

    def fit(self, df: DataFrame) -> "PublicClones":
        total = F.col("pos") + F.col("neg")
        learned = (_per_sequence(presence(df, "label_positive")).where(total >= self.min_individuals)
                   .select(*SEQ, F.when(total >= self.min_count, F.col("pos") / (total + 1e-6)).alias("enrichment")))
        self.table = materialize(learned, "public")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Number and share of public sequences, their enrichment and share of templates."""
        if self.table is None:
            raise ValueError("call fit first")
        held = df.groupBy(*REP, "junction_aa").agg(F.sum("templates").alias("t"))
        marked = held.join(self.table.withColumn("public", F.lit(True)), SEQ, "left")
        public = F.coalesce(F.col("public"), F.lit(False))
        e = F.col("enrichment")
        n_public, unique = F.count_if(public), F.count("junction_aa")
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        return marked.groupBy(*REP).agg(
            n_public.alias("n_public"), (n_public / F.greatest(unique, F.lit(1))).alias("frac_public"),
            F.count_if(e > self.threshold).alias("n_disease_enriched"), zero(F.avg(e)).alias("avg_disease_enrichment"),
            zero(F.max(e)).alias("max_disease_enrichment"),
            (zero(F.sum(F.when(public, F.col("t")))) / F.greatest(zero(F.sum("t")), F.lit(1.0))).alias("public_template_fraction"))

    def ranked(self, k: int = 50000) -> DataFrame:
        """Enriched sequences, best first."""
        scored = self.table.where(F.col("enrichment").isNotNull())
        return top_k(scored, ["dataset"], [F.desc("enrichment"), F.asc("junction_aa")], k, rank="rank", salt_on=SEQ)

    def stats(self) -> DataFrame:
        e = F.col("enrichment")
        return self.table.groupBy("dataset").agg(
            F.count(F.lit(1)).alias("n_public"), F.count_if(e > self.threshold).alias("n_disease_enriched"),
            F.count_if(e < 1 - self.threshold).alias("n_healthy_enriched"))


# ---- miners ------------------------------------------------------------------------


def class_counts(df: DataFrame, metadata: DataFrame, max_files: int | None = None, exclude_fold: DataFrame | None = None) -> DataFrame:
    """Repertoires per class with each sequence, next to the class sizes.

    ``max_files`` restricts the count to the first repertoires of each class; without it all
    are read. ``exclude_fold`` lists repertoires to leave out, for mining that must not see a
    held-out fold.
    """
    if exclude_fold is not None:
        metadata = metadata.join(exclude_fold.select(*REP), REP, "left_anti")
    chosen = first_repertoires(metadata.select(*REP, "label_positive", *order_columns(metadata)), max_files).drop("file_order")
    sizes = chosen.groupBy("dataset").agg(F.count_if("label_positive").alias("n_pos"), F.count_if(~F.col("label_positive")).alias("n_neg"))
    present = df.select(*REP, "junction_aa").where(F.col("junction_aa").isNotNull()).join(chosen, REP).distinct()
    return _per_sequence(present).join(sizes, "dataset")


def _with_frequencies(counts: DataFrame) -> DataFrame:
    return (counts.withColumn("pos_freq", F.col("pos") / F.greatest(F.col("n_pos"), F.lit(1)))
            .withColumn("neg_freq", F.col("neg") / F.greatest(F.col("n_neg"), F.lit(1))))


def _log_ratio() -> Column:
    return F.ln((F.col("pos_freq") + 1e-6) / (F.col("neg_freq") + 1e-6))


def mine_enriched(df: DataFrame, metadata: DataFrame, max_files: int | None = None, min_freq: float = 0.15,
                  enrichment: float = 5.0, top_n: int | None = None, exclude_fold: DataFrame | None = None,
                  widths: dict[int, int] | None = None) -> DataFrame:
    """Sequences frequent in positive repertoires and rarer by a factor in negative ones.

    ``top_n`` limits the list of each dataset; ``widths`` gives other limits by dataset number.
    """
    pf, nf = F.col("pos_freq"), F.col("neg_freq")
    kept = (_with_frequencies(class_counts(df, metadata, max_files, exclude_fold))
            .where((F.col("pos") > 0) & (pf >= min_freq) & (pf > nf * enrichment))
            .select(*SEQ, _log_ratio().alias("score"), "pos_freq", "neg_freq"))
    order = [F.desc("score"), F.asc("junction_aa")]
    if top_n is None:
        return kept
    if not widths:
        return top_k(kept, ["dataset"], order, top_n, salt_on=SEQ)
    ranked = top_k(kept, ["dataset"], order, max([top_n, *widths.values()]), rank="_r", salt_on=SEQ)
    return ranked.where(F.col("_r") <= _by_dataset(widths, top_n)).drop("_r")


def fold_counts(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Class counts of every sequence and class sizes with each ``fold`` of its dataset left out in turn.

    ``folds`` holds dataset, repertoire_id, label_positive and fold. Presence is shuffled and counted once, per fold; what
    remains without a fold is the total less that fold's share. A sequence has one row per fold of its dataset.
    """
    chosen = folds.select(*REP, "label_positive", "fold")
    y = F.col("label_positive")
    count = lambda c: F.count_if(c).cast("long")
    per = chosen.groupBy("dataset", "fold").agg(count(y).alias("p"), count(~y).alias("q"))
    sizes = per.groupBy("dataset").agg(F.sum("p").alias("P"), F.sum("q").alias("Q"), F.collect_list(F.struct("fold", "p", "q")).alias("_f"))
    sizes = sizes.select("dataset", F.transform("_f", lambda f: F.struct(f["fold"].alias("fold"), (F.col("P") - f["p"]).alias("n_pos"), (F.col("Q") - f["q"]).alias("n_neg"))).alias("_sizes"))
    present = df.select(*REP, "junction_aa").where(F.col("junction_aa").isNotNull()).join(chosen, REP).distinct()
    seen = present.groupBy(*SEQ, "fold").agg(count(y).alias("p"), count(~y).alias("q"))
    total = seen.groupBy(*SEQ).agg(F.sum("p").alias("P"), F.sum("q").alias("Q"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("p", "q")))).alias("_by"))
    rows = total.join(sizes, "dataset").select(*SEQ, "P", "Q", "_by", F.explode("_sizes").alias("s"))
    own = F.try_element_at("_by", F.col("s.fold"))
    less = lambda all_, c: (F.col(all_) - F.coalesce(own[c], F.lit(0))).alias({"p": "pos", "q": "neg"}[c])
    return rows.select(*SEQ, "s.fold", less("P", "p"), less("Q", "q"), "s.n_pos", "s.n_neg")


def mine_by_fold(df: DataFrame, folds: DataFrame, min_freq: float = 0.15, enrichment: float = 5.0) -> DataFrame:
    """Enriched sequences for every fold, mined without its repertoires; the list of a fold never saw it."""
    pf, nf = F.col("pos_freq"), F.col("neg_freq")
    return (_with_frequencies(fold_counts(df, folds)).where((F.col("pos") > 0) & (pf >= min_freq) & (pf > nf * enrichment))
            .select(*SEQ, "fold", _log_ratio().alias("score"), "pos_freq", "neg_freq"))


def _by_dataset(values: dict[int, float], default: float) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.get(F.array(F.try_element_at(table, dataset_id("dataset"))), F.lit(0)), F.lit(default))


def mine_by_dataset(df: DataFrame, metadata: DataFrame, max_files: int | None = None, limited: bool = False) -> DataFrame:
    """As above for sequences of eight letters or more, with thresholds by dataset number.

    ``limited`` cuts each list to the width of its dataset.
    """
    pf, nf = F.col("pos_freq"), F.col("neg_freq")
    kept = (_with_frequencies(class_counts(df, metadata, max_files))
            .where((F.length("junction_aa") >= 8) & alpha_seq("junction_aa") & (F.col("pos") > 0)
                   & (pf >= _by_dataset(MINE_MIN_FREQ, MINE_MIN_FREQ_DEFAULT))
                   & (pf > nf * _by_dataset(MINE_ENRICH, MINE_ENRICH_DEFAULT)))
            .select(*SEQ, _log_ratio().alias("score"), "pos_freq", "neg_freq"))
    if not limited:
        return kept
    widest = max([MINE_TOP_N_DEFAULT, *MINE_TOP_N.values()])
    ranked = top_k(kept, ["dataset"], [F.desc("score"), F.asc("junction_aa")], widest, rank="_r", salt_on=SEQ)
    return ranked.where(F.col("_r") <= _by_dataset(MINE_TOP_N, MINE_TOP_N_DEFAULT)).drop("_r")


def mine_fisher(df: DataFrame, metadata: DataFrame, max_files: int | None = None, p_threshold: float = 0.01,
                min_freq: float = 0.10, top_n: int | None = None, exclude_fold: DataFrame | None = None) -> DataFrame:
    """Sequences whose presence differs between classes, in either direction."""
    pf, nf = F.col("pos_freq"), F.col("neg_freq")
    counts = (_with_frequencies(class_counts(df, metadata, max_files, exclude_fold))
              .where((F.length("junction_aa") >= 8) & (F.col("n_pos") > 0) & ((pf >= min_freq) | (nf >= min_freq))))
    score = -F.log10(F.col("p_value") + 1e-10) * F.signum(F.ln(F.col("odds_ratio") + 1e-10))
    kept = (with_fisher(counts).where(F.round("p_value", 9) < p_threshold)
            .select(*SEQ, score.alias("score"), "p_value", "odds_ratio", "pos_freq", "neg_freq",
                    F.when(F.col("odds_ratio") > 1, "positive").otherwise("negative").alias("direction")))
    order = [F.desc(F.round(F.abs("score"), 9)), F.asc("junction_aa")]
    return kept if top_n is None else top_k(kept, ["dataset"], order, top_n, salt_on=SEQ)


def mine_fisher_greater(df: DataFrame, metadata: DataFrame, max_files: int | None = None, min_freq: float = 0.05,
                        enrichment: float = 3.0, p_threshold: float = 0.1, top_n: int | None = None) -> DataFrame:
    """Log ratio plus one for sequences significant in the one-sided test; others stay."""
    pf, nf = F.col("pos_freq"), F.col("neg_freq")
    counts = (_with_frequencies(class_counts(df, metadata, max_files))
              .where((F.col("pos") > 0) & (pf >= min_freq) & ((nf <= 0) | (pf > nf * enrichment))))
    significant = F.round("p_value", 9) < p_threshold
    kept = with_fisher(counts, "greater").select(
        *SEQ, (_log_ratio() + F.when(significant, 1.0).otherwise(0.0)).alias("score"), "pos_freq", "neg_freq", "p_value",
        significant.alias("significant"))
    order = [F.desc(F.round("score", 9)), F.asc("junction_aa")]
    return kept if top_n is None else top_k(kept, ["dataset"], order, top_n, salt_on=SEQ)


# ---- hits of mined sequences -------------------------------------------------------


def _hits(df: DataFrame, mined: DataFrame, *columns: str) -> DataFrame:
    """Distinct alphabetic sequences of every repertoire next to the mined columns."""
    seq = F.when(alpha_seq("junction_aa"), F.col("junction_aa")).alias("junction_aa")
    return df.select(*REP, seq).distinct().join(mined.select(*SEQ, *columns), SEQ, "left")


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _ratio() -> Column:
    return _or_zero(F.count("score") / F.nullif(F.count("junction_aa"), F.lit(0)))


def public_hits(df: DataFrame, mined: DataFrame) -> DataFrame:
    """Sum, maximum, number and share of a repertoire's sequences that were mined."""
    return _hits(df, mined, "score").groupBy(*REP).agg(
        _or_zero(F.sum("score")).alias("pub_score_sum"), _or_zero(F.max("score")).alias("pub_score_max"),
        F.count("score").cast("double").alias("pub_hits"), _ratio().alias("pub_hit_ratio"))


def public_hits_signed(df: DataFrame, mined: DataFrame) -> DataFrame:
    """The same split by direction, and the net score."""
    pos = F.when(F.col("direction") == "positive", F.col("score"))
    neg = F.when(F.col("direction") != "positive", F.col("score"))
    pos_sum, neg_sum = _or_zero(F.sum(pos)), _or_zero(F.sum(neg))
    return _hits(df, mined, "score", "direction").groupBy(*REP).agg(
        pos_sum.alias("pub_pos_score_sum"), _or_zero(F.max(pos)).alias("pub_pos_score_max"),
        F.count(pos).cast("double").alias("pub_pos_hits"), neg_sum.alias("pub_neg_score_sum"),
        _or_zero(F.min(neg)).alias("pub_neg_score_max"), F.count(neg).cast("double").alias("pub_neg_hits"),
        (pos_sum - F.abs(neg_sum)).alias("pub_net_score"), _ratio().alias("pub_hit_ratio"))


def public_hits_significant(df: DataFrame, mined: DataFrame) -> DataFrame:
    """Hits plus number and sum of the significant ones."""
    sig = F.when(F.col("significant"), F.col("score"))
    return _hits(df, mined, "score", "significant").groupBy(*REP).agg(
        _or_zero(F.sum("score")).alias("pub_score_sum"), _or_zero(F.max("score")).alias("pub_score_max"),
        F.count("score").cast("double").alias("pub_hits"), _ratio().alias("pub_hit_ratio"),
        F.count(sig).cast("double").alias("pub_sig_hits"), _or_zero(F.sum(sig)).alias("pub_sig_score_sum"))


# ---- comparisons -------------------------------------------------------------------


def miner_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes, overlap, Jaccard and exclusives of two mined lists per dataset, and overall."""
    both = (a.select(*SEQ, F.lit(True).alias("in_a")).join(b.select(*SEQ, F.lit(True).alias("in_b")), SEQ, "full"))
    ia, ib = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    raw = both.groupBy("dataset").agg(
        F.count("in_a").alias("a_count"), F.count("in_b").alias("b_count"), F.count_if(ia & ib).alias("overlap"),
        F.count_if(ia & ~ib).alias("a_only"), F.count_if(ib & ~ia).alias("b_only"))
    some = (F.col("a_count") > 0) & (F.col("b_count") > 0)
    keep = lambda c: F.when(some, F.col(c)).otherwise(F.lit(0).cast("bigint")).alias(c)
    jaccard = F.when(some, F.col("overlap") / (F.col("overlap") + F.col("a_only") + F.col("b_only"))).otherwise(F.lit(0.0))
    per = raw.select("dataset", "a_count", "b_count", jaccard.alias("jaccard"), keep("overlap"), keep("a_only"), keep("b_only"))
    total = per.agg(F.sum("a_count").alias("a_count"), F.sum("b_count").alias("b_count"),
                    F.avg(F.when(F.col("jaccard") > 0, F.col("jaccard"))).alias("jaccard"),
                    F.sum("overlap").alias("overlap"), F.sum("a_only").alias("a_only"), F.sum("b_only").alias("b_only"))
    return per.unionByName(total.withColumn("dataset", F.lit("overall")))


def clonotype_counts(df: DataFrame, threshold: int = 5) -> DataFrame:
    """Distinct and frequent sequences of each class, counting rows."""
    counts = (df.where(F.col("junction_aa").isNotNull()).groupBy("dataset", "label_positive", "junction_aa")
              .agg(F.count(F.lit(1)).alias("n")))
    return counts.groupBy("dataset", "label_positive").agg(
        F.count(F.lit(1)).alias("n_unique"), F.count_if(F.col("n") >= threshold).alias("n_frequent"), F.sum("n").alias("n_rows"))


def clonotype_top(df: DataFrame, threshold: int = 5, k: int = 20) -> DataFrame:
    """Most frequent sequences of each class."""
    counts = (df.where(F.col("junction_aa").isNotNull()).groupBy("dataset", "label_positive", "junction_aa")
              .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold))
    return top_k(counts, ["dataset", "label_positive"], [F.desc("n"), F.asc("junction_aa")], k)


def shared_sequences(df: DataFrame) -> DataFrame:
    """Sequences seen in both classes of a dataset."""
    seqs = df.where(F.col("junction_aa").isNotNull()).groupBy(*SEQ).agg(
        F.bool_or("label_positive").alias("p"), F.bool_or(~F.col("label_positive")).alias("n"))
    return seqs.where("p AND n").select(*SEQ)
