"""Cohort, prediction and submission reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from clonara.constants import EXPECTED_ROWS, REP, SENTINEL_PROBABILITY, SEQUENCES_PER_DATASET, SUBMISSION_COLUMNS
from clonara.operators.evaluate import correlation
from clonara.operators.ranks import log_bin, quantiles, top_k, unit_bin


def _long(df: DataFrame, keys: list[str], names: list[str], label: str = "measure") -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias(label), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(*keys, F.inline(cells))


# ---- submissions and predictions ---------------------------------------------------


def validate_submission(df: DataFrame, expected_rows: int = EXPECTED_ROWS, per_dataset: int = SEQUENCES_PER_DATASET) -> DataFrame:
    """(check, ok, observed) rows from one pass over the submission."""
    types = dict(df.dtypes)
    typed = all(types.get(c) == ("double" if c == "label_positive_probability" else "string") for c in SUBMISSION_COLUMNS)
    ordered = df.columns == SUBMISSION_COLUMNS
    p = F.col("label_positive_probability")
    sequence, train = p == SENTINEL_PROBABILITY, F.col("dataset").startswith("train_dataset_")
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    null_any = F.lit(False)
    for c in SUBMISSION_COLUMNS:
        null_any = null_any | F.col(c).isNull()
    per = df.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("rows"), n(null_any).alias("nulls"), n(~sequence & ((p < 0) | (p > 1))).alias("range"),
        n(~sequence).alias("predictions"), n(sequence).alias("sequences"),
        n(sequence & ~F.col("ID").contains("_seq_top_")).alias("ids"),
        n(F.col("ID").contains("_seq_top_") & ~sequence).alias("sentinel"),
        F.max(train).alias("train"))
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    wrong = F.count_if(F.col("train") & (F.col("sequences") != per_dataset))
    totals = per.agg(s("rows").alias("rows"), s("nulls").alias("nulls"), s("range").alias("range"),
                     s("predictions").alias("predictions"), s("sequences").alias("sequences"), s("ids").alias("ids"),
                     s("sentinel").alias("sentinel"), wrong.alias("sizes"))
    col = F.col
    checks = [("row_count", col("rows") == expected_rows, col("rows")),
              ("column_order", F.lit(ordered), F.lit(len(df.columns)).cast("bigint")),
              ("column_types", F.lit(typed), F.lit(len(df.columns)).cast("bigint")),
              ("no_nulls", col("nulls") == 0, col("nulls")),
              ("probability_range", col("range") == 0, col("range")),
              ("prediction_rows", col("predictions") > 0, col("predictions")),
              ("sequence_rows", col("sequences") > 0, col("sequences")),
              ("sequence_ids", col("ids") == 0, col("ids")),
              ("sequence_sentinel", col("sentinel") == 0, col("sentinel")),
              ("sequences_per_dataset", col("sizes") == 0, col("sizes"))]
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("check"), ok.alias("ok"), seen.cast("bigint").alias("observed")) for c, ok, seen in checks])))


def prediction_distribution(df: DataFrame, group: list[str], p: str = "p") -> DataFrame:
    """Moments, quartiles and the strong and uncertain bands."""
    c, n = F.col(p), F.count(p)
    bands = {"near_zero": c < 0.1, "near_half": (c >= 0.4) & (c <= 0.6), "near_one": c > 0.9}
    out = [n.alias("n"), F.avg(p).alias("mean"), F.stddev_samp(p).alias("std"), F.min(p).alias("min"), F.max(p).alias("max")]
    for name, cond in bands.items():
        out += [F.count_if(cond).alias(name), (100 * F.count_if(cond) / F.nullif(n, F.lit(0))).alias(f"{name}_pct")]
    quartiles = quantiles(df, group, p, {"p25": 0.25, "median": 0.5, "p75": 0.75}, unit_bin(p))
    return df.groupBy(*group).agg(*out).join(quartiles, group)


def prediction_agreement(pairs: DataFrame, group: list[str], a: str = "p_a", b: str = "p_b") -> DataFrame:
    """Correlation, mean difference and agreement at one half of two matched predictions."""
    x, y = F.col(a), F.col(b)
    n = F.count(F.lit(1))
    hi_a, hi_b = x > 0.5, y > 0.5
    return pairs.groupBy(*group).agg(
        n.alias("n"), correlation(a, b).alias("correlation"), F.avg(F.abs(x - y)).alias("mae"),
        (F.count_if(hi_a == hi_b) / n).alias("agreement"), F.count_if(hi_a != hi_b).alias("disagreements"),
        F.count_if(hi_a & ~hi_b).alias("only_a"), F.count_if(~hi_a & hi_b).alias("only_b"))


def confidence_bands(df: DataFrame, p: str = "p") -> DataFrame:
    """Rows per fifth of the probability scale and the usual flags, per dataset."""
    c = F.col(p)
    band = F.least(F.floor(c * 5), F.lit(4))
    return df.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        *[F.count_if(band == i).alias(f"band_{i}") for i in range(5)],
        F.count_if((c >= 0.4) & (c <= 0.6)).alias("low_confidence"),
        F.count_if(c > 0.8).alias("very_high"), F.count_if(c < 0.2).alias("very_low"))


def default_score(repertoires: DataFrame, scores: DataFrame, p: str = "p", default: float = 0.5) -> DataFrame:
    """Every repertoire with a score; one half where there is none."""
    return repertoires.join(scores, "ID", "left").withColumn(p, F.coalesce(F.col(p), F.lit(default)))


def cv_summary(scores: DataFrame, value: str = "auc") -> DataFrame:
    """Mean and deviation of fold scores per dataset, and the mean over datasets."""
    per = scores.groupBy("dataset").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("folds"))
    overall = per.agg(F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("std"), F.sum("folds").alias("folds"))
    return per.unionByName(overall.withColumn("dataset", F.lit("overall")))


def feature_families(features: DataFrame) -> DataFrame:
    """Distinct features per family, told by name."""
    f = F.col("feature")
    # Diversity feature names.
    diversity = ["shannon", "gini_simpson", "clonality", "d50", "richness", "richness_log"]
    family = (F.when(f.rlike("^k(mer_)?[0-9]"), "kmer").when(f.rlike("^(v|j|vj)_"), "gene").when(f.isin(diversity), "diversity")
              .when(f.startswith("len_"), "length").otherwise("other"))
    return features.select("feature").distinct().groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"))


# ---- cohorts -----------------------------------------------------------------------


def metadata_summary(metadata: DataFrame) -> DataFrame:
    """Class balance, age and value counts per dataset, as (field, item, value) rows."""
    y, n = F.col("label_positive"), F.count(F.lit(1))
    numbers = metadata.groupBy("dataset").agg(
        n.alias("n"), F.count_if(y).alias("positive"), F.count_if(~y).alias("negative"),
        (100 * F.count_if(y) / n).alias("positive_pct"), (100 * F.count_if(~y) / n).alias("negative_pct"),
        F.avg("age").alias("age_mean"), F.stddev_samp("age").alias("age_std"), F.min("age").alias("age_min"), F.max("age").alias("age_max"),
        F.count_distinct("sequencing_run_id").alias("batches"))
    numbers = _long(numbers, ["dataset"], [c for c in numbers.columns if c != "dataset"], "item").withColumn("field", F.lit("cohort"))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("item")) for f in ("sex", "race", "sequencing_run_id")])
    counts = (metadata.select("dataset", F.inline(fields)).where(F.col("item").isNotNull()).groupBy("dataset", "field", "item")
              .agg(F.count(F.lit(1)).cast("double").alias("value")))
    return numbers.select("dataset", "field", "item", "value").unionByName(counts.select("dataset", "field", "item", "value"))


def repertoire_stats(df: DataFrame) -> DataFrame:
    """Size, distinct sequences and genes, length and template summary, top genes and their share.

    Values of all three text columns are counted in one grouped pass; distinct counts,
    lengths and top genes are read from those counts.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("item")) for k, c in
                      (("s", "junction_aa"), ("v", "v_call"), ("j", "j_call"))])
    counts = df.select(*REP, F.inline(kinds)).groupBy(*REP, "kind", "item").agg(F.count(F.lit(1)).alias("c"))
    kind, known = F.col("kind"), F.col("item").isNotNull()
    of = lambda k: (kind == k) & known
    l = F.when(of("s"), F.length("item"))

    def top(k: str) -> Column:
        # most rows first, then the smaller name
        return F.min(F.when(of(k), F.struct((-F.col("c")).alias("c"), F.col("item").alias("item"))))

    n = F.sum(F.when(kind == "s", F.col("c")))
    text = counts.groupBy(*REP).agg(
        n.alias("n_sequences"), F.count_if(of("s")).alias("unique_junctions"), F.count_if(of("v")).alias("unique_v_genes"),
        F.count_if(of("j")).alias("unique_j_genes"),
        (F.sum(l * F.col("c")) / F.nullif(F.sum(F.when(of("s"), F.col("c"))), F.lit(0))).alias("mean_cdr3_length"),
        F.percentile(l, F.lit(0.5), F.when(of("s"), F.col("c")).otherwise(F.lit(0))).alias("median_cdr3_length"),
        top("v").alias("_v"), top("j").alias("_j"))
    sizes = df.groupBy(*REP, "templates").agg(F.count(F.lit(1)).alias("c"))
    t, c = F.col("templates"), F.col("c")
    known_c = F.when(t.isNotNull(), c).otherwise(F.lit(0))
    total, rows = F.coalesce(F.sum(t * c), F.lit(0.0)), F.sum(c)
    templates = sizes.groupBy(*REP).agg(
        (F.sum(t * c) / F.nullif(F.sum(known_c), F.lit(0))).alias("mean_templates"),
        F.percentile(t, F.lit(0.5), known_c).alias("median_templates"),
        F.when(total > 1, (total - rows) / (total - 1)).otherwise(F.lit(0.0)).alias("clonality_index"))
    share = lambda s: F.coalesce(-F.col(f"{s}.c") / F.col("n_sequences"), F.lit(0.0))
    return text.join(templates, REP).select(
        *REP, "n_sequences", "unique_junctions", "unique_v_genes", "unique_j_genes", "mean_cdr3_length", "median_cdr3_length",
        "mean_templates", "median_templates", "clonality_index", F.col("_v.item").alias("top_v_gene"), share("_v").alias("top_v_freq"),
        F.col("_j.item").alias("top_j_gene"), share("_j").alias("top_j_freq"))


# Repertoire statistics compared between classes.
COMPARED = ["n_sequences", "unique_junctions", "mean_cdr3_length", "clonality_index"]


def class_comparison(stats: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Class means, their difference and the pooled t statistic with its degrees of freedom."""
    y = F.col("label_positive")
    rows = _long(stats, ["dataset", "label_positive"], features or COMPARED, "feature").where(F.col("value").isNotNull())
    pick = lambda f, cond: f(F.when(cond, F.col("value")))
    g = rows.groupBy("dataset", "feature").agg(
        pick(F.count, y).alias("n1"), pick(F.count, ~y).alias("n0"), pick(F.avg, y).alias("m1"), pick(F.avg, ~y).alias("m0"),
        pick(F.var_samp, y).alias("v1"), pick(F.var_samp, ~y).alias("v0"))
    df_ = F.col("n1") + F.col("n0") - 2
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / F.nullif(df_, F.lit(0))
    se = F.sqrt(pooled * (1 / F.nullif(F.col("n1"), F.lit(0)) + 1 / F.nullif(F.col("n0"), F.lit(0))))
    diff = F.col("m1") - F.col("m0")
    return g.select("dataset", "feature", F.col("m1").alias("positive_mean"), F.col("m0").alias("negative_mean"), diff.alias("difference"),
                    (100 * (F.col("m1") / F.nullif(F.col("m0"), F.lit(0.0)) - 1)).alias("difference_pct"),
                    (diff / F.nullif(se, F.lit(0.0))).alias("t"), df_.alias("df"))


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p value of Student's t for whole degrees of freedom: the finite series in the angle of t."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    cosine, even = F.cos(theta), df % 2 == 0
    first = F.when(even, F.lit(1.0)).otherwise(cosine)
    terms = F.floor(F.when(even, df - 2).otherwise(df - 3) / 2).cast("int")
    start = F.struct(first.alias("term"), first.alias("sum"))

    def add(acc: Column, k: Column) -> Column:
        ratio = F.when(even, (2 * k - 1) / (2 * k)).otherwise(2 * k / (2 * k + 1))
        term = acc["term"] * ratio * cosine * cosine
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    counted = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    series = F.sin(theta) * F.aggregate(counted, start, add, lambda acc: acc["sum"])
    inside = F.when(even, series).when(df == 1, theta * 2 / math.pi).otherwise((theta + series) * 2 / math.pi)
    return F.when(df > 0, F.greatest(1 - inside, F.lit(0.0))).otherwise(F.lit(float("nan")))


def class_ttest(stats: DataFrame, features: list[str] | None = None) -> DataFrame:
    """The comparison with p values; without a t there is none."""
    return class_comparison(stats, features).withColumn("p_value", F.coalesce(student_p(F.col("t"), F.col("df").cast("double")), F.lit(float("nan"))))


def top_gene_by_class(stats: DataFrame, gene: str = "top_v_gene", k: int = 10) -> DataFrame:
    """Most common top gene of each class with its share of the class's repertoires."""
    group = ["dataset", "label_positive"]
    counts = stats.groupBy(*group, gene).agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*group))).where(F.col(gene).isNotNull())
    return top_k(shares, group, [F.desc("n"), F.asc(gene)], k)


def batch_chi2(metadata: DataFrame, batch: str = "sequencing_run_id") -> DataFrame:
    """Chi-square statistic of batch against class per dataset (Yates at one degree of freedom)."""
    cells = metadata.where(F.col(batch).isNotNull()).groupBy("dataset", batch).agg(
        F.count_if("label_positive").alias("p"), F.count_if(~F.col("label_positive")).alias("q"))
    w = Window.partitionBy("dataset")
    c = (cells.withColumn("tp", F.sum("p").over(w)).withColumn("tq", F.sum("q").over(w)).withColumn("rows", F.count(F.lit(1)).over(w))
         .withColumn("dof", F.when((F.col("tp") > 0) & (F.col("tq") > 0), F.col("rows") - 1).otherwise(F.lit(0))))
    total = F.col("tp") + F.col("tq")

    def term(seen: Column, column_total: Column) -> Column:
        expected = (F.col("p") + F.col("q")) * column_total / total
        gap = F.abs(seen - expected)
        gap = F.when(F.col("dof") == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return F.coalesce(gap * gap / F.nullif(expected, F.lit(0.0)), F.lit(0.0))

    return c.groupBy("dataset").agg(F.sum(term(F.col("p"), F.col("tp")) + term(F.col("q"), F.col("tq"))).alias("chi2"),
                                    F.first("dof").alias("dof"))


def dataset_comparison(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Repertoires, positives, rate and typical size of each dataset."""
    sizes = df.groupBy(*REP).agg(F.count(F.lit(1)).alias("size"))
    sized = metadata.select(*REP, "label_positive").join(sizes, REP, "left")
    median = quantiles(sized, ["dataset"], "size", {"median_repertoire_size": 0.5}, log_bin("size"))
    return sized.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_repertoires"), F.count_if("label_positive").alias("n_positive"),
        (F.count_if("label_positive") / F.count(F.lit(1))).alias("positive_rate"),
        F.avg("size").alias("mean_repertoire_size")).join(median, "dataset", "left")


def dataset_vs_others(comparison: DataFrame) -> DataFrame:
    """Each dataset beside the mean of the others (one row per dataset)."""
    everyone = Window.partitionBy(F.lit(0))
    out = []
    for c in ("positive_rate", "n_repertoires", "mean_repertoire_size"):
        others = (F.sum(c).over(everyone) - F.coalesce(F.col(c), F.lit(0.0))) / F.nullif(
            F.count(c).over(everyone) - F.when(F.col(c).isNotNull(), 1).otherwise(0), F.lit(0))
        out += [F.col(c).cast("double").alias(c), others.alias(f"others_{c}")]
    return comparison.select("dataset", *out)
