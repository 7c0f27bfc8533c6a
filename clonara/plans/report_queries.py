"""Registered joins, set operations, scores, blends, reports and pooling."""

from pyspark.sql import functions as F

from clonara.constants import REP
from clonara.operators import align, blend, clonotypes, evaluate, genes, kmers, lengths, pooling, reports
from clonara.plans.clonotype_queries import enriched_cte, fisher_cte
from clonara.plans.profile_queries import rounded
from clonara.plans.registry import query
from clonara.sources.views import Tables


def submission(t: Tables, model: str):
    """One model's predictions in the output layout."""
    return align.submission_rows(t.predictions, F.col(model))


def full_submission(t: Tables, model: str = "p_a"):
    """Predictions plus mined sequences as sequence rows."""
    mined = clonotypes.mine_enriched(t.rearrangements, t.metadata)
    rows = mined.withColumn("ID", F.concat("dataset", F.lit("_seq_top_"), "junction_aa"))
    return align.build_submission(submission(t, model), align.submission_rows(rows, sequence=True))


_SUB = """s AS (SELECT ID, dataset, p_a AS label_positive_probability, '-999.0' AS junction_aa, '-999.0' AS v_call, '-999.0' AS j_call FROM predictions
UNION ALL SELECT dataset || '_seq_top_' || junction_aa, dataset, -999.0::DOUBLE, junction_aa, '-999.0', '-999.0' FROM mined)"""

# ---- joins and set operations ------------------------------------------------------


@query("align_labels", """WITH f AS (SELECT dataset, repertoire_id, count(*)::DOUBLE AS value FROM rearrangements GROUP BY ALL)
SELECT dataset, repertoire_id, value, label_positive FROM f JOIN metadata USING (dataset, repertoire_id)""")
def _(t):
    f = t.rearrangements.groupBy(*REP).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return align.align_labels(f, t.metadata)


@query("join_submissions", "SELECT ID, dataset, p_a, p_b FROM predictions")
def _(t):
    return align.join_submissions(submission(t, "p_a"), submission(t, "p_b"))


@query("align_features", """WITH c AS (SELECT dataset, repertoire_id, 'v_' || v_call AS feature, count(*)::DOUBLE AS value FROM rearrangements
  WHERE v_call IS NOT NULL GROUP BY ALL), v AS (SELECT DISTINCT feature FROM c WHERE dataset = 'train_dataset_1'),
r AS (SELECT DISTINCT dataset, repertoire_id FROM rearrangements WHERE dataset <> 'train_dataset_1')
SELECT r.dataset, r.repertoire_id, v.feature, coalesce(c.value, 0) AS value FROM r CROSS JOIN v LEFT JOIN c
ON c.dataset = r.dataset AND c.repertoire_id = r.repertoire_id AND c.feature = v.feature""")
def _(t):
    c = (t.rearrangements.where(F.col("v_call").isNotNull()).groupBy(*REP, F.concat(F.lit("v_"), "v_call").alias("feature"))
         .agg(F.count(F.lit(1)).cast("double").alias("value")))
    train = F.col("dataset") == "train_dataset_1"
    return align.align_features(c, c.where(train).select("feature").distinct(), t.rearrangements.where(~train).select(*REP).distinct())


_PUB = "p AS (SELECT dataset, junction_aa FROM rearrangements WHERE junction_aa IS NOT NULL GROUP BY ALL HAVING count(DISTINCT repertoire_id) >= 6)"


def _public(t):
    return clonotypes.public_sequences(t.rearrangements, 6)


@query("semi_public", f"WITH {_PUB} SELECT dataset, repertoire_id, junction_aa, v_call FROM rearrangements SEMI JOIN p USING (dataset, junction_aa)")
def _(t):
    return align.members(t.rearrangements, _public(t), ["dataset", "junction_aa"]).select(*REP, "junction_aa", "v_call")


@query("anti_public", f"WITH {_PUB} SELECT dataset, repertoire_id, junction_aa, v_call FROM rearrangements ANTI JOIN p USING (dataset, junction_aa)")
def _(t):
    return align.non_members(t.rearrangements, _public(t), ["dataset", "junction_aa"]).select(*REP, "junction_aa", "v_call")


def _class(t, positive):
    y = F.col("label_positive")
    return t.rearrangements.where((y if positive else ~y) & F.col("junction_aa").isNotNull()).select("junction_aa")


_SIDE = "SELECT junction_aa FROM rearrangements WHERE {} label_positive AND junction_aa IS NOT NULL"


@query("set_intersect", f"{_SIDE.format('')} INTERSECT {_SIDE.format('NOT')}")
def _(t):
    return _class(t, True).intersect(_class(t, False))


@query("set_union", f"{_SIDE.format('')} UNION {_SIDE.format('NOT')}")
def _(t):
    return _class(t, True).union(_class(t, False)).distinct()


@query("set_except", f"{_SIDE.format('')} EXCEPT {_SIDE.format('NOT')}")
def _(t):
    return _class(t, True).subtract(_class(t, False))


@query("build_submission", f"WITH {enriched_cte()}, {_SUB} SELECT * FROM s")
def _(t):
    return full_submission(t)


@query("split_tasks", f"""WITH {enriched_cte()}, {_SUB} SELECT dataset, CASE WHEN label_positive_probability <> -999 THEN 'A' ELSE 'B' END AS task,
count(*) AS n FROM s GROUP BY ALL""")
def _(t):
    s = full_submission(t)
    parts = align.task_a(s).select("dataset", F.lit("A").alias("task")).union(align.task_b(s).select("dataset", F.lit("B").alias("task")))
    return parts.groupBy("dataset", "task").agg(F.count(F.lit(1)).alias("n"))


@query("batch_crosstab", """SELECT sequencing_run_id, round(count(*) FILTER (label_positive) / count(*), 6) AS label_positive_true,
round(count(*) FILTER (NOT label_positive) / count(*), 6) AS label_positive_false FROM metadata GROUP BY ALL""")
def _(t):
    return rounded(align.crosstab(t.metadata, "sequencing_run_id", "label_positive", [True, False]))


_WIDE = [f"v_fam_TRBV{i}" for i in range(1, 6)]


@query("pivot_features", "SELECT dataset, repertoire_id, " + ", ".join(
    f"round(count(*) FILTER (split_part(v_call, '-', 1) = 'TRBV{i}') / count(*), 6)::DOUBLE AS v_fam_TRBV{i}" for i in range(1, 6))
    + " FROM rearrangements GROUP BY ALL")
def _(t):
    return rounded(align.pivot_features(genes.family_usage(t.rearrangements), _WIDE))


# ---- scores ------------------------------------------------------------------------

_BOTH = """b AS (SELECT ID, dataset, label_positive, 'a' AS model, p_a AS p FROM predictions
UNION ALL SELECT ID, dataset, label_positive, 'b', p_b FROM predictions)"""


def both_models(t: Tables):
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("p")) for m in ("a", "b")])
    return t.predictions.select("ID", "dataset", "label_positive", F.inline(cells))


_AUC = """r AS (SELECT {g}, label_positive, rank() OVER (PARTITION BY {g} ORDER BY p) + (count(*) OVER (PARTITION BY {g}, p) - 1) / 2.0::DOUBLE AS rk FROM {t}),
auc AS (SELECT {g}, (sum(rk) FILTER (label_positive) - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0) AS auc FROM (SELECT *,
  count(*) FILTER (label_positive) OVER (PARTITION BY {g}) AS n1, count(*) FILTER (NOT label_positive) OVER (PARTITION BY {g}) AS n0 FROM r) GROUP BY {g}, n1, n0)"""


@query("roc_auc", f"WITH {_BOTH}, {_AUC.format(g='dataset, model', t='b')} SELECT dataset, model, round(auc, 6) AS auc FROM auc")
def _(t):
    return rounded(evaluate.roc_auc(both_models(t), ["dataset", "model"]))


@query("log_loss", f"""WITH {_BOTH} SELECT dataset, model, round(avg(-ln(CASE WHEN label_positive THEN greatest(p, 2.220446049250313e-16)
ELSE 1 - least(p, 1 - 2.220446049250313e-16) END)), 6) AS log_loss FROM b GROUP BY ALL""")
def _(t):
    return rounded(evaluate.log_loss(both_models(t), ["dataset", "model"]))


@query("balanced_accuracy", f"""WITH {_BOTH} SELECT dataset, model, round((count(*) FILTER (label_positive AND p >= 0.5) / count(*) FILTER (label_positive)
+ count(*) FILTER (NOT label_positive AND p < 0.5) / count(*) FILTER (NOT label_positive)) / 2, 6) AS balanced_accuracy FROM b GROUP BY ALL""")
def _(t):
    return rounded(evaluate.balanced_accuracy(both_models(t), ["dataset", "model"]))


_JAC = """j AS (SELECT coalesce(a.dataset, b.dataset) AS dataset, count(*) FILTER (a.junction_aa IS NOT NULL AND b.junction_aa IS NOT NULL) / count(*) AS jaccard
FROM x_mined a FULL JOIN y_mined b ON a.dataset = b.dataset AND a.junction_aa = b.junction_aa GROUP BY ALL)"""


def _jaccard(t):
    a = clonotypes.mine_enriched(t.rearrangements, t.metadata)
    b = clonotypes.mine_fisher(t.rearrangements, t.metadata)
    return evaluate.jaccard(a, b, ["dataset", "junction_aa"], ["dataset"])


@query("jaccard", f"WITH {enriched_cte(p='x_')}, {fisher_cte('y_')}, {_JAC} SELECT dataset, round(jaccard, 6) AS jaccard FROM j")
def _(t):
    return rounded(_jaccard(t))


@query("combined_score", f"""WITH {enriched_cte(p='x_')}, {fisher_cte('y_')}, {_JAC}, q AS (SELECT dataset, label_positive, p_a AS p FROM predictions), {_AUC.format(g='dataset', t='q')},
w AS (SELECT dataset, auc AS value, 2.0::DOUBLE AS weight FROM auc UNION ALL SELECT dataset, jaccard, 1.0 FROM j)
SELECT round(sum(value * weight) / sum(weight), 6) AS combined_score FROM w WHERE value IS NOT NULL""")
def _(t):
    auc = evaluate.roc_auc(t.predictions.withColumnRenamed("p_a", "p"), ["dataset"])
    scores = (auc.select("dataset", F.col("auc").alias("value"), F.lit(2.0).alias("weight"))
              .union(_jaccard(t).select("dataset", "jaccard", F.lit(1.0))))
    return rounded(evaluate.combined_score(scores))


# ---- blends ------------------------------------------------------------------------

_ID = "CAST(regexp_extract(dataset, '[0-9]+') AS INT)"
_W = f"CASE {_ID} WHEN 5 THEN 1.0::DOUBLE WHEN 6 THEN 1.0 WHEN 7 THEN 0.85 WHEN 8 THEN 0.85 ELSE 0.9 END"


@query("blend_global", "SELECT ID, dataset, round(0.9::DOUBLE * p_a + (1 - 0.9::DOUBLE) * p_b, 6) AS label_positive_probability FROM predictions")
def _(t):
    return rounded(blend.blend_global(submission(t, "p_a"), submission(t, "p_b")))


@query("blend_by_dataset", f"SELECT ID, dataset, round(p_a * w + p_b * (1 - w), 6) AS label_positive_probability FROM (SELECT *, {_W} AS w FROM predictions)")
def _(t):
    return rounded(blend.blend_by_dataset(submission(t, "p_a"), submission(t, "p_b")))


@query("blend_drift", f"""SELECT round(avg(d), 6) AS mean_diff, round(max(d), 6) AS max_diff, count(*) FILTER (d > 0.05::DOUBLE) AS n_large
FROM (SELECT abs(p_a - (p_a * w + p_b * (1 - w))) AS d FROM (SELECT *, {_W} AS w FROM predictions))""")
def _(t):
    a = submission(t, "p_a")
    return rounded(blend.blend_drift(a, blend.blend_by_dataset(a, submission(t, "p_b"))))


# ---- prediction and submission reports ---------------------------------------------


@query("validate_submission", f"""WITH {enriched_cte()}, {_SUB}, d AS (SELECT dataset, count(*) AS n FROM s WHERE label_positive_probability = -999 GROUP BY ALL),
o AS (SELECT count(*) AS rows, count(*) FILTER (label_positive_probability <> -999) AS a, count(*) FILTER (label_positive_probability = -999) AS b FROM s)
SELECT 'row_count' AS "check", rows = 404213 AS ok, rows AS observed FROM o UNION ALL SELECT 'column_order', true, 6 UNION ALL SELECT 'column_types', true, 6
UNION ALL SELECT 'no_nulls', true, 0 UNION ALL SELECT 'probability_range', true, 0 UNION ALL SELECT 'prediction_rows', a > 0, a FROM o
UNION ALL SELECT 'sequence_rows', b > 0, b FROM o UNION ALL SELECT 'sequence_ids', true, 0 UNION ALL SELECT 'sequence_sentinel', true, 0
UNION ALL SELECT 'sequences_per_dataset', count(*) = 0, count(*) FROM d WHERE n <> 50000""")
def _(t):
    return reports.validate_submission(full_submission(t))


@query("pred_distribution", f"""WITH {_BOTH} SELECT dataset, model, count(*) AS n, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS std, min(p) AS min,
round(quantile_cont(p, 0.25), 6) AS p25, round(quantile_cont(p, 0.5), 6) AS median, round(quantile_cont(p, 0.75), 6) AS p75, max(p) AS max,
count(*) FILTER (p < 0.1::DOUBLE) AS near_zero, round(100 * count(*) FILTER (p < 0.1::DOUBLE) / count(*), 6) AS near_zero_pct,
count(*) FILTER (p >= 0.4::DOUBLE AND p <= 0.6::DOUBLE) AS near_half, round(100 * count(*) FILTER (p >= 0.4::DOUBLE AND p <= 0.6::DOUBLE) / count(*), 6) AS near_half_pct,
count(*) FILTER (p > 0.9::DOUBLE) AS near_one, round(100 * count(*) FILTER (p > 0.9::DOUBLE) / count(*), 6) AS near_one_pct FROM b GROUP BY ALL""")
def _(t):
    return rounded(reports.prediction_distribution(both_models(t), ["dataset", "model"]))


@query("pred_agreement", """SELECT dataset, count(*) AS n, round(corr(p_a, p_b), 6) AS correlation, round(avg(abs(p_a - p_b)), 6) AS mae,
round(count(*) FILTER ((p_a > 0.5) = (p_b > 0.5)) / count(*), 6) AS agreement, count(*) FILTER ((p_a > 0.5) <> (p_b > 0.5)) AS disagreements,
count(*) FILTER (p_a > 0.5 AND p_b <= 0.5) AS only_a, count(*) FILTER (p_a <= 0.5 AND p_b > 0.5) AS only_b FROM predictions GROUP BY ALL""")
def _(t):
    pairs = align.join_submissions(submission(t, "p_a"), submission(t, "p_b"))
    return rounded(reports.prediction_agreement(pairs, ["dataset"]))


@query("confidence_bands", "SELECT dataset, count(*) AS n, round(avg(p_a), 6) AS mean, round(stddev_samp(p_a), 6) AS std, " + ", ".join(
    f"count(*) FILTER (least(floor(p_a * 5), 4) = {i}) AS band_{i}" for i in range(5)) + """,
count(*) FILTER (p_a >= 0.4::DOUBLE AND p_a <= 0.6::DOUBLE) AS low_confidence, count(*) FILTER (p_a > 0.8::DOUBLE) AS very_high,
count(*) FILTER (p_a < 0.2::DOUBLE) AS very_low FROM predictions GROUP BY ALL""")
def _(t):
    return rounded(reports.confidence_bands(t.predictions, "p_a"))


@query("default_score", """WITH s AS (SELECT ID, p_a AS p FROM predictions WHERE p_a < 0.7)
SELECT repertoire_id AS ID, coalesce(p, 0.5)::DOUBLE AS p FROM metadata LEFT JOIN s ON s.ID = repertoire_id""")
def _(t):
    scores = t.predictions.where(F.col("p_a") < 0.7).select("ID", F.col("p_a").alias("p"))
    return reports.default_score(t.metadata.select(F.col("repertoire_id").alias("ID")), scores)


_FOLD = "CAST(substr(ID, 5) AS INT) % 3"


@query("cv_summary", f"""WITH q AS (SELECT dataset, {_FOLD} AS fold, label_positive, p_a AS p FROM predictions), {_AUC.format(g='dataset, fold', t='q')},
per AS (SELECT dataset, avg(auc) AS mean, stddev_pop(auc) AS std, count(auc) AS folds FROM auc GROUP BY ALL)
SELECT dataset, round(mean, 6) AS mean, round(std, 6) AS std, folds FROM per
UNION ALL SELECT 'overall', round(avg(mean), 6), round(stddev_pop(mean), 6), sum(folds)::BIGINT FROM per""")
def _(t):
    p = t.predictions.select("dataset", "label_positive", F.col("p_a").alias("p"), (F.substring("ID", 5, 6).cast("int") % 3).alias("fold"))
    return rounded(reports.cv_summary(evaluate.roc_auc(p, ["dataset", "fold"])))


@query("feature_families", """WITH w AS (SELECT DISTINCT substr(junction_aa, i, 3) AS kmer FROM (SELECT junction_aa, unnest(range(1, length(junction_aa) - 1)) AS i
  FROM rearrangements WHERE length(junction_aa) >= 3)), g AS (SELECT DISTINCT 'v_' || split_part(v_call, '-', 1) AS f FROM rearrangements WHERE v_call IS NOT NULL
  UNION SELECT DISTINCT 'j_' || split_part(j_call, '-', 1) FROM rearrangements WHERE j_call <> ''
  UNION SELECT DISTINCT 'vj_' || split_part(v_call, '-', 1) || '_' || split_part(j_call, '-', 1) FROM rearrangements WHERE v_call IS NOT NULL AND j_call <> '')
SELECT 'kmer' AS family, count(*) AS n FROM w UNION ALL SELECT 'gene', count(*) FROM g UNION ALL SELECT 'length', 7 UNION ALL SELECT 'diversity', 6""")
def _(t):
    from clonara.operators import diversity

    r = t.rearrangements
    wide = lambda df: reports._long(df, REP, [c for c in df.columns if c not in REP], "feature")
    parts = [kmers.kmer_multiscale(r, (3,)), genes.family_pair_usage(r), wide(diversity.sequence_diversity(r)), wide(lengths.length_stats_full(r))]
    return reports.feature_families(align.union_all(parts))


# ---- cohort reports ----------------------------------------------------------------


@query("metadata_summary", """WITH n AS (SELECT dataset, count(*)::DOUBLE AS n, count(*) FILTER (label_positive)::DOUBLE AS positive,
  count(*) FILTER (NOT label_positive)::DOUBLE AS negative, 100 * count(*) FILTER (label_positive) / count(*) AS positive_pct,
  100 * count(*) FILTER (NOT label_positive) / count(*) AS negative_pct, avg(age) AS age_mean, stddev_samp(age) AS age_std, min(age)::DOUBLE AS age_min,
  max(age)::DOUBLE AS age_max, count(DISTINCT sequencing_run_id)::DOUBLE AS batches FROM metadata GROUP BY ALL)
SELECT dataset, 'cohort' AS field, item, round(value, 6) AS value FROM n UNPIVOT INCLUDE NULLS (value FOR item IN (n, positive, negative, positive_pct, negative_pct, age_mean, age_std, age_min, age_max, batches))
UNION ALL SELECT dataset, 'sex', sex, count(*)::DOUBLE FROM metadata WHERE sex IS NOT NULL GROUP BY ALL
UNION ALL SELECT dataset, 'race', race, count(*)::DOUBLE FROM metadata WHERE race IS NOT NULL GROUP BY ALL
UNION ALL SELECT dataset, 'sequencing_run_id', sequencing_run_id, count(*)::DOUBLE FROM metadata GROUP BY ALL""")
def _(t):
    return rounded(reports.metadata_summary(t.metadata))


_TOP = """(SELECT * FROM (SELECT dataset, repertoire_id, {c} AS g, count(*) AS n FROM rearrangements WHERE {c} IS NOT NULL GROUP BY dataset, repertoire_id, {c})
QUALIFY row_number() OVER (PARTITION BY dataset, repertoire_id ORDER BY n DESC, g) = 1)"""
_STATS = f"""st AS (SELECT dataset, repertoire_id, count(*) AS n_sequences, count(DISTINCT junction_aa) AS unique_junctions, count(DISTINCT v_call) AS unique_v_genes,
  count(DISTINCT j_call) AS unique_j_genes, avg(length(junction_aa)) AS mean_cdr3_length, quantile_cont(length(junction_aa), 0.5)::DOUBLE AS median_cdr3_length,
  avg(templates) AS mean_templates, quantile_cont(templates, 0.5)::DOUBLE AS median_templates,
  CASE WHEN sum(templates) > 1 THEN (sum(templates) - count(*)) / (sum(templates) - 1) ELSE 0 END AS clonality_index FROM rearrangements GROUP BY ALL),
s AS (SELECT st.*, v.g AS top_v_gene, coalesce(v.n / n_sequences, 0) AS top_v_freq, j.g AS top_j_gene, coalesce(j.n / n_sequences, 0) AS top_j_freq FROM st
  LEFT JOIN {_TOP.format(c='v_call')} v USING (dataset, repertoire_id) LEFT JOIN {_TOP.format(c='j_call')} j USING (dataset, repertoire_id))"""


@query("repertoire_stats", f"""WITH {_STATS} SELECT dataset, repertoire_id, n_sequences, unique_junctions, unique_v_genes, unique_j_genes,
round(mean_cdr3_length, 6) AS mean_cdr3_length, median_cdr3_length, round(mean_templates, 6) AS mean_templates, median_templates,
round(clonality_index, 6) AS clonality_index, top_v_gene, round(top_v_freq, 6) AS top_v_freq, top_j_gene, round(top_j_freq, 6) AS top_j_freq FROM s""")
def _(t):
    return rounded(reports.repertoire_stats(t.rearrangements))


def labelled_stats(t: Tables):
    return align.align_labels(reports.repertoire_stats(t.rearrangements), t.metadata)


_LONG = """l AS (UNPIVOT (SELECT dataset, label_positive, n_sequences::DOUBLE AS n_sequences, unique_junctions::DOUBLE AS unique_junctions, mean_cdr3_length, clonality_index
  FROM s JOIN metadata USING (dataset, repertoire_id)) ON n_sequences, unique_junctions, mean_cdr3_length, clonality_index INTO NAME feature VALUE value),
g AS (SELECT dataset, feature, avg(value) FILTER (label_positive) AS m1, avg(value) FILTER (NOT label_positive) AS m0, count(*) FILTER (label_positive) AS n1,
  count(*) FILTER (NOT label_positive) AS n0, var_samp(value) FILTER (label_positive) AS v1, var_samp(value) FILTER (NOT label_positive) AS v0 FROM l GROUP BY ALL)"""


@query("class_ttest", f"""WITH {_STATS}, {_LONG} SELECT dataset, feature, round(m1, 6) AS positive_mean, round(m0, 6) AS negative_mean, round(m1 - m0, 6) AS difference,
round(100 * (m1 / m0 - 1), 6) AS difference_pct, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1 / n1 + 1 / n0)), 6) AS t,
n1 + n0 - 2 AS df FROM g""")
def _(t):
    return rounded(reports.class_comparison(labelled_stats(t)))


@query("class_ttest_p", f"""WITH {_STATS}, {_LONG}, t AS (SELECT dataset, feature, m1, m0, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1 / n1 + 1 / n0)) AS t,
  n1 + n0 - 2 AS df FROM g), a AS (SELECT *, atan(abs(t) / sqrt(df)) AS th FROM t),
p AS (SELECT *, CASE WHEN df % 2 = 0 THEN sin(th) * list_sum(list_transform(range(0, (df // 2)::BIGINT),
    lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4)) * power(cos(th), 2 * k)))
  WHEN df = 1 THEN 2 * th / pi() ELSE 2 / pi() * (th + sin(th) * list_sum(list_transform(range(0, ((df - 1) // 2)::BIGINT),
    lambda k: exp(k * ln(4) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * power(cos(th), 2 * k + 1)))) END AS inside FROM a)
SELECT dataset, feature, round(m1, 6) AS positive_mean, round(m0, 6) AS negative_mean, round(m1 - m0, 6) AS difference,
round(100 * (m1 / m0 - 1), 6) AS difference_pct, round(t, 6) AS t, df, CASE WHEN df > 0 AND t IS NOT NULL AND NOT isnan(t) THEN round(greatest(1 - inside, 0), 6) ELSE 'nan'::DOUBLE END AS p_value FROM p""")
def _(t):
    return rounded(reports.class_ttest(labelled_stats(t)))


@query("top_gene_by_class", f"""WITH {_STATS}, c AS (SELECT dataset, label_positive, top_v_gene, count(*) AS n FROM s JOIN metadata USING (dataset, repertoire_id) GROUP BY ALL),
h AS (SELECT *, n / sum(n) OVER (PARTITION BY dataset, label_positive) AS share FROM c)
SELECT dataset, label_positive, top_v_gene, n, round(share, 6) AS share FROM h
QUALIFY row_number() OVER (PARTITION BY dataset, label_positive ORDER BY n DESC, top_v_gene) <= 10""")
def _(t):
    return rounded(reports.top_gene_by_class(labelled_stats(t)))


@query("batch_chi2", """WITH c AS (SELECT dataset, sequencing_run_id AS b, label_positive AS y, count(*) AS n FROM metadata GROUP BY ALL),
g AS (SELECT dataset, b, y FROM (SELECT DISTINCT dataset, b FROM c) JOIN (SELECT DISTINCT dataset, y FROM c) USING (dataset)),
o AS (SELECT g.*, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.dataset = g.dataset AND c.b = g.b AND c.y = g.y),
e AS (SELECT *, sum(n) OVER (PARTITION BY dataset, b) * sum(n) OVER (PARTITION BY dataset, y) / sum(n) OVER (PARTITION BY dataset) AS x FROM o),
d AS (SELECT dataset, (count(DISTINCT b) - 1) * (count(DISTINCT y) - 1) AS dof FROM e GROUP BY ALL)
SELECT dataset, round(sum(CASE WHEN dof = 1 THEN (abs(n - x) - least(0.5, abs(n - x))) ** 2 ELSE (n - x) ** 2 END / x), 6) AS chi2, any_value(dof) AS dof
FROM e JOIN d USING (dataset) GROUP BY dataset""")
def _(t):
    return rounded(reports.batch_chi2(t.metadata))


_CMP = """z AS (SELECT dataset, repertoire_id, count(*) AS size FROM rearrangements GROUP BY ALL),
k AS (SELECT dataset, count(*) AS n_repertoires, count(*) FILTER (label_positive) AS n_positive, count(*) FILTER (label_positive) / count(*) AS positive_rate,
  avg(size) AS mean_repertoire_size, quantile_cont(size, 0.5)::DOUBLE AS median_repertoire_size FROM metadata LEFT JOIN z USING (dataset, repertoire_id) GROUP BY ALL)"""


@query("dataset_comparison", f"""WITH {_CMP} SELECT dataset, n_repertoires, n_positive, round(positive_rate, 6) AS positive_rate,
round(mean_repertoire_size, 6) AS mean_repertoire_size, median_repertoire_size FROM k""")
def _(t):
    return rounded(reports.dataset_comparison(t.rearrangements, t.metadata))


@query("dataset_vs_others", f"WITH {_CMP} SELECT a.dataset, " + ", ".join(
    f"round(any_value(a.{c})::DOUBLE, 6) AS {c}, round(avg(b.{c}), 6) AS others_{c}" for c in ("positive_rate", "n_repertoires", "mean_repertoire_size"))
    + " FROM k a JOIN k b ON a.dataset <> b.dataset GROUP BY a.dataset")
def _(t):
    return rounded(reports.dataset_vs_others(reports.dataset_comparison(t.rearrangements, t.metadata)))


# ---- pooling -----------------------------------------------------------------------

_X = "x AS (SELECT bag, vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embedding_bags)"


def _pool_sql(*aggs):
    parts = " UNION ALL ".join(f"SELECT bag, pos + {i} * d AS pos, {a} AS value FROM x JOIN w USING (bag) GROUP BY bag, pos, d" for i, a in enumerate(aggs))
    return f"""WITH {_X}, w AS (SELECT bag, max(len(embedding)) AS d FROM embedding_bags GROUP BY ALL), y AS ({parts})
SELECT bag, pos::INT AS pos, round(value, 6) AS value FROM y"""


def _pool_query(name, method, *aggs):
    @query(name, _pool_sql(*aggs))
    def _(t):
        return rounded(pooling.pool(t.embedding_bags, ["bag"], method))


_pool_query("pool_mean", "mean", "avg(v)")
_pool_query("pool_max", "max", "max(v)")
_pool_query("pool_mean_max", "mean_max", "avg(v)", "max(v)")
_pool_query("pool_stats", "stats", "avg(v)", "stddev_pop(v)", "min(v)", "max(v)")


@query("pool_softmax", f"""WITH {_X}, s AS (SELECT bag, vec_id, exp((vec_id % 7)::DOUBLE / 3) AS e FROM embedding_bags)
SELECT bag, pos::INT AS pos, round(sum(v * e) / sum(e), 6) AS value FROM x JOIN s USING (bag, vec_id) GROUP BY bag, pos""")
def _(t):
    return rounded(pooling.pool_softmax(t.embedding_bags.withColumn("score", (F.col("vec_id") % 7) / 3.0), ["bag"]))


@query("pool_default", f"""WITH {_X}, p AS (SELECT bag, pos, avg(v) AS value FROM x GROUP BY ALL), b AS (SELECT DISTINCT CAST(floor(vec_id / 8) AS BIGINT) AS bag FROM embedding_bags),
g AS (SELECT bag, unnest(range((SELECT max(len(embedding)) FROM embedding_bags))) AS pos FROM b)
SELECT g.bag, g.pos::INT AS pos, round(coalesce(value, 0), 6) AS value FROM g LEFT JOIN p USING (bag, pos)""")
def _(t):
    e = t.embedding_bags
    width = e.select(F.max(F.size("embedding"))).first()[0]
    bags = e.select(F.floor(F.col("vec_id") / 8).alias("bag")).distinct()
    out = pooling.pool_default(bags, pooling.pool(e, ["bag"]), ["bag"], width)
    return rounded(out.select("bag", F.posexplode("vector").alias("pos", "value")))
