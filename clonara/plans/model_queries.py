"""Registered splits, selections, fits and ensembles."""

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import functions as F

from clonara.constants import REP
from clonara.operators import clonotypes, diversity, ensemble, evaluate, genes, kmers, lengths, model
from clonara.operators.align import union_all
from clonara.operators.fits import compact
from clonara.plans import bundle
from clonara.plans.features import extract_features, long_table
from clonara.plans.kmer_queries import KMER_INDEX
from clonara.plans.predictor import RepertoirePredictor, run_all
from clonara.plans.profile_queries import rounded
from clonara.plans.clonotype_queries import hits_by_dataset
from clonara.plans.registry import ORACLES, oracle_text, query
from clonara.plans.report_queries import both_models
from clonara.plans import source_queries  # noqa: F401  registers twins that are read below
from clonara.session import materialize, shared_path
from clonara.sources import repertoires

def _features(t):
    r = t.rearrangements
    return union_all([kmers.kmer_frequencies(r, (3,)), genes.family_usage(r), long_table(lengths.length_stats(r)),
                      long_table(diversity.richness(r)), long_table(diversity.clone_size(r))])


def training(t, top=60):
    """Vectors over the most variable features with labels and weights."""
    features = materialize(_features(t), "features")
    space = model.FeatureSpace.of(model.select_variance(features, t.metadata, top))
    rows = space.vectors(features, t.metadata.select(*REP, "label_positive"))
    return materialize(model.with_class_weight(model.labelled(rows)), "training"), space


def _scores(df):
    """Prediction rows as (dataset, repertoire, label, p)."""
    return rounded(df.select(*REP, "label_positive", "p"))


# ---- feature tables ----------------------------------------------------------------


def _cells(sql, prefix=""):
    """SQL: the columns of a twin as (feature, value) rows."""
    keys = "(dataset, repertoire_id)"
    return (f"SELECT dataset, repertoire_id, '{prefix}' || feature AS feature, round(value, 6) AS value FROM (UNPIVOT (SELECT dataset, repertoire_id, COLUMNS(* EXCLUDE {keys})::DOUBLE FROM ({sql})) "
            f"ON COLUMNS(* EXCLUDE {keys}) INTO NAME feature VALUE value)")


def _union_sql(long, wide, more=()):
    """SQL: the twins of a set's parts under each other."""
    parts = [f"SELECT dataset, repertoire_id, feature, value FROM ({ORACLES[n]})" for n in long]
    parts += [_cells(ORACLES[n]) for n in wide]
    return " UNION ALL ".join([*parts, *more])


_SEX = "SELECT dataset, repertoire_id, 'meta_sex_male' AS feature, CASE WHEN upper(sex) IN ('M', 'MALE') THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM metadata"
_SEX += f""" UNION ALL SELECT dataset, repertoire_id, 'meta_race_white', CASE WHEN contains(lower(race), 'white') THEN 1.0 ELSE 0.0 END FROM metadata WHERE dataset = 'train_dataset_7'
UNION ALL SELECT * FROM ({ORACLES['meta_features_run']})"""
_BASE = (["kmer_freq", "kmer_positional", "family_usage"], ["physchem", "length_stats", "richness", "clone_size"])


@query("extract_features", _union_sql(_BASE[0], [*_BASE[1], "public_hits"], [_SEX]))
def _(t):
    return rounded(extract_features(t.rearrangements, clonotypes.mine_enriched(t.rearrangements, t.metadata), t.metadata))


def _set_query(feature_set, mine=None, ks=(3, 4), sql=None):
    @query(f"extract_{feature_set}", sql)
    def _(t):
        mined = mine(t.rearrangements, t.metadata) if mine else None
        features = extract_features(t.rearrangements, mined, t.metadata, ks, feature_set)
        # means of few letters often end in a five: their twin rounds to eight places first
        fine = F.when(F.col("feature").startswith("atchley_"), F.round("value", 8)).otherwise(F.col("value"))
        return rounded(features.withColumn("value", fine))


_set_query("significant", clonotypes.mine_fisher_greater, sql=_union_sql(_BASE[0], [*_BASE[1], "public_hits_sig"], [_SEX]))
_set_query("extended", clonotypes.mine_fisher, sql=_union_sql(
    _BASE[0], ["physchem", "length_stats", "richness", "public_hits_signed"],
    [_cells(ORACLES["atchley"]), _cells(ORACLES["clone_size_extended"], "div_"), _SEX]))
_set_query("pairs", clonotypes.mine_by_dataset, sql=_union_sql(
    [*_BASE[0], "vj_family"], ["physchem", "length_dist", "richness", "clone_size"], [_cells(oracle_text(hits_by_dataset())), _SEX]))
_set_query("counts", ks=(3, 4, 5), sql=_union_sql(["kmer_multiscale", "raw_usage"], ["seq_clonality", "length_shape"]))
_set_query("stacked", ks=(3, 4, 5), sql=_union_sql(["kmer_multiscale", "family_pair_usage"], ["seq_diversity", "length_stats_full"]))
_set_query("usage", ks=(3, 4, 5), sql=_union_sql(["kmer_multiscale", "raw_usage50"], ["seq_clonality_cum"]))
_set_query("simple", ks=(3,), sql=_union_sql(["raw_usage_k3"], ["length_stats_full"], [f"SELECT dataset, repertoire_id, feature, value FROM ({ORACLES['kmer_freq_raw']}) WHERE feature LIKE 'k3%'"]))
_set_query("hashed")


_VCOUNT = """f AS (SELECT dataset, repertoire_id, 'v_' || v_call AS feature, count(*)::DOUBLE AS value FROM rearrangements WHERE v_call IS NOT NULL GROUP BY ALL),
n AS (SELECT count(*) AS n FROM metadata), s AS (SELECT feature, sum(value) AS s, sum(value * value) AS ss FROM f GROUP BY ALL)"""


def _v_counts(t):
    return (t.rearrangements.where(F.col("v_call").isNotNull()).groupBy(*REP, F.concat(F.lit("v_"), "v_call").alias("feature"))
            .agg(F.count(F.lit(1)).cast("double").alias("value")))


@query("select_variance", f"""WITH {_VCOUNT}, d AS (SELECT feature, greatest((ss - s * s / n) / (n - 1), 0) AS variance FROM s CROSS JOIN n)
SELECT feature, round(variance, 6) AS variance FROM d ORDER BY round(variance, 9) DESC, feature LIMIT 50""")
def _(t):
    return rounded(model.select_variance(_v_counts(t), t.metadata, 50))


@query("standardize", f"""WITH {_VCOUNT}, d AS (SELECT feature, greatest((ss - s * s / n) / (n - 1), 0) AS variance, s / n AS mean, sqrt(greatest(ss / n - (s / n) * (s / n), 0)) AS sd
  FROM s CROSS JOIN n ORDER BY round(variance, 9) DESC, feature LIMIT 20)
SELECT m.dataset, m.repertoire_id, d.feature, round((coalesce(f.value, 0) - mean) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END, 6) AS value FROM metadata m CROSS JOIN d
LEFT JOIN f ON f.dataset = m.dataset AND f.repertoire_id = m.repertoire_id AND f.feature = d.feature""")
def _(t):
    f = _v_counts(t)
    return rounded(model.standardize(f, t.metadata.select(*REP), model.select_variance(f, t.metadata, 20)))


@query("class_weights", """WITH m AS (SELECT *, CAST(regexp_extract(dataset, '[0-9]+') AS INT) + 4 AS n FROM metadata)
SELECT 'train_dataset_' || n AS dataset, repertoire_id, CASE WHEN label_positive THEN CASE n WHEN 7 THEN 5.0 WHEN 8 THEN 2.0 ELSE 1.0 END ELSE 1.0 END::DOUBLE AS weight FROM m""")
def _(t):
    n = F.substring("dataset", 15, 3).cast("int") + 4
    m = t.metadata.withColumn("dataset", F.concat(F.lit("train_dataset_"), n.cast("string")))
    return model.with_class_weight(m).select(*REP, "weight")


# ---- splits ------------------------------------------------------------------------

_SIZES = """m AS (SELECT dataset, label_positive, count(*) AS n FROM metadata GROUP BY ALL),
k AS (SELECT dataset, least(5, greatest(2, least(coalesce(max(n) FILTER (label_positive), 0), coalesce(max(n) FILTER (NOT label_positive), 0)))) AS k FROM m GROUP BY ALL)"""


@query("stratified_folds", f"""WITH {_SIZES}, f AS (SELECT dataset, label_positive, n, k, unnest(range(k)) AS fold FROM m JOIN k USING (dataset))
SELECT dataset, label_positive, fold::INT AS fold, (n // k + CASE WHEN fold < n % k THEN 1 ELSE 0 END)::BIGINT AS n
FROM f WHERE n // k + CASE WHEN fold < n % k THEN 1 ELSE 0 END > 0""")
def _(t):
    folds = model.stratified_folds(t.metadata, 5, 42, ["dataset"])
    return folds.groupBy("dataset", "label_positive", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_fold_ids", """WITH h AS (SELECT dataset, repertoire_id, label_positive, ('0x' || substr(md5(concat_ws('|', '42', dataset, repertoire_id)), 1, 12))::BIGINT AS h FROM metadata),
n AS (SELECT dataset, least(5, greatest(2, least(count(*) FILTER (label_positive), count(*) FILTER (NOT label_positive)))) AS n FROM metadata GROUP BY ALL)
SELECT dataset, repertoire_id, label_positive, ((row_number() OVER (PARTITION BY dataset, label_positive ORDER BY h, repertoire_id) - 1) % n)::INT AS fold FROM h JOIN n USING (dataset)""")
def _(t):
    return model.stratified_folds(t.metadata, 5, 42, ["dataset"]).select(*REP, "label_positive", "fold")


@query("stratified_holdout", """SELECT dataset, label_positive, floor(0.2 * count(*))::BIGINT AS held, count(*) AS n FROM metadata GROUP BY ALL""")
def _(t):
    split = model.stratified_holdout(t.metadata, 0.2, 42, True, ["dataset"])
    return split.groupBy("dataset", "label_positive").agg(F.count_if("holdout").alias("held"), F.count(F.lit(1)).alias("n"))


@query("lodo_splits", """SELECT a.dataset AS held_out, count(*) FILTER (b.dataset <> a.dataset) AS n_train, count(*) FILTER (b.dataset = a.dataset) AS n_test
FROM (SELECT DISTINCT dataset FROM metadata) a JOIN metadata b ON true GROUP BY ALL""")
def _(t):
    per = model.dataset_folds(t.metadata).groupBy("dataset", "fold").agg(F.count(F.lit(1)).alias("n_test"))
    total = t.metadata.agg(F.count(F.lit(1))).scalar()
    return per.select(F.col("dataset").alias("held_out"), (total - F.col("n_test")).alias("n_train"), "n_test")


# ---- combinations ------------------------------------------------------------------


@query("seed_average", """WITH s AS (SELECT ID, unnest([0, 1, 2]) AS seed, p_a, p_b FROM predictions),
m AS (SELECT ID, seed, p_a + seed * 0.01::DOUBLE AS p FROM s UNION ALL SELECT ID, seed, p_b FROM s WHERE seed > 0),
w AS (SELECT ID, seed, avg(p) AS p FROM m GROUP BY ALL) SELECT ID, round(avg(p), 6) AS p FROM w GROUP BY ALL""")
def _(t):
    s = t.predictions.select("ID", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("seed"), "p_a", "p_b")
    runs = s.select("ID", "seed", (F.col("p_a") + F.col("seed") * 0.01).alias("p")).union(s.where(F.col("seed") > 0).select("ID", "seed", "p_b"))
    return rounded(model.seed_average(runs))


@query("blend_weights", """WITH c AS (SELECT dataset, 'a' AS model, coalesce(nullif(corr(p_a, label_positive::INT), 'nan'::DOUBLE), 0) AS c FROM predictions GROUP BY ALL
  UNION ALL SELECT dataset, 'b', coalesce(nullif(corr(p_b, label_positive::INT), 'nan'::DOUBLE), 0) FROM predictions GROUP BY ALL)
SELECT dataset, model, round(CASE WHEN sum(greatest(c, 0)) OVER w > 0 THEN greatest(c, 0) / sum(greatest(c, 0)) OVER w ELSE 1 / count(*) OVER w END, 6) AS weight
FROM c WINDOW w AS (PARTITION BY dataset)""")
def _(t):
    y = F.col("label_positive").cast("double")
    c = both_models(t).groupBy("dataset", "model").agg(F.coalesce(evaluate.correlation("p", y), F.lit(0.0)).alias("coefficient"))
    return rounded(model.blend_weights(c, ["dataset"]))


@query("merge_importance", """WITH v AS (SELECT 'v_' || v_call AS feature, count(*) AS n, sum(templates) AS t FROM rearrangements WHERE v_call IS NOT NULL GROUP BY ALL)
SELECT feature, round(n * 0.30::DOUBLE + t * 0.25::DOUBLE + abs(n - 200) * 0.15::DOUBLE, 6) AS importance FROM v""")
def _(t):
    v = (t.rearrangements.where(F.col("v_call").isNotNull()).groupBy(F.concat(F.lit("v_"), "v_call").alias("feature"))
         .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("templates").alias("t")))
    cells = [("deep_boost", F.col("n")), ("forest", F.col("t")), ("logreg", F.col("n") - 200)]
    rows = v.select("feature", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), c.alias("importance")) for m, c in cells])))
    return rounded(ensemble.merge_importance(rows))


# ---- fits --------------------------------------------------------------------------


@query("select_gain")
def _(t):
    data, space = training(t, 2000)
    return model.select_gain(data, space)


@query("fit_logreg_l1")
def _(t):
    data, _ = training(t)
    fitted = model.SparseLogistic().fit(data)
    return _scores(fitted.predict(data))


@query("coef_table")
def _(t):
    data, space = training(t)
    rows, _ = model.scaled(data)
    return model.coefficient_table(LogisticRegression(elasticNetParam=1.0, regParam=0.02, standardization=False).fit(rows), space, t.spark)


@query("fit_boosted")
def _(t):
    data, _ = training(t)
    fitted = model.BoostedEnsemble(seeds=(42,), folds=2, max_rounds=6, min_rounds=5, extra_rounds=0).fit(data, learn_weights=True)
    return _scores(fitted.predict(data))


@query("boost_curve")
def _(t):
    data, _ = training(t)
    settings = {"maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, "minInstancesPerNode": 5}
    fitted = model.BoostedEnsemble(seeds=(42,), folds=2, min_rounds=1, extra_rounds=0, variants=(settings,)).fit(data)
    return rounded(fitted.curve(t.spark))


@query("oof_predict")
def _(t):
    data, _ = training(t)
    oof, _ = model.out_of_fold(LogisticRegression(regParam=0.01), materialize(model.stratified_folds(data, 3), "folds"))
    return rounded(oof.select(*REP, "label_positive", "fold", "p"))


@query("stacking")
def _(t):
    data, _ = training(t)
    learners = {"lr": LogisticRegression(regParam=0.01), "gbt": GBTClassifier(maxIter=4, maxDepth=3, seed=42)}
    return _scores(ensemble.Stacking(learners, folds=3).fit(data).predict(data))


@query("ridge_stack")
def _(t):
    data, _ = training(t)
    return _scores(ensemble.RidgeStack().fit(data).predict(data))


@query("hill_climb")
def _(t):
    weights, score, history = ensemble.hill_climb(t.predictions, ["p_a", "p_b"], iterations=40, step=0.1, batch=20)
    rows = [(m, w, score, history[0]) for m, w in zip(("p_a", "p_b"), weights)]
    return rounded(t.spark.createDataFrame(rows, "model string, weight double, score double, first_score double"))


@query("lodo")
def _(t):
    data, _ = training(t)
    return rounded(model.leave_one_dataset_out(LogisticRegression(regParam=0.01), data))


@query("lodo_predict")
def _(t):
    features = materialize(_features(t), "features")
    space = model.FeatureSpace.of(model.select_variance(features, t.metadata, 60))
    folds = model.dataset_folds(t.metadata.select(*REP, "label_positive"))
    data = compact(materialize(model.labelled(space.vectors(features, folds)), "training"))
    coefficients = model.fold_coefficients(model.fold_models(LogisticRegression(regParam=0.01), data), space, t.spark)
    return rounded(model.routed_scores(features, folds, coefficients))


@query("best_model")
def _(t):
    data, space = training(t)
    chosen, scores, _, _ = model.best_model(data, len(space.names))
    rows = [(k, v, k == chosen) for k, v in scores.items()]
    return rounded(t.spark.createDataFrame(rows, "model string, auc double, chosen boolean"))


@query("fit_mlp")
def _(t):
    data, space = training(t)
    rows, _ = model.scaled(data)
    return _scores(model.probability(model.multilayer_perceptron(len(space.names)).fit(rows).transform(rows)))


@query("bundle_kmers", KMER_INDEX)
def _(t):
    path = shared_path(t.spark, "bundle")
    bundle.save(kmers.KmerFeaturizer(k_range=(3, 4), per_k=200).fit(t.rearrangements), path, t.spark)
    return bundle.load(t.spark, path).feature_names()


@query("bundle_scores")
def _(t):
    data, _ = training(t)
    path, fitted = shared_path(t.spark, "bundle"), model.SparseLogistic(c_values=(0.1,), folds=3).fit(data)
    bundle.save(fitted, path, t.spark)
    after = bundle.load(t.spark, path).predict(data).select(*REP, F.col("p").alias("p_loaded"))
    return rounded(fitted.predict(data).select(*REP, "p").join(after, REP).withColumn("same", F.abs(F.col("p") - F.col("p_loaded")) < 1e-9))


@query("predictor")
def _(t):
    rows, m = t.rearrangements, t.metadata
    test = lambda df: df.withColumn("dataset", F.replace("dataset", F.lit("train"), F.lit("test")))
    names = m.select("dataset").distinct()
    make = lambda: RepertoirePredictor(learner=model.SparseLogistic())
    return rounded(run_all(rows, m, test(rows).drop("label_positive"), test(m), repertoires.route_tests(names, test(names)), make))
