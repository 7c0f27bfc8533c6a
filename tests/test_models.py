"""Fits: shapes, ranges and invariants."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from clonara.constants import REP
from clonara.operators import ensemble, evaluate, model
from clonara.plans.catalogue import QUERIES
from clonara.plans.model_queries import training
from clonara.session import materialize
from support import SF


def test_vectors_hold_the_features(tables):
    data, space = training(tables)
    first = data.select("features").first().features
    assert len(space.names) == first.size == 60 and data.count() == tables.metadata.count()


def test_folds_balance_classes(tables):
    folds = model.stratified_folds(tables.metadata, 5)
    counts = [r["count"] for r in folds.groupBy("label_positive", "fold").count().collect()]
    assert max(counts) - min(counts) <= 1
    again = model.stratified_folds(tables.metadata, 5)
    assert folds.select(*REP, "fold").exceptAll(again.select(*REP, "fold")).count() == 0


def test_out_of_fold_covers_every_row_once(tables):
    data, _ = training(tables)
    oof, models = model.out_of_fold(LogisticRegression(regParam=0.01), model.stratified_folds(data, 3))
    assert oof.count() == data.count() == oof.select(*REP).distinct().count() and len(models) == 3


def test_hill_climb_never_falls(tables):
    for metric in ("roc_auc", "log_loss"):
        weights, score, history = ensemble.hill_climb(tables.predictions, ["p_a", "p_b"], metric, iterations=20, step=0.2, batch=10)
        assert history == sorted(history) and score == history[-1] and sum(weights) == pytest.approx(1.0)
    accuracy = lambda df: evaluate.balanced_accuracy(df, ["candidate"]).withColumnRenamed("balanced_accuracy", "score")
    assert ensemble.hill_climb(tables.predictions, ["p_a", "p_b"], accuracy, iterations=5, batch=5)[1] >= 0


def test_equal_weights_when_no_coefficient_is_positive(spark):
    c = spark.createDataFrame([("a", -1.0), ("b", 0.0)], "model string, coefficient double")
    assert {r.model: r.weight for r in model.blend_weights(c).collect()} == {"a": 0.5, "b": 0.5}


def test_feature_sets_are_finite_and_unique(tables):
    from clonara.operators import clonotypes
    from clonara.plans.features import SETS, extract_features

    mined = {"significant": clonotypes.mine_fisher_greater, "extended": clonotypes.mine_fisher}
    for name in SETS:
        m = mined.get(name, clonotypes.mine_enriched)(tables.rearrangements, tables.metadata)
        f = extract_features(tables.rearrangements, m, tables.metadata, (3,), name)
        n, distinct, bad = f.select(F.count("*"), F.count_distinct("dataset", "repertoire_id", "feature"),
                                    F.count_if(F.isnan("value") | F.col("value").isNull())).first()
        assert n == distinct and bad == 0, name


def test_stacking_rejects_one_class(tables):
    data, _ = training(tables)
    with pytest.raises(ValueError):
        ensemble.Stacking({"lr": LogisticRegression()}).fit(data.where("label = 1.0"))


@pytest.mark.parametrize("name", ["fit_logreg_l1", "fit_boosted", "stacking", "ridge_stack", "fit_mlp", "oof_predict"])
def test_probabilities(spark, tables, name):
    out = QUERIES[name](spark, SF)
    assert out.count() == tables.metadata.count() and out.where("p < 0 OR p > 1 OR p IS NULL").count() == 0


def test_predictor_writes_a_full_submission(spark, tables):
    out = materialize(QUERIES["predictor"](spark, SF))
    n = tables.metadata.select("dataset").distinct().count()
    assert out.where("label_positive_probability <> -999").count() == tables.metadata.count()
    assert out.where("label_positive_probability = -999").count() == 50000 * n
    bad = out.where(F.col("junction_aa").isNull() | F.col("v_call").isNull())
    assert bad.count() == 0


@pytest.mark.parametrize("name,module,maker,given", [("fit_mlp", model, "multilayer_perceptron", (60,)), ("best_model", model, "best_model", (None, 60)), ("ridge_stack", ensemble, "RidgeStack", ())])
def test_fits_are_registered_with_the_settings_of_their_operator(spark, monkeypatch, name, module, maker, given):
    from clonara.plans import model_queries

    class Called(Exception):
        pass

    def made(*args, **settings):
        raise Called(args, settings)

    monkeypatch.setattr(model_queries, "training", lambda t: (None, model.FeatureSpace(["f"] * 60)))
    monkeypatch.setattr(model, "scaled", lambda data: (data, None))
    monkeypatch.setattr(module, maker, made)
    with pytest.raises(Called) as seen:
        QUERIES[name](spark, SF)
    assert seen.value.args == (given, {})
