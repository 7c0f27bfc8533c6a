"""Concurrent fits, validation curves, routed scores, fold-safe mining."""

import threading
import time

import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import functions as F

from clonara.constants import REP
from clonara.operators import clonotypes, fits, model
from clonara.plans.catalogue import QUERIES
from clonara.plans.model_queries import training
from clonara.session import materialize
from support import SF


def test_fits_run_side_by_side_within_the_width(spark):
    running, most, lock = [0], [0], threading.Lock()

    def one(i):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.3)
        with lock:
            running[0] -= 1
        return spark.range(i).count()

    found = fits.run_fits(spark, {i: lambda i=i: one(i) for i in range(9)}, width=3)
    assert list(found) == list(range(9)) and all(found[i] == i for i in found) and most[0] == 3


def test_a_failing_fit_ends_the_others(spark):
    def bad():
        raise ValueError("no fit")

    slow = lambda: spark.range(4, numPartitions=4).mapInPandas(_sleep, "id long").count()
    start = time.time()
    with pytest.raises(ValueError, match="no fit"):
        fits.run_fits(spark, {"slow": slow, "bad": bad}, width=2)
    assert time.time() - start < 40


def _sleep(batches):
    time.sleep(60)
    yield from batches


def test_best_round_by_patience():
    assert fits.best_round([5, 4, 3, 4, 4, 4, 1], 3) == (3, 6)
    assert fits.best_round([5, 4, 3, 4, 4, 1], 3) == (6, 6)
    assert fits.best_round([1.0], 3) == (1, 1) and fits.best_round([2, 2, 2, 2], 2) == (1, 3)


def test_cut_ensemble_is_the_shorter_fit(spark, tables):
    data = fits.compact(training(tables)[0])
    trees = GBTClassifier(maxIter=6, maxDepth=3, seed=1, subsamplingRate=0.8)
    cut, short = fits.first_trees(trees.fit(data), 3), trees.copy({trees.maxIter: 3}).fit(data)
    assert cut.getNumTrees == 3 and cut.numFeatures == short.numFeatures
    values = lambda m: [round(r.p, 9) for r in model.probability(m.transform(data)).orderBy(*REP).collect()]
    assert values(cut) == values(short)
    assert abs(cut.featureImportances.toArray() - short.featureImportances.toArray()).max() < 1e-9


def test_boosting_doubles_until_flat(spark, tables):
    data = fits.compact(training(tables)[0].withColumn("_odd", F.crc32("repertoire_id") % 2 == 1))
    data = materialize(data, "halves")
    trees = GBTClassifier(maxDepth=2, stepSize=0.5, seed=1)
    cut, losses = fits.boost_until_flat(trees, data.where("_odd"), data.where("NOT _odd"), max_rounds=50, patience=3)
    best, stop = fits.best_round(losses, 3)
    assert cut.getNumTrees == best and len(losses) == stop <= 50 and min(losses) == losses[best - 1]
    assert abs(cut.evaluateEachIteration(data.where("NOT _odd"))[-1] - losses[best - 1]) < 1e-9


def test_boost_curve_names_the_best_round(spark):
    rows = QUERIES["boost_curve"](spark, SF).collect()
    for fold in {r.fold for r in rows}:
        curve = sorted([r for r in rows if r.fold == fold], key=lambda r: r["round"])
        assert [r["round"] for r in curve] == list(range(1, len(curve) + 1)) and len(curve) <= 1000
        best = min(curve, key=lambda r: (r.loss, r["round"]))
        assert [r["round"] for r in curve if r.chosen] == [best["round"]]
        assert len(curve) == 1000 or len(curve) - best["round"] == 100


def test_routed_scores_are_those_of_the_fold_models(spark, tables):
    from clonara.plans.model_queries import _features

    features = materialize(_features(tables), "features")
    space = model.FeatureSpace.of(model.select_variance(features, tables.metadata, 20))
    folds = model.dataset_folds(tables.metadata.select(*REP, "label_positive"))
    data = fits.compact(materialize(model.labelled(space.vectors(features, folds)), "training"))
    models = model.fold_models(LogisticRegression(regParam=0.01), data)
    got = model.routed_scores(features, folds, model.fold_coefficients(models, space, spark))
    want = {}
    for f, m in models.items():
        for r in model.probability(m.transform(data.where(F.col("fold") == f))).collect():
            want[r.dataset, r.repertoire_id] = r.p
    found = {(r.dataset, r.repertoire_id): r.p for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_vectors_are_the_pivot(spark):
    reps = spark.createDataFrame([("d", "a"), ("d", "b"), ("d", "c"), ("d", "e")], "dataset string, repertoire_id string")
    cells = [("a", "x", 1.0), ("a", "z", 3.0), ("b", "y", 2.0), ("c", "other", 9.0), ("e", "x", 4.0), ("e", "y", 5.0), ("e", "z", 6.0), ("e", "z", 7.0)]
    features = spark.createDataFrame([("d", *c) for c in cells], "dataset string, repertoire_id string, feature string, value double")
    for names, want in ((["x", "y", "z"], {"a": [1, 0, 3], "b": [0, 2, 0], "c": [0, 0, 0], "e": [4, 5, 6]}), (["y"], {"a": [0], "b": [2], "c": [0], "e": [5]}),
                        ([], {"a": [], "b": [], "c": [], "e": []})):
        vocabulary = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "feature string, index long")
        got = {r.repertoire_id: r.features.toArray().tolist() for r in model.assemble(features, vocabulary, reps, len(names)).collect()}
        assert got == want


def test_fold_lists_never_saw_their_fold(spark, rows, metadata, tables):
    folds = model.stratified_folds(tables.metadata, 3, 7, ["dataset"])
    every = clonotypes.fold_counts(tables.rearrangements, folds).where("pos + neg > 0")
    for f in range(3):
        held = folds.where(F.col("fold") == f).select(*REP)
        one = clonotypes.class_counts(tables.rearrangements, tables.metadata, exclude_fold=held)
        columns = ["dataset", "junction_aa", "pos", "neg", "n_pos", "n_neg"]
        a = every.where(F.col("fold") == f).select(columns)
        one = one.join(folds.where(F.col("fold") == f).select("dataset").distinct(), "dataset", "left_semi")  # a small dataset may lack the fold
        assert a.exceptAll(one.select(columns)).count() == 0 and one.select(columns).exceptAll(a).count() == 0
