"""Stacking, ridge blending and weight search over model predictions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from clonara.constants import IMPORTANCE_WEIGHTS
from clonara.operators.evaluate import log_loss, roc_auc
from clonara.operators.align import union_all
from clonara.operators.fits import compact, run_fits
from clonara.operators.model import (FeatureSpace, fold_values, probability, scaled, stratified_folds, stratified_holdout)
from clonara.session import materialize


def _with_meta(df: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="_meta").transform(df)


@dataclass
class Stacking:
    """Base learners per fold; a meta learner on their out-of-fold predictions.

    At prediction the fold models of a learner are averaged. Any estimators with a
    probability output will do.
    """

    learners: dict[str, Estimator]
    meta: Estimator | None = None
    folds: int = 5
    seed: int = 42
    fold_models: dict[str, list[Model]] = field(default_factory=dict, repr=False)
    meta_model: Model | None = field(default=None, repr=False)
    cv_scores: dict[str, float] = field(default_factory=dict)

    def fit(self, data: DataFrame) -> "Stacking":
        classes = [r.label for r in data.select("label").distinct().limit(3).collect()]
        if len(classes) != 2:
            raise ValueError("only binary labels are supported")
        rows = compact(materialize(stratified_folds(data, self.folds, self.seed), "folds"))
        folds = fold_values(rows)
        fitted = run_fits(data.sparkSession, {(name, f): lambda e=e, f=f: e.fit(rows.where(F.col("fold") != f)) for name, e in self.learners.items() for f in folds})
        self.fold_models = {name: [fitted[name, f] for f in folds] for name in self.learners}
        parts = []
        for i, f in enumerate(folds):
            part = rows.where(F.col("fold") == f)
            for name, models in self.fold_models.items():
                part = probability(models[i].transform(part), name)
            parts.append(part)
        stacked = compact(materialize(union_all(parts), "oof"))
        for name in self.learners:
            self.cv_scores[name] = roc_auc(stacked.withColumn("p", F.col(name)), ["fold"]).agg(F.avg("auc")).first()[0]
        n = stacked.count()
        meta = self.meta or LogisticRegression(family="binomial", regParam=1.0 / max(n, 1), standardization=False, maxIter=1000)
        self.meta_model = meta.copy({meta.featuresCol: "_meta"}).fit(_with_meta(stacked, list(self.learners)))
        return self

    def predict(self, data: DataFrame, name: str = "p") -> DataFrame:
        if self.meta_model is None:
            raise RuntimeError("call fit first")
        out, helpers = data, []
        for learner, models in self.fold_models.items():
            columns = [f"_{learner}_{i}" for i in range(len(models))]
            for column, m in zip(columns, models):
                out = probability(m.transform(out), column)
            out = out.withColumn(learner, sum([F.col(c) for c in columns[1:]], F.col(columns[0])) / len(columns))
            helpers += [*columns, learner]
        return probability(self.meta_model.transform(_with_meta(out, list(self.learners))), name).drop("_meta", *helpers)

    def predict_label(self, data: DataFrame) -> DataFrame:
        return self.predict(data).withColumn("predicted", F.when(F.col("p") >= 0.5, 1).otherwise(0))

    def importance(self, space: FeatureSpace, spark) -> DataFrame:
        """Mean fold importance of each learner that has one."""
        rows = []
        for name, models in self.fold_models.items():
            if hasattr(models[0], "featureImportances"):
                mean = np.mean([m.featureImportances.toArray() for m in models], axis=0)
                rows += [(name, n, float(v)) for n, v in zip(space.names, mean)]
        return spark.createDataFrame(rows, "model string, feature string, importance double")


def default_learners(rounds: int = 50, seed: int = 42) -> dict[str, Estimator]:
    """Two boosted-tree variants and a random forest."""
    return {"deep_boost": GBTClassifier(maxIter=rounds, maxDepth=5, stepSize=0.1, seed=seed),
            "shallow_boost": GBTClassifier(maxIter=rounds, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=seed),
            "forest": RandomForestClassifier(numTrees=rounds, maxDepth=6, seed=seed)}


def quick_stack(train: DataFrame, test: DataFrame, folds: int = 5, rounds: int = 50) -> DataFrame:
    """Stack the default learners on ``train`` and score ``test``."""
    return Stacking(default_learners(rounds), folds=folds).fit(train).predict(test)


@dataclass
class RidgeStack:
    """Three tree learners and an L1 logistic, blended by ridge regression on a hold-out."""

    rounds: int = 50
    alpha: float = 1.0
    seed: int = 42
    scores: dict[str, float] = field(default_factory=dict)
    bases: dict[str, Model] = field(default_factory=dict, repr=False)
    scaler: Model | None = field(default=None, repr=False)
    meta_model: Model | None = field(default=None, repr=False)

    def _learners(self, n: int) -> dict[str, Estimator]:
        return {**default_learners(self.rounds, self.seed),
                "logreg": LogisticRegression(family="binomial", elasticNetParam=1.0, regParam=1.0 / (0.1 * max(n, 1)), standardization=False, maxIter=1000)}

    def _fit_bases(self, data: DataFrame):
        data = compact(data)
        flat, scaler = scaled(data)
        return run_fits(data.sparkSession, {k: lambda k=k, e=e: e.fit(flat if k == "logreg" else data) for k, e in self._learners(data.count()).items()}), scaler

    def _base_predictions(self, data: DataFrame, bases, scaler) -> DataFrame:
        out = data
        for name, m in bases.items():
            if name == "logreg":
                kept = out.withColumn("_raw", F.col("features"))
                out = probability(m.transform(scaled(kept, scaler)[0]), name).drop("features").withColumnRenamed("_raw", "features")
            else:
                out = probability(m.transform(out), name)
        return _with_meta(out, list(bases))

    def fit(self, data: DataFrame) -> "RidgeStack":
        split = materialize(stratified_holdout(data, 0.2, self.seed), "holdout")
        bases, scaler = self._fit_bases(split.where(~F.col("holdout")))
        held = materialize(self._base_predictions(split.where("holdout"), bases, scaler), "held")
        for name in bases:
            first = roc_auc(held.select("label_positive", F.col(name).alias("p"), F.lit(1).alias("_all")), ["_all"]).first()
            self.scores[name] = first["auc"] if first else None
        # ridge: squared error + alpha * |w|^2, per row
        self.meta_model = LinearRegression(featuresCol="_meta", regParam=self.alpha / max(held.count(), 1), elasticNetParam=0.0,
                                           standardization=False).fit(held)
        self.bases, self.scaler = self._fit_bases(data)
        return self

    def predict(self, data: DataFrame, name: str = "p") -> DataFrame:
        out = self.meta_model.transform(self._base_predictions(data, self.bases, self.scaler))
        clipped = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
        return out.withColumn(name, clipped).drop("prediction", "_meta", *self.bases)

    def importance(self, space: FeatureSpace, spark) -> DataFrame:
        rows = []
        for name, m in self.bases.items():
            values = np.abs(m.coefficients.toArray()) if name == "logreg" else m.featureImportances.toArray()
            rows += [(name, n, float(v)) for n, v in zip(space.names, values)]
        return merge_importance(spark.createDataFrame(rows, "model string, feature string, importance double"))


def merge_importance(importance: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Importance per feature summed over models with their weights; signs of linear ones are dropped."""
    w = F.lit(0.0)
    for model, value in (weights or IMPORTANCE_WEIGHTS).items():
        w = F.when(F.col("model") == model, F.lit(value)).otherwise(w)
    return importance.groupBy("feature").agg(F.sum(F.abs("importance") * w).alias("importance"))


Metric = str | Callable[[DataFrame], DataFrame]


def _scores(rows: DataFrame, metric: Metric) -> dict[int, float]:
    """Score per candidate; a callable gets (candidate, label_positive, p) rows and returns (candidate, score)."""
    if callable(metric):
        out = metric(rows).select("candidate", "score")
    elif metric == "roc_auc":
        out = roc_auc(rows, ["candidate"]).select("candidate", F.col("auc").alias("score"))
    elif metric == "log_loss":
        out = log_loss(rows, ["candidate"]).select("candidate", (-F.col("log_loss")).alias("score"))
    else:
        raise ValueError(f"unknown metric: {metric}")
    return {r.candidate: r.score for r in out.collect()}


def hill_climb(predictions: DataFrame, models: list[str], metric: Metric = "roc_auc", iterations: int = 100, step: float = 0.01,
               batch: int = 20, seed: int = 42) -> tuple[list[float], float, list[float]]:
    """Ensemble weights by random perturbation; returns weights, score and score history.

    A batch of perturbations of the current weights is scored in one grouped job; the
    best is kept when it improves. The driver only sees one score per candidate.
    """
    rng = np.random.RandomState(seed)
    weights = np.full(len(models), 1.0 / len(models))
    stored = materialize(predictions.select("label_positive", *models), "predictions")

    def score(candidates: list[np.ndarray]) -> dict[int, float]:
        listed = F.array(*[F.struct(F.lit(i).alias("candidate"),
                                    sum((F.col(m) * float(w) for m, w in zip(models[1:], c[1:])), F.col(models[0]) * float(c[0])).alias("p"))
                           for i, c in enumerate(candidates)])
        return _scores(stored.select("label_positive", F.inline(listed)), metric)

    current = score([weights])[0]
    history, done = [current], 0
    while done < iterations:
        size = min(batch, iterations - done)
        candidates = []
        for _ in range(size):
            c = np.maximum(weights + rng.randn(len(models)) * step, 0.0)
            candidates.append(c / c.sum() if c.sum() > 0 else np.full(len(models), 1.0 / len(models)))
        found = score(candidates)
        best = max(found, key=found.get)
        if found[best] > current:
            weights, current = candidates[best], found[best]
        history.append(current)
        done += size
        step *= 0.95 ** (10.0 * size / iterations)
    return [float(w) for w in weights], float(current), history


def weighted_average(predictions: DataFrame, models: list[str], weights: list[float], name: str = "p") -> DataFrame:
    total = sum(weights)
    return predictions.withColumn(name, sum((F.col(m) * (w / total) for m, w in zip(models[1:], weights[1:])), F.col(models[0]) * (weights[0] / total)))
