"""Fitting on feature tables with Spark ML.

Features stay long until a selected vocabulary turns them into one sparse vector per
repertoire. Folds and hold-outs come from a seeded hash of the repertoire.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F

from clonara.constants import CLASS_WEIGHT, CLASS_WEIGHT_DEFAULT, REP
from clonara.functions.text import dataset_id
from clonara.operators.fits import best_round, boost_until_flat, compact, run_fits
from clonara.operators.align import union_all
from clonara.operators.evaluate import balanced_accuracy, roc_auc
from clonara.operators.kmers import sparse_rows
from clonara.operators.ranks import dense_numbers, densify
from clonara.session import materialize

# ---- feature tables ----------------------------------------------------------------


def moments(features: DataFrame, n: Column) -> DataFrame:
    """Sums per feature; repertoires without the feature count as zero through ``n``."""
    x = F.col("value")
    return (features.groupBy("feature").agg(F.sum(x).alias("s"), F.sum(x * x).alias("ss")).withColumn("n", n))


def select_variance(features: DataFrame, repertoires: DataFrame, top: int) -> DataFrame:
    """Features of largest sample variance, absent values being zero."""
    n = repertoires.agg(F.count(F.lit(1))).scalar()
    var = (F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))
    return (moments(features, n).select("feature", F.greatest(var, F.lit(0.0)).alias("variance"))
            .orderBy(F.desc(F.round("variance", 9)), "feature").limit(top))


def standardize(features: DataFrame, repertoires: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Mean zero and population deviation one over all repertoires, for a selected vocabulary."""
    n = repertoires.agg(F.count(F.lit(1))).scalar()
    kept = features.join(vocabulary.select("feature"), "feature")
    mean = F.col("s") / F.col("n")
    var = F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))
    scale = moments(kept, n).select("feature", mean.alias("mean"), F.sqrt(var).alias("sd"))
    z = (F.col("value") - F.coalesce("mean", F.lit(0.0))) / F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(F.lit(1.0))
    return densify(kept, repertoires, vocabulary, REP, ["feature"]).join(scale, "feature", "left").select(*REP, "feature", z.alias("value"))


def number_features(selected: DataFrame) -> DataFrame:
    """Index a selected vocabulary by name order (a few thousand names at most)."""
    names = selected.select("feature").agg(F.sort_array(F.collect_set("feature")).alias("names"))
    return names.select(F.posexplode("names").alias("index", "feature"))


def assemble(features: DataFrame, vocabulary: DataFrame, repertoires: DataFrame, size: int) -> DataFrame:
    """One vector per repertoire over an indexed vocabulary; absent features are zero.

    ``size`` is that of a selected list. The sorted positions of a repertoire's features and the zeros between them are
    laid side by side, so the work is that of the vector's length.
    """
    rows = sparse_rows(features, vocabulary)
    n = F.size("indices")
    # each entry brings itself and the zeros up to the next one; the first brings those before it, too
    at = lambda i: F.get("indices", i).cast("int")
    upto = lambda i: F.coalesce(at(i + 1), F.lit(size))
    zeros = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))
    own = lambda i: F.when((i > 0) & (at(i) == at(i - 1)), F.array().cast("array<double>")).otherwise(F.array(F.get("values", i)))
    runs = F.transform("indices", lambda _, i: F.concat(own(i), zeros(upto(i) - at(i) - 1)))
    filled = F.concat(zeros(F.when(n > 0, at(F.lit(0))).otherwise(size)), F.flatten(runs))
    none = F.array_repeat(F.lit(0.0), size)
    return (repertoires.join(rows, REP, "left").withColumn("features", array_to_vector(F.when(F.col("indices").isNull(), none).otherwise(filled)))
            .drop("indices", "values"))


@dataclass
class FeatureSpace:
    """A selected vocabulary and the vectors over it."""

    names: list[str] = field(default_factory=list)
    vocabulary: DataFrame | None = field(default=None, repr=False)

    @classmethod
    def of(cls, selected: DataFrame) -> "FeatureSpace":
        vocabulary = materialize(number_features(selected), "vocabulary")
        names = [r.feature for r in vocabulary.orderBy("index").collect()]
        return cls(names, vocabulary)

    def vectors(self, features: DataFrame, repertoires: DataFrame) -> DataFrame:
        return assemble(features, self.vocabulary, repertoires, len(self.names))


def labelled(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("label", F.col("label_positive").cast("double"))


def with_class_weight(df: DataFrame, weights: dict[int, float] | None = None, default: float = CLASS_WEIGHT_DEFAULT) -> DataFrame:
    """Weight of positives by dataset number; negatives weigh one."""
    w = F.lit(default)
    for number, value in (CLASS_WEIGHT if weights is None else weights).items():
        w = F.when(dataset_id("dataset") == number, F.lit(float(value))).otherwise(w)
    return df.withColumn("weight", F.when(F.col("label_positive"), w).otherwise(F.lit(1.0)))


# ---- splits ------------------------------------------------------------------------


def _shuffled(df: DataFrame, group: list[str], seed: int, name: str) -> DataFrame:
    """Number rows per group in a seeded random order."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *REP).cast("binary"))
    rows = df.withColumn("_h", F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"))
    return dense_numbers(rows, group, F.shiftright("_h", 38), [F.asc("_h"), *[F.asc(c) for c in REP]], name).drop("_h")


def stratified_folds(metadata: DataFrame, splits: int = 5, seed: int = 42, by: list[str] = ()) -> DataFrame:
    """Fold of each repertoire with equal class shares; fewer folds when a class is small."""
    y = F.col("label_positive")
    sizes = metadata.groupBy(*by).agg(F.count_if(y).alias("_p"), F.count_if(~y).alias("_q"))
    n = F.least(F.lit(splits), F.greatest(F.lit(2), F.least("_p", "_q")))
    numbered = _shuffled(metadata, [*by, "label_positive"], seed, "_i")
    if by:
        numbered = numbered.join(sizes, list(by))
    else:
        both = sizes.select(F.struct("_p", "_q")).scalar()
        numbered = numbered.withColumn("_p", both["_p"]).withColumn("_q", both["_q"])
    return numbered.withColumn("fold", F.pmod(F.col("_i") - 1, n).cast("int")).drop("_i", "_p", "_q")


def stratified_holdout(metadata: DataFrame, share: float = 0.2, seed: int = 42, stratify: bool = True, by: list[str] = ()) -> DataFrame:
    """Mark ``holdout`` for a share of each class (or of all rows)."""
    group = [*by, "label_positive"] if stratify else list(by)
    sizes = metadata.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    numbered = _shuffled(metadata, group, seed, "_i")
    numbered = numbered.join(sizes, group) if group else numbered.withColumn("_n", sizes.scalar())
    return numbered.withColumn("holdout", F.col("_i") <= share * F.col("_n")).drop("_i", "_n")


def dataset_folds(metadata: DataFrame) -> DataFrame:
    """Leave-one-dataset-out: the fold is the dataset."""
    return metadata.withColumn("fold", dataset_id("dataset"))


# ---- prediction and cross-validation -----------------------------------------------


def probability(predicted: DataFrame, name: str = "p") -> DataFrame:
    """Probability of the positive class as a plain column."""
    return predicted.withColumn(name, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


def fold_values(df: DataFrame) -> list[int]:
    return sorted(r.fold for r in df.select("fold").distinct().collect())


def out_of_fold(estimator: Estimator, df: DataFrame, name: str = "p") -> tuple[DataFrame, dict[int, Model]]:
    """Each row predicted by the model that did not see its fold, and the models; folds are fitted at the same time."""
    models = fold_models(estimator, df)
    parts = [probability(m.transform(df.where(F.col("fold") == f)), name) for f, m in models.items()]
    return union_all(parts), models


def fold_models(estimator: Estimator, df: DataFrame) -> dict[int, Model]:
    """The model of each fold, fitted on the rows of all others."""
    return run_fits(df.sparkSession, {f: lambda f=f: estimator.fit(df.where(F.col("fold") != f)) for f in fold_values(df)})


def mean_fold_score(predicted: DataFrame, metric: str = "roc_auc") -> float:
    scorer, column = {"roc_auc": (roc_auc, "auc"), "balanced_accuracy": (balanced_accuracy, "balanced_accuracy")}[metric]
    return scorer(predicted, ["fold"]).agg(F.avg(column)).first()[0]


def seed_average(predictions: DataFrame) -> DataFrame:
    """Mean over models within a seed, then over seeds."""
    within = predictions.groupBy("ID", "seed").agg(F.avg("p").alias("p"))
    return within.groupBy("ID").agg(F.avg("p").alias("p"))


def blend_weights(coefficients: DataFrame, group: list[str] = ()) -> DataFrame:
    """Non-negative coefficients scaled to sum one; equal when none is positive."""
    rows = coefficients.withColumn("c", F.greatest(F.col("coefficient"), F.lit(0.0)))
    total = rows.groupBy(*group).agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("n"))
    if group:
        joined = rows.join(total, list(group))
    else:
        one = total.select(F.struct("t", "n")).scalar()
        joined = rows.withColumn("t", one["t"]).withColumn("n", one["n"])
    return joined.select(*group, "model", F.when(F.col("t") > 0, F.col("c") / F.nullif(F.col("t"), F.lit(0.0))).otherwise(1 / F.col("n")).alias("weight"))


# ---- estimators --------------------------------------------------------------------


def select_gain(data: DataFrame, space: FeatureSpace, top: int = 500, rounds: int = 30, depth: int = 4) -> DataFrame:
    """Features ranked by importance in shallow boosted trees, filled up in name order."""
    model = GBTClassifier(maxDepth=depth, maxIter=rounds, stepSize=0.1, seed=42).fit(compact(data))
    gains = model.featureImportances
    scored = sorted(((float(gains[i]), n) for i, n in enumerate(space.names)), key=lambda g: (-g[0], g[1]))
    rows = [(n, g, i + 1) for i, (g, n) in enumerate(scored[:top])]
    return data.sparkSession.createDataFrame(rows, "feature string, gain double, rank int")


def coefficient_table(model, space: FeatureSpace, spark) -> DataFrame:
    rows = [(n, float(c), abs(float(c))) for n, c in zip(space.names, model.coefficients.toArray())]
    return spark.createDataFrame(rows, "feature string, coefficient double, abs_coefficient double").orderBy(F.desc("abs_coefficient"), "feature")


def scaled(data: DataFrame, fitted=None):
    """Standardised vectors and the fitted scaler."""
    fitted = fitted or StandardScaler(inputCol="features", outputCol="_scaled", withMean=True, withStd=True).fit(data)
    return fitted.transform(data).drop("features").withColumnRenamed("_scaled", "features"), fitted


@dataclass
class SparseLogistic:
    """L1 logistic regression with its strength chosen by cross-validation."""

    c_values: tuple[float, ...] = (1.0, 0.2, 0.1, 0.05, 0.03)
    folds: int = 5
    metric: str = "roc_auc"
    seed: int = 42
    holdout: float = 0.2
    best_c: float | None = None
    cv_score: float | None = None
    holdout_score: float | None = None
    prior: float | None = None
    model: Model | None = field(default=None, repr=False)
    scaler: Model | None = field(default=None, repr=False)

    def fit(self, data: DataFrame) -> "SparseLogistic":
        """Tune on the training part, refit it with the best strength, score the hold-out."""
        if self.metric not in ("roc_auc", "balanced_accuracy"):
            raise ValueError(f"unknown metric: {self.metric}")
        split = materialize(stratified_holdout(data, self.holdout, self.seed), "holdout")
        train = split.where(~F.col("holdout")).drop("holdout")
        train, self.scaler = scaled(train)
        train = compact(materialize(stratified_folds(train, self.folds, self.seed), "folds"))
        count = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
        n, k = sum(count.values()), len(fold_values(train))
        lr = LogisticRegression(family="binomial", elasticNetParam=1.0, standardization=False, maxIter=1000, tol=1e-4)
        if min(count.get(0.0, 0), count.get(1.0, 0)) < 2:
            # too few of a class to tune; with one class only its share is left to predict
            self.best_c = self.c_values[0]
            self.prior = count.get(1.0, 0) / max(n, 1)
            self.model = lr.copy({lr.regParam: 1.0 / (self.best_c * n)}).fit(train) if 0 < self.prior < 1 else None
            return self
        # CV fits see (k-1)/k of the rows; the penalty is per row
        grid = {c: 1.0 / (c * n * (k - 1) / k) for c in self.c_values}
        maps = ParamGridBuilder().addGrid(lr.regParam, list(grid.values())).build()
        if self.metric == "roc_auc":
            evaluator = BinaryClassificationEvaluator(numBins=0)
        else:
            evaluator = MulticlassClassificationEvaluator(metricName="weightedRecall", weightCol="_balance")
            share = count
            train = train.withColumn("_balance", F.when(F.col("label") == 1.0, F.lit(1.0 / share.get(1.0, 1))).otherwise(F.lit(1.0 / share.get(0.0, 1))))
        cv = CrossValidator(estimator=lr, estimatorParamMaps=maps, evaluator=evaluator, numFolds=k, foldCol="fold", parallelism=8).fit(train)
        best = max(range(len(maps)), key=lambda i: cv.avgMetrics[i])
        self.best_c, self.cv_score = self.c_values[best], cv.avgMetrics[best]
        self.model = lr.copy({lr.regParam: 1.0 / (self.best_c * n)}).fit(train)
        if self.holdout > 0:
            out = probability(self.model.transform(scaled(split.where("holdout"), self.scaler)[0]))
            scorer, column = (roc_auc, "auc") if self.metric == "roc_auc" else (balanced_accuracy, "balanced_accuracy")
            first = scorer(out.withColumn("_all", F.lit(1)), ["_all"]).first()
            self.holdout_score = first[column] if first else None
        return self

    def predict(self, data: DataFrame, name: str = "p") -> DataFrame:
        if self.model is None:
            return data.withColumn(name, F.lit(self.prior))
        return probability(self.model.transform(scaled(data, self.scaler)[0]), name)

    def predict_label(self, data: DataFrame) -> DataFrame:
        return self.predict(data).withColumn("predicted", F.col("p") > 0.5)


@dataclass
class BoostedEnsemble:
    """Two boosted-tree variants averaged over seeds, with the number of rounds found by cross-validation.

    Every fold's fit runs until ``patience`` rounds bring no lesser loss on the held fold, ``max_rounds`` at most, and
    predicts with the trees up to its best round. The final fits have the mean best round plus ``extra_rounds``.
    """

    seeds: tuple[int, ...] = (42, 123, 456)
    folds: int = 5
    max_rounds: int = 1000
    patience: int = 100
    min_rounds: int = 100
    extra_rounds: int = 50
    variants: tuple[dict, ...] = ({"maxDepth": 6, "stepSize": 0.03, "subsamplingRate": 0.8, "minInstancesPerNode": 15, "featureSubsetStrategy": "0.8"},
                                  {"maxDepth": 5, "stepSize": 0.02, "minInstancesPerNode": 20})
    models: dict = field(default_factory=dict, repr=False)
    cv_scores: dict = field(default_factory=dict)
    curves: dict = field(default_factory=dict, repr=False)
    rounds: dict = field(default_factory=dict)
    weights: list[float] | None = None

    def _trees(self, variant: int, seed: int, rounds: int = 1) -> GBTClassifier:
        return GBTClassifier(maxIter=rounds, seed=seed, weightCol="weight", **self.variants[variant])

    def fit(self, data: DataFrame, learn_weights: bool = False) -> "BoostedEnsemble":
        """``data`` holds features, label, label_positive and weight; the fits of all seeds, folds and variants share a pool."""
        spark, variants = data.sparkSession, range(len(self.variants))
        data = compact(data)
        rows = {seed: compact(materialize(stratified_folds(data, self.folds, seed), "folds")) for seed in self.seeds}
        held = lambda seed, f: rows[seed].where(F.col("fold") == f)
        keys = [(seed, f, i) for seed in self.seeds for f in fold_values(rows[seed]) for i in variants]
        found = run_fits(spark, {(seed, f, i): lambda seed=seed, f=f, i=i: boost_until_flat(
            self._trees(i, seed), rows[seed].where(F.col("fold") != f), held(seed, f), self.max_rounds, self.patience) for seed, f, i in keys})
        self.curves = {k: losses for k, (_, losses) in found.items()}
        names = [f"p{i}" for i in variants]
        for seed in self.seeds:
            parts, best = [], []
            for f in fold_values(rows[seed]):
                part = held(seed, f)
                for i in variants:
                    model = found[seed, f, i][0]
                    best.append(model.getNumTrees)
                    part = probability(model.transform(part), names[i])
                parts.append(part)
            oof = materialize(union_all(parts), "oof")
            mean = sum(F.col(n) for n in names) / len(names)
            self.cv_scores[seed] = roc_auc(oof.select("label_positive", mean.alias("p"), F.lit(1).alias("_all")), ["_all"]).first()["auc"]
            if learn_weights and self.weights is None:
                self.weights = stacked_weights(oof, names)
            self.rounds[seed] = max(int(sum(best) / len(best)) + self.extra_rounds, self.min_rounds)
        last = run_fits(spark, {(seed, i): lambda seed=seed, i=i: self._trees(i, seed, self.rounds[seed]).fit(data) for seed in self.seeds for i in variants})
        self.models = {seed: [last[seed, i] for i in variants] for seed in self.seeds}
        return self

    def curve(self, spark) -> DataFrame:
        """(seed, fold, variant, round, loss, chosen) of the validation curves."""
        rows = [(seed, f, i, r, float(loss), r == best_round(losses, self.patience)[0])
                for (seed, f, i), losses in self.curves.items() for r, loss in enumerate(losses, 1)]
        return spark.createDataFrame(rows, "seed int, fold int, variant int, round int, loss double, chosen boolean")

    def predict(self, data: DataFrame, name: str = "p") -> DataFrame:
        """Weighted mean within a seed, plain mean over seeds."""
        weights = self.weights or [1.0 / len(self.variants)] * len(self.variants)
        out, terms = data, []
        for seed, models in self.models.items():
            for i, m in enumerate(models):
                column = f"_p{seed}_{i}"
                out = probability(m.transform(out), column)
                terms.append(F.col(column) * (weights[i] / len(self.models)))
        return out.withColumn(name, sum(terms[1:], terms[0])).drop(*[c for c in out.columns if c.startswith("_p")])

    def importance(self, space: FeatureSpace, spark) -> DataFrame:
        """Mean importance over all fitted trees."""
        fitted = [m for ms in self.models.values() for m in ms]
        totals = sum(m.featureImportances.toArray() for m in fitted) / len(fitted)
        return spark.createDataFrame([(n, float(v)) for n, v in zip(space.names, totals)], "feature string, importance double")


def stacked_weights(oof: DataFrame, names: list[str]) -> list[float]:
    """Logistic coefficients on out-of-fold predictions, clipped at zero and normalised."""
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=names, outputCol="_meta").transform(oof)
    coef = LogisticRegression(family="binomial", featuresCol="_meta", maxIter=2000, regParam=1.0 / max(rows.count(), 1)).fit(rows).coefficients
    clipped = [max(float(c), 0.0) for c in coef]
    total = sum(clipped)
    return [c / total for c in clipped] if total > 0 else [1.0 / len(names)] * len(names)


def multilayer_perceptron(size: int, hidden: tuple[int, ...] = (64, 16), rounds: int = 100, seed: int = 42) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=[size, *hidden, 2], maxIter=rounds, seed=seed)


def best_model(data: DataFrame, size: int, folds: int = 5, rounds: int = 100, seed: int = 42):
    """Logistic, L1 logistic or perceptron, whichever has the best mean fold AUC; refit on all rows."""
    rows, scaler = scaled(data)
    rows = compact(materialize(stratified_folds(rows, folds, seed), "folds"))
    n = rows.count()
    options = {"logistic": LogisticRegression(family="binomial", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=2000),
               "logistic_l1": LogisticRegression(family="binomial", regParam=1.0 / (0.1 * n), elasticNetParam=1.0, standardization=False, maxIter=2000),
               "perceptron": multilayer_perceptron(size, rounds=rounds, seed=seed)}
    fitted = run_fits(data.sparkSession, {(name, f): lambda e=e, f=f: e.fit(rows.where(F.col("fold") != f)) for name, e in options.items() for f in fold_values(rows)})
    predicted = {name: [probability(m.transform(rows.where(F.col("fold") == f))) for (of, f), m in fitted.items() if of == name] for name in options}
    scores = {name: mean_fold_score(union_all(parts)) for name, parts in predicted.items()}
    chosen = max(scores, key=lambda k: scores[k] if scores[k] is not None else -1.0)
    return chosen, scores, options[chosen].fit(rows), scaler


INTERCEPT = "(intercept)"


def leave_one_dataset_out(estimator: Estimator, data: DataFrame) -> DataFrame:
    """AUC of each dataset under a model of the others, with mean and deviation."""
    from clonara.operators.reports import cv_summary

    oof, _ = out_of_fold(estimator, compact(dataset_folds(data)))
    return cv_summary(roc_auc(oof, ["dataset"]))


def fold_coefficients(models: dict[int, Model], space: FeatureSpace, spark) -> DataFrame:
    """(fold, feature, coefficient) of linear models by the fold they never saw, the intercept among them; stored."""
    rows = [(f, n, float(c)) for f, m in models.items() for n, c in zip([*space.names, INTERCEPT], [*m.coefficients.toArray(), m.intercept])]
    return materialize(spark.createDataFrame(rows, "fold int, feature string, coefficient double"), "coefficients")


def routed_scores(features: DataFrame, repertoires: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Each repertoire scored by the model of its ``fold``, so one that never saw its dataset, in one pass over the features.

    Absent features are zero; a repertoire whose fold has no model gets no row.
    """
    known = repertoires.select(*REP, "fold").join(coefficients.where(F.col("feature") == INTERCEPT).select("fold", F.col("coefficient").alias("_start")), "fold")
    terms = (features.select(*REP, "feature", "value").join(known, REP).join(coefficients, ["fold", "feature"])
             .groupBy(*REP).agg(F.sum(F.col("coefficient") * F.col("value")).alias("_sum")))
    z = F.col("_start") + F.coalesce("_sum", F.lit(0.0))
    return known.join(terms, REP, "left").select(*REP, "fold", (1 / (1 + F.exp(-z))).alias("p"))
