"""Independent fits at the same time, and boosted fits stopped by a validation curve."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame, SparkSession

#: Fits that the driver has under way at once.
WIDTH = 8
#: Rows of a training table that one task holds.
ROWS_PER_TASK = 50_000


def run_fits(spark: SparkSession, fits: dict[Hashable, Callable[[], object]], width: int = WIDTH) -> dict[Hashable, object]:
    """Results of all calls by key; at most ``width`` run at once, each in a job group and pool of its own.

    When one fails, the jobs of the others are cancelled and its error is raised.
    """
    if width < 2 or len(fits) < 2:
        return {k: f() for k, f in fits.items()}
    sc = spark.sparkContext
    groups = {k: f"fit-{uuid.uuid4().hex}" for k in fits}

    def call(key):
        sc.setJobGroup(groups[key], str(key), interruptOnCancel=True)
        sc.setLocalProperty("spark.scheduler.pool", groups[key])
        return fits[key]()

    with ThreadPoolExecutor(min(width, len(fits))) as pool:
        running = {pool.submit(inheritable_thread_target(spark)(call), k): k for k in fits}
        done, rest = wait(running, return_when=FIRST_EXCEPTION)
        failed = next((f for f in done if f.exception()), None)
        if failed:
            for f in rest:
                f.cancel()
                sc.cancelJobGroup(groups[running[f]])
            raise failed.exception()
    found = {k: f.result() for f, k in running.items()}
    return {k: found[k] for k in fits}


def compact(rows: DataFrame) -> DataFrame:
    """A stored training table in as few tasks as its number of rows asks for; every step of a fit is a job over them."""
    return rows.coalesce(max(1, -(-rows.count() // ROWS_PER_TASK)))


def best_round(losses: list[float], patience: int) -> tuple[int, int]:
    """(round of least loss, round at which ``patience`` rounds have passed without a lesser one); rounds count from 1."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, i + 1
    return best + 1, len(losses)


def first_trees(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The ensemble of the model's first trees."""
    java, sc = model._java_obj, SparkContext._active_spark_context
    trees = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = sc._gateway.new_array(sc._jvm.double, rounds)
    all_trees, all_weights = java.trees(), java.treeWeights()
    for i in range(rounds):
        trees[i], weights[i] = all_trees[i], all_weights[i]
    cut = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"{model.uid}_{rounds}", trees, weights, model.numFeatures, 2)
    out = GBTClassificationModel(cut)
    return out.setFeaturesCol(model.getFeaturesCol())


def boost_until_flat(trees: GBTClassifier, train: DataFrame, held: DataFrame, max_rounds: int = 1000, patience: int = 100) -> tuple[GBTClassificationModel, list[float]]:
    """(model cut to its best round, loss on the held rows per round up to where it stopped).

    The loss is read after every round, and boosting ends when ``patience`` rounds bring no lesser one. A fit cannot be
    continued, so rounds are doubled until the end lies within them: a round's trees depend on the seed and the round
    only, and all fits together have at most about twice the rounds of the last.
    """
    rounds = min(max_rounds, patience + 28)
    while True:
        model = trees.copy({trees.maxIter: rounds}).fit(train)
        losses = model.evaluateEachIteration(held)
        best, stop = best_round(losses, patience)
        if stop - best >= patience or rounds >= max_rounds:
            return first_trees(model, best), losses[:stop]
        rounds = min(2 * rounds, max_rounds)
