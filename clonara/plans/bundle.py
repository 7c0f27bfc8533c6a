"""Fitted featurizers and predictors as folders that another session loads.

A bundle holds the plain settings of a fitted object as one line of text, its tables as Parquet and its models in their
own form, each in a folder named after the field. Objects inside objects are bundles inside bundles.
"""

from __future__ import annotations

import ast
import dataclasses

from pyspark.ml.base import Model
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession

from clonara.operators.clonotypes import PublicClones
from clonara.operators.ensemble import RidgeStack, Stacking
from clonara.operators.genes import GeneFeaturizer
from clonara.operators.kmers import KmerFeaturizer
from clonara.operators.model import BoostedEnsemble, FeatureSpace, SparseLogistic
from clonara.plans.predictor import RepertoirePredictor

KINDS = {c.__name__: c for c in (KmerFeaturizer, GeneFeaturizer, PublicClones, FeatureSpace, SparseLogistic, BoostedEnsemble, Stacking, RidgeStack, RepertoirePredictor)}
#: Fields that belong to the data of a fit, not to what it learned.
LEFT_OUT = {"RepertoirePredictor": {"rows", "metadata"}, "Stacking": {"learners", "meta"}}


def save(fitted, path: str, spark: SparkSession) -> None:
    """Write a fitted object of one of KINDS; the folder must not exist. The settings are written last, so a bundle
    without them is one whose writing broke off."""
    kind = type(fitted).__name__
    if kind not in KINDS:
        raise TypeError(f"no bundle for {kind}")
    plain, stored = {}, {}
    for f in dataclasses.fields(fitted):
        if f.name not in LEFT_OUT.get(kind, ()):
            plain[f.name], stored[f.name] = _written(getattr(fitted, f.name), f"{path}/{f.name}", spark)
    line = repr((kind, plain, stored))
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{path}/settings")


def _written(value, path: str, spark: SparkSession):
    """(plain value, how its stored parts are read back); one of them is None."""
    if isinstance(value, DataFrame):
        value.write.parquet(path)
        return None, "table"
    if isinstance(value, Model):
        value.write().save(path)
        return None, "model"
    if type(value).__name__ in KINDS:
        save(value, path, spark)
        return None, "bundle"
    if isinstance(value, (dict, list)) and any(_holds_models(v) for v in (value.values() if isinstance(value, dict) else value)):
        items = list(value.items()) if isinstance(value, dict) else list(enumerate(value))
        return None, (type(value).__name__, [(k, *_written(v, f"{path}/{i}", spark)) for i, (k, v) in enumerate(items)])
    value = _python(value)
    try:
        if ast.literal_eval(repr(value)) == value:
            return value, None
    except (ValueError, SyntaxError):
        pass
    raise TypeError(f"cannot store {value!r}")


def _python(value):
    """Numbers of numpy as Python's own."""
    if isinstance(value, dict):
        return {_python(k): _python(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return type(value)(map(_python, value))
    return value.item() if hasattr(value, "item") else value


def _holds_models(value) -> bool:
    return isinstance(value, Model) or isinstance(value, (dict, list)) and any(map(_holds_models, value.values() if isinstance(value, dict) else value))


def load(spark: SparkSession, path: str):
    """The object that was saved; what belonged to the data of its fit is empty."""
    kind, plain, stored = ast.literal_eval(spark.read.text(f"{path}/settings").first().value)
    values = {name: _read(spark, plain[name], stored[name], f"{path}/{name}") for name in plain}
    if kind == "Stacking":  # prediction asks for the learners' names only
        values["learners"] = dict.fromkeys(values["fold_models"])
    return KINDS[kind](**values)


def _read(spark: SparkSession, plain, how, path: str):
    if how is None:
        return plain
    if how == "table":
        return spark.read.parquet(path)
    if how == "model":
        return DefaultParamsReader.loadParamsInstance(path, spark)
    if how == "bundle":
        return load(spark, path)
    kind, items = how
    values = [(k, _read(spark, p, h, f"{path}/{i}")) for i, (k, p, h) in enumerate(items)]
    return dict(values) if kind == "dict" else [v for _, v in values]
