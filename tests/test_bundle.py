"""Saved objects give what they gave before, also in another session."""

import subprocess
import sys
import textwrap

import pytest

from clonara.constants import REP
from clonara.operators import ensemble, model
from clonara.operators.clonotypes import PublicClones
from clonara.operators.genes import GeneFeaturizer
from clonara.operators.kmers import KmerFeaturizer
from clonara.plans import bundle
from clonara.plans.model_queries import training
from clonara.plans.predictor import RepertoirePredictor
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from support import SF


def same(a, b):
    assert a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_featurizers(spark, rows, tmp_path):
    for fitted in (KmerFeaturizer((3, 4), 20).fit(rows), GeneFeaturizer(3, 2, 4).fit(rows), PublicClones(1, 1).fit(rows)):
        path = str(tmp_path / type(fitted).__name__)
        bundle.save(fitted, path, spark)
        again = bundle.load(spark, path)
        assert type(again) is type(fitted)
        same(again.transform(rows), fitted.transform(rows))


def test_models(spark, tables, tmp_path):
    data, _ = training(tables)
    fits = [model.SparseLogistic(c_values=(0.1,), folds=2).fit(data),
            model.BoostedEnsemble(seeds=(1, 2), folds=2, max_rounds=3, patience=2, min_rounds=2, extra_rounds=0, variants=({"maxDepth": 2}, {"maxDepth": 1})).fit(data, learn_weights=True),
            ensemble.Stacking({"lr": LogisticRegression(regParam=0.1), "gbt": GBTClassifier(maxIter=2, maxDepth=2, seed=1)}, folds=2).fit(data)]
    for fitted in fits:
        path = str(tmp_path / type(fitted).__name__)
        bundle.save(fitted, path, spark)
        same(bundle.load(spark, path).predict(data).select(*REP, "p"), fitted.predict(data).select(*REP, "p"))


def test_unknown_things_are_refused(spark, tmp_path):
    with pytest.raises(TypeError):
        bundle.save(object(), str(tmp_path / "x"), spark)
    with pytest.raises(TypeError):
        bundle.save(KmerFeaturizer(per_k=object()), str(tmp_path / "y"), spark)


def test_predictor_scores_alike_in_another_session(spark, tables, tmp_path):
    m, r = tables.metadata.where("dataset = 'train_dataset_1'"), tables.rearrangements.where("dataset = 'train_dataset_1'")
    fitted = RepertoirePredictor(learner=model.SparseLogistic(c_values=(0.1,), folds=2), max_features=20, candidates=40, gain_rounds=2, ks=(3,)).fit(r, m)
    before = {x.ID: x.label_positive_probability for x in fitted.predict_proba(r, m).collect()}
    bundle.save(fitted, str(tmp_path / "bundle"), spark)
    code = f"""
        import sys
        sys.path[:0] = {sys.path[:2]!r}
        from clonara.session import local_session
        from clonara.plans import bundle
        from clonara.sources.views import Tables
        spark = local_session("second", cores="2", partitions=2)
        t = Tables(spark, {SF!r})
        m, r = (x.where("dataset = 'train_dataset_1'") for x in (t.metadata, t.rearrangements))
        print("SCORES", {{x.ID: x.label_positive_probability for x in bundle.load(spark, {str(tmp_path / "bundle")!r}).predict_proba(r, m).collect()}})
    """
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=300)
    line, = [x for x in out.stdout.splitlines() if x.startswith("SCORES")]
    after = eval(line[7:])
    assert after.keys() == before.keys() and all(abs(after[k] - before[k]) < 1e-9 for k in before)
