"""Fit on a labelled dataset, score repertoires, rank the sequences behind the label."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from clonara.constants import MODEL_TOP_N, MODEL_TOP_N_DEFAULT, REP
from clonara.operators import align, clonotypes, model, ranking
from clonara.operators.fits import run_fits
from clonara.operators.reports import default_score
from clonara.plans.features import extract_features
from clonara.session import materialize


@dataclass
class RepertoirePredictor:
    """``learner`` needs ``fit(data)`` and ``predict(data)``; boosted trees by default.

    ``mine`` may be replaced in a subclass when the feature set reads another miner's columns.
    """

    learner: object = field(default_factory=model.BoostedEnsemble)
    max_features: int = 500
    candidates: int = 2000
    gain_rounds: int = 30
    max_files: int | None = None
    min_freq: float = 0.15
    enrichment: float = 5.0
    top_n: int | None = MODEL_TOP_N_DEFAULT
    widths: dict[int, int] | None = field(default_factory=lambda: dict(MODEL_TOP_N))
    ks: tuple[int, ...] = (3, 4)
    feature_set: str = "base"
    space: model.FeatureSpace | None = field(default=None, repr=False)
    mined: DataFrame | None = field(default=None, repr=False)
    gains: DataFrame | None = field(default=None, repr=False)
    rows: DataFrame | None = field(default=None, repr=False)
    metadata: DataFrame | None = field(default=None, repr=False)

    def mine(self, rows: DataFrame, metadata: DataFrame) -> DataFrame:
        return clonotypes.mine_enriched(rows, metadata, self.max_files, self.min_freq, self.enrichment, self.top_n, widths=self.widths)

    def fit(self, rows: DataFrame, metadata: DataFrame) -> "RepertoirePredictor":
        """Mine, extract and fit on the rows of one training dataset."""
        self.rows, self.metadata = rows, metadata
        self.mined = materialize(self.mine(rows, metadata), "mined")
        return self.fit_features(materialize(extract_features(rows, self.mined, metadata, self.ks, self.feature_set), "features"), metadata)

    def fit_features(self, features: DataFrame, metadata: DataFrame) -> "RepertoirePredictor":
        labels = metadata.select(*REP, "label_positive")
        wide = model.FeatureSpace.of(model.select_variance(features, labels, self.candidates))
        data = materialize(model.labelled(wide.vectors(features, labels)), "candidates")
        self.gains = materialize(model.select_gain(data, wide, self.max_features, self.gain_rounds), "gains")
        self.space = model.FeatureSpace.of(self.gains)
        fitted = model.with_class_weight(model.labelled(self.space.vectors(features, labels)))
        self.learner.fit(materialize(fitted, "training"))
        return self

    def predict_features(self, features: DataFrame, repertoires: DataFrame) -> DataFrame:
        """Output rows with a probability for every listed repertoire."""
        if self.space is None:
            raise ValueError("call fit first")
        scored = self.learner.predict(self.space.vectors(features, repertoires.select(*REP)))
        ids = repertoires.select(F.col("repertoire_id").alias("ID"), "dataset")
        out = default_score(ids, scored.select(F.col("repertoire_id").alias("ID"), "p"))
        return align.submission_rows(out, F.col("p"))

    def predict_proba(self, rows: DataFrame, repertoires: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
        """Score repertoires of any dataset with the sequences mined in training."""
        if self.mined is None:
            raise ValueError("call fit first")
        names = [r.dataset for r in repertoires.select("dataset").distinct().collect()]
        mined = self.mined.withColumn("dataset", F.explode(F.array(*[F.lit(n) for n in names])))
        return self.predict_features(extract_features(rows, mined, metadata, self.ks, self.feature_set), repertoires)

    def kmer_weights(self) -> DataFrame:
        """Gain of the selected k-mer features."""
        f = F.col("feature")
        return (self.gains.where(f.startswith("kmer_") & (F.col("gain") > 0))
                .select(F.split(f, "_")[1].cast("int").alias("k"), F.split(f, "_")[2].alias("kmer"), F.col("gain").alias("weight")))

    def identify_associated_sequences(self, k: int = 50000) -> DataFrame:
        """Exactly ``k`` ranked output rows for the training dataset."""
        return ranked_rows(self.rows, self.metadata, self.mined, self.kmer_weights(), k, self.max_files)


def ranked_rows(rows: DataFrame, metadata: DataFrame, mined: DataFrame, weights: DataFrame, k: int, files: int | None = None) -> DataFrame:
    ranked = ranking.rank_gain(rows, metadata, mined, weights, k, files)
    calls = ranking.vj_lookup(ranked, rows, metadata, files, files)
    return ranking.repair_sequences(ranking.sequence_rows(ranked, calls, metadata, k))


def run_all(rows: DataFrame, metadata: DataFrame, test_rows: DataFrame, test_repertoires: DataFrame, routes: DataFrame, make, k: int = 50000) -> DataFrame:
    """Fit every train dataset, score its test datasets, rank its sequences: one submission.

    ``routes`` holds (test, train); ``make()`` gives a fresh predictor. Mining, features and
    ranking run once over all datasets, as everything is keyed by dataset. The fits of the datasets run side by side.
    """
    needed = ["dataset", "repertoire_id", "junction_aa", "v_call", "j_call", "templates"]
    rows = materialize(rows.select(*needed, "row_order"), "rows", "dataset")
    test_rows = materialize(test_rows.select(*needed), "test_rows", "dataset")
    settings = make()
    mined = materialize(settings.mine(rows, metadata), "mined")
    known = routes.select("test", F.col("train").alias("dataset"))
    routed = mined.join(known, "dataset").drop("dataset").withColumnRenamed("test", "dataset")
    train_features = materialize(extract_features(rows, mined, metadata, settings.ks, settings.feature_set), "features", "dataset")
    test_features = materialize(extract_features(test_rows, routed, None, settings.ks, settings.feature_set), "test_features", "dataset")
    predictions, weights = [], []
    part = lambda table, name: table.where(F.col("dataset") == name)
    names = sorted(r.dataset for r in metadata.select("dataset").distinct().collect())
    fitted = run_fits(rows.sparkSession, {name: lambda name=name: make().fit_features(part(train_features, name), part(metadata, name)) for name in names}, width=4)
    pairs = [(r.test, r.train) for r in known.select("test", F.col("dataset").alias("train")).collect()]
    for name, predictor in fitted.items():
        weights.append(predictor.kmer_weights().withColumn("dataset", F.lit(name)))
        of = F.col("dataset").isin([t for t, train in pairs if train == name])
        predictions.append(predictor.predict_features(test_features.where(of), test_repertoires.where(of)))
    sequences = ranked_rows(rows, metadata, mined, align.union_all(weights), k, settings.max_files)
    return align.build_submission(align.union_all(predictions), sequences)
