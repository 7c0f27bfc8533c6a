"""Writing results, and the feature store that lets a broken run continue."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from clonara.constants import REP, SUBMISSION_COLUMNS
from clonara.operators.align import union_all
from clonara.session import materialize

SUBMISSION_SCHEMA = ("ID string, dataset string, label_positive_probability double, junction_aa string, v_call string, j_call string")


def save_table(df: DataFrame, path: str, sep: str = "\t", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("sep", sep).option("header", True).csv(path)


def save_repertoires(df: DataFrame, root: str) -> None:
    """Tab-separated files in one folder per repertoire.

    Rows are range-partitioned by repertoire and a hash of the row: files stay few, and a
    repertoire that holds a large part of all rows spreads over many tasks.
    """
    spread = F.xxhash64(*df.columns)
    (df.repartitionByRange(*REP, spread).write.partitionBy(*REP).option("sep", "\t").option("header", True)
     .option("extension", "tsv").csv(root))


def concat_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*_test_predictions.tsv`` then ``*_important_sequences.tsv`` as one table; none gives no rows."""
    parts = []
    for pattern in ("*_test_predictions.tsv", "*_important_sequences.tsv"):
        try:
            raw = spark.read.option("sep", "\t").option("header", True).schema(SUBMISSION_SCHEMA).csv(f"{folder}/{pattern}")
            parts.append(raw)
        except AnalysisException:
            continue
    if not parts:
        return spark.createDataFrame([], SUBMISSION_SCHEMA)
    return union_all(parts).select(*SUBMISSION_COLUMNS)


class FeatureStore:
    """Long features in batches, each a folder by dataset, read only once the manifest names it.

    A batch is written to a folder of its own, features and finished repertoires, and then committed by renaming an entry
    into the manifest folder, which happens as a whole or not at all. A run that stops before leaves a folder that no
    reader sees; its repertoires are still pending. An entry may replace datasets: what earlier batches hold of them is
    no longer read. Nothing that is stored is read or copied to add to it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _files(self):
        jvm = self.spark._jvm
        path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path, path().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def batches(self) -> list[tuple[str, list[str]]]:
        """(batch, datasets it replaces) of the committed batches in order of commitment; one entry per run."""
        path, fs = self._files()
        if not fs.exists(path("manifest")):
            return []
        entries = []
        for status in fs.listStatus(path("manifest")):
            name = status.getPath().getName()
            if name.startswith("."):
                continue
            with_entry = fs.open(status.getPath())
            try:
                entries.append((name, json.loads(with_entry.readUTF())))
            finally:
                with_entry.close()
        return sorted(entries)

    def stage(self, features: DataFrame, repertoires: DataFrame | None = None) -> str:
        """Write a batch that nobody reads yet; returns its name."""
        batch = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        (features.select(*REP, "feature", F.col("value").cast("double").alias("value")).write.partitionBy("dataset").parquet(f"{self.path}/features/batch={batch}"))
        if repertoires is not None:
            repertoires.select(*REP).write.parquet(f"{self.path}/done/batch={batch}")
        return batch

    def commit(self, batch: str, replaces: list[str] = ()) -> None:
        """Let readers see a staged batch."""
        path, fs = self._files()
        hidden, entry = path("manifest", f".{batch}"), path("manifest", batch)
        out = fs.create(hidden, True)
        try:
            out.writeUTF(json.dumps(sorted(replaces)))
        finally:
            out.close()
        if not fs.rename(hidden, entry):
            raise OSError(f"{batch} could not be committed")

    def discard_staged(self) -> list[str]:
        """Delete batches that were never committed; not to be called while another run writes."""
        path, fs = self._files()
        known, gone = {b for b, _ in self.batches()}, []
        for kind in ("features", "done"):
            if fs.exists(path(kind)):
                for status in fs.listStatus(path(kind)):
                    batch = status.getPath().getName().removeprefix("batch=")
                    if batch not in known:
                        fs.delete(status.getPath(), True)
                        gone.append(batch)
        return sorted(set(gone))

    def _read(self, kind: str, batches: list[str], schema: str) -> DataFrame:
        """Rows of the batches; those without any (Spark writes no folder by dataset for them) give none."""
        path, fs = self._files()
        folders = [f"{self.path}/{kind}/batch={b}" for b in batches if fs.exists(path(kind, f"batch={b}"))]
        if not folders:
            return self.spark.createDataFrame([], schema + ", batch string")
        return self.spark.read.option("basePath", f"{self.path}/{kind}").schema(schema + ", batch string").parquet(*folders)

    def read(self) -> DataFrame:
        batches = self.batches()
        rows = self._read("features", [b for b, _ in batches], "repertoire_id string, feature string, value double, dataset string")
        for i, (_, replaced) in enumerate(batches):
            if replaced and i:
                rows = rows.where(~(F.col("dataset").isin(replaced) & F.col("batch").isin([b for b, _ in batches[:i]])))
        return rows.select("dataset", "repertoire_id", "feature", "value")

    def append(self, features: DataFrame, repertoires: DataFrame | None = None) -> None:
        """Add features; ``repertoires`` are noted as finished with them, whether or not they have any."""
        self.commit(self.stage(features, repertoires))

    def write(self, features: DataFrame) -> None:
        """Replace the datasets that the features are of."""
        batch = self.stage(features)
        stored = self._read("features", [batch], "repertoire_id string, feature string, value double, dataset string")
        self.commit(batch, [r.dataset for r in stored.select("dataset").distinct().collect()])

    def done(self) -> DataFrame:
        """Finished repertoires; the features are not read."""
        return self._read("done", [b for b, _ in self.batches()], "dataset string, repertoire_id string").select(*REP).distinct()

    def pending(self, metadata: DataFrame) -> DataFrame:
        """Repertoires that are not finished."""
        return metadata.select(*REP).join(self.done(), REP, "left_anti")

    def fill(self, metadata: DataFrame, rows: DataFrame, extract) -> None:
        """Compute features of the pending repertoires only and add them as one batch; nothing pending, nothing written."""
        pending = materialize(self.pending(metadata), "pending")
        if pending.take(1):
            self.append(extract(rows.join(pending, REP, "left_semi")), pending)


def cached_table(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``; built and written on first use."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        build().write.parquet(path)
        return spark.read.parquet(path)


def feature_vocabulary(features: DataFrame, metadata: DataFrame, n: int | None = None) -> DataFrame:
    """Sorted names of the features, of all repertoires or the first ``n`` of each dataset."""
    from clonara.operators.sampling import first_repertoires, order_columns

    if n is None:
        return features.select("feature").distinct().orderBy("feature")
    first = first_repertoires(metadata.select(*REP, *order_columns(metadata)), n, by_label=False)
    return features.join(first, REP, "left_semi").select("feature").distinct().orderBy("feature")


def scan_embeddings(spark: SparkSession, path: str) -> DataFrame | None:
    """Embedding rows, or None when there are none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
