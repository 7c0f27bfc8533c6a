"""Session defaults, and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "clonara", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only in local mode, where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="clonara-")
    return _fallback[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends.

    A result reads its stages lazily, so they cannot go before. A driver that is killed leaves them.
    """
    path = f"{shared_dir(spark)}/clonara/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(folder.getParent())
    system.deleteOnExit(folder)
    return path


def materialize(df: DataFrame, name: str = "stage", by: str | None = None, row_group_mb: int | None = None) -> DataFrame:
    """Write a stage as Parquet to the shared folder and read it back.

    Used where a result feeds several jobs (model fitting, folds): the lineage is cut
    and the stage survives the loss of executors. ``by`` names a column to partition on,
    so later reads of one value skip the rest. ``row_group_mb`` bounds what a task holds of wide rows before it writes.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.partitionBy(by) if by else df.write
    if row_group_mb:
        writer = writer.option("parquet.block.size", row_group_mb << 20)
    writer.parquet(path)
    return spark.read.parquet(path)
