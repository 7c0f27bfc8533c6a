"""Pick up repertoire files that arrived since the last run.

The counterpart of the store's resume: a file source with a checkpoint reads each new
file once, and stops when all are in.
"""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from clonara.functions.text import coerce_templates, missing_to_null
from clonara.sources.repertoires import _dataset_of, _repertoire_of, header_line, parsed_lines


def ingest_new(spark: SparkSession, source: str, columns: list[str], target: str, checkpoint: str) -> None:
    """Append rows of new ``*.tsv`` files with the given header order to a Parquet table by dataset."""
    lines = spark.readStream.option("pathGlobFilter", "*.tsv").option("recursiveFileLookup", "true").text(source)
    path = F.col("_metadata.file_path")
    raw = parsed_lines(lines.where(~header_line(F.col("value"))), columns, _dataset_of(path).alias("_dataset"), _repertoire_of(path).alias("_repertoire"))
    text = [missing_to_null(c).alias(c) for c in ("junction_aa", "v_call", "j_call") if c in columns]
    templates = coerce_templates("templates") if "templates" in columns else F.lit(1.0)
    rows = raw.select(F.col("_dataset").alias("dataset"), F.col("_repertoire").alias("repertoire_id"), *text, templates.alias("templates"))
    query = (rows.writeStream.format("parquet").partitionBy("dataset").option("path", target)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
