"""Reading datasets of repertoire files.

A dataset is a folder of tab-separated repertoires and an optional ``metadata.csv``. A
repertoire is one file ``<id>.tsv`` or, when Spark wrote it, a folder ``repertoire_id=<id>``.
Files split into tasks by size, so one huge repertoire is read by many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clonara.constants import REP
from clonara.functions.text import coerce_templates, dataset_id, missing_to_null
from clonara.operators.align import union_all

# Columns read from a repertoire file, and other names they go by.
WANTED = ["junction_aa", "v_call", "j_call", "d_call", "templates"]
ALIASES = {"cdr3_aa": "junction_aa", "duplicate_count": "templates"}
METADATA_SCHEMA = "repertoire_id string, filename string, label_positive boolean"


def _dataset_of(path: Column) -> Column:
    return F.regexp_extract(path, r"/(?:dataset=)?([^/=]+)/(?:repertoire_id=[^/]+/)?[^/]+$", 1)


def _repertoire_of(path: Column) -> Column:
    folder = F.regexp_extract(path, r"/repertoire_id=([^/]+)/[^/]+$", 1)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.(tsv|csv|txt)$", "")
    return F.coalesce(F.nullif(folder, F.lit("")), stem)


def list_files(spark: SparkSession, root: str, pattern: str = "*.tsv") -> DataFrame:
    """Repertoire files under a root: dataset, repertoire id, file name, bytes. Contents stay unread."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
             .load(root).select("path", "length"))
    return files.select(_dataset_of(F.col("path")).alias("dataset"), _repertoire_of(F.col("path")).alias("repertoire_id"),
                        F.concat(_repertoire_of(F.col("path")), F.lit(".tsv")).alias("filename"), F.col("length").alias("bytes"))


def list_datasets(files: DataFrame) -> DataFrame:
    """Names of visible datasets in order."""
    return files.where(~F.col("dataset").startswith(".")).select("dataset").distinct().orderBy("dataset")


def dataset_numbers(names: DataFrame) -> DataFrame:
    return names.withColumn("dataset_id", dataset_id("dataset"))


def dataset_pairs(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train datasets with the test datasets of the same number."""
    a = train.select(F.col("dataset").alias("train"), dataset_id("dataset").alias("dataset_id"))
    b = test.select(F.col("dataset").alias("test"), dataset_id("dataset").alias("dataset_id"))
    return a.join(b, "dataset_id", "left").groupBy("train", "dataset_id").agg(F.sort_array(F.collect_set("test")).alias("tests"))


def route_tests(train: DataFrame, test: DataFrame, fallback: str | None = "first") -> DataFrame:
    """The train dataset that scores each test dataset.

    ``fallback`` names the one for unknown numbers; ``first`` takes the first train
    dataset, None leaves them out.
    """
    a = train.select(F.col("dataset").alias("train"), dataset_id("dataset").alias("dataset_id")).distinct()
    b = test.select(F.col("dataset").alias("test"), dataset_id("dataset").alias("dataset_id")).distinct()
    out = b.join(a, "dataset_id", "left" if fallback else "inner")
    if fallback:
        other = train.agg(F.min("dataset")).scalar() if fallback == "first" else F.lit(fallback)
        out = out.withColumn("train", F.coalesce("train", other))
    return out.select("test", "dataset_id", "train")


def fold_routing(test: DataFrame, folds: DataFrame) -> DataFrame:
    """Each test dataset with the fold whose model never saw its own dataset."""
    return test.select("dataset", dataset_id("dataset").alias("fold_id")).join(folds.select("fold_id", "model"), "fold_id", "left")


def header_line(line: Column) -> Column:
    """A line that names the sequence column is a header, not data."""
    names = F.split(F.replace(line, F.lit('"'), F.lit("")), "\t")
    # quotes may stand inside a name, so only a part of it is looked for before a line is split
    likely = F.contains(line, F.lit("aa")) | F.contains(line, F.lit('"'))
    return likely & (F.array_contains(names, "junction_aa") | F.array_contains(names, "cdr3_aa"))


def parsed_lines(lines: DataFrame, columns: list[str], *keep: Column) -> DataFrame:
    """Fields of tab-separated lines as text columns.

    Lines are parsed as text because the CSV source skips a line of empty fields, and such
    a row still counts in gene and clone-size shares. Blank lines are skipped.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = lines.where(F.length("value") > 0).select(F.from_csv("value", F.lit(schema), {"sep": "\t"}).alias("_f"), *keep)
    return rows.select(*[F.col(f"_f.`{c}`").alias(c) for c in columns], *[k for k in rows.columns if k != "_f"])


def _lines(spark: SparkSession, paths) -> DataFrame | None:
    try:
        return spark.read.option("pathGlobFilter", "*.tsv").option("recursiveFileLookup", "true").text(paths)
    except AnalysisException:
        return None


def file_headers(spark: SparkSession, root: str, datasets: list[str] | None = None, lines: DataFrame | None = None) -> DataFrame:
    """(path, dataset, repertoire_id, header) of every repertoire file; header is null where no line names the sequence column.

    A file written in several parts may repeat its header; the parts are files of their own here. ``lines`` are those of
    the root where they are at hand.
    """
    path = F.col("_metadata.file_path")
    lines = _lines(spark, root) if lines is None else lines
    if lines is None:
        return spark.createDataFrame([], "path string, dataset string, repertoire_id string, header string")
    found = lines.select(path.alias("path"), F.when(header_line(F.col("value")), F.col("value")).alias("header"))
    found = found.groupBy("path").agg(F.min("header").alias("header"))
    found = found.select("path", _dataset_of(F.col("path")).alias("dataset"), _repertoire_of(F.col("path")).alias("repertoire_id"), "header")
    return found if datasets is None else found.where(F.col("dataset").isin(list(datasets)))


def unreadable_files(spark: SparkSession, root: str) -> DataFrame:
    """Files that give no rows because no line of theirs names the sequence column.

    Spark lists no files of zero bytes; ``missing_files`` finds those by the metadata.
    """
    readable = file_headers(spark, root).where(F.col("header").isNotNull()).select(*REP).distinct()
    return list_files(spark, root).select(*REP, "filename", "bytes").join(readable, REP, "left_anti")


def _read_form(lines: DataFrame, header: str) -> DataFrame:
    """Rows of files that all have one header."""
    columns = [c.strip('"') for c in header.split("\t")]
    path = F.col("_metadata.file_path")
    data = lines.where(F.col("value") != header)
    raw = parsed_lines(data, columns, _dataset_of(path).alias("_dataset"), _repertoire_of(path).alias("_repertoire"))
    names = {ALIASES.get(c, c): c for c in columns}
    given = {w: missing_to_null(names[w]) for w in WANTED if w in names}
    text = lambda w: given.get(w, F.lit("")).alias(w)
    templates = coerce_templates(given["templates"]) if "templates" in given else F.lit(1.0)
    extra = [given["d_call"].alias("d_call")] if "d_call" in given else []
    return raw.select(F.col("_dataset").alias("dataset"), F.col("_repertoire").alias("repertoire_id"), text("junction_aa"),
                      text("v_call"), text("j_call"), *extra, templates.alias("templates"))


def scan_repertoires(spark: SparkSession, root: str, datasets: list[str] | None = None) -> DataFrame:
    """Rows of all repertoires of the datasets; columns that a file lacks are back-filled.

    Headers are found file by file in one job. The files of the most common header are then read as they were listed for
    that, without the few others; each other header is one read over its files. A file without a header gives no rows;
    ``unreadable_files`` lists those. Paths and headers, one row per file, come to the driver, which lists the files in
    any case.
    """
    lines = _lines(spark, root)
    forms: dict[str | None, list[str]] = {}
    if lines is not None:
        for r in file_headers(spark, root, datasets, lines).where(~F.col("dataset").startswith(".")).collect():
            forms.setdefault(r.header, []).append(r.path)
    headers = sorted(h for h in forms if h is not None)
    if not headers:
        return spark.createDataFrame([], "dataset string, repertoire_id string, junction_aa string, v_call string, j_call string, templates double")
    common = max(headers, key=lambda h: len(forms[h]))
    path = F.col("_metadata.file_path")
    listed = lines.where(~_dataset_of(path).startswith("."))
    if datasets is not None:
        listed = listed.where(_dataset_of(path).isin(list(datasets)))
    others = [(p,) for h, paths in forms.items() if h != common for p in paths]
    if others:
        listed = listed.join(F.broadcast(spark.createDataFrame(others, "_other string")), path == F.col("_other"), "left_anti")
    read = lambda h: listed if h == common else _lines(spark, sorted(map(unquote, forms[h])))
    return union_all([_read_form(read(h), h) for h in headers])


def scan_sequences(spark: SparkSession, path: str) -> DataFrame:
    """One table by file suffix: comma for ``.csv``, tab for ``.tsv`` and ``.txt``."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1]
    separators = {"csv": ",", "tsv": "\t", "txt": "\t"}
    if suffix not in separators:
        raise ValueError(f"unsupported sequence file: {path}")
    return spark.read.option("sep", separators[suffix]).option("header", True).csv(path)


def in_file_order(scan: DataFrame) -> DataFrame:
    """Rows of a file scan with ``file_order``, their place from 0 by file name and line, also where files are split.

    Rows of a split come in order within their task; what the earlier splits and files hold is added. That list has a row
    per split.
    """
    place = scan.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    splits = place.groupBy("_path", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select("_path", "_block", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return place.join(starts, ["_path", "_block"]).withColumn("file_order", F.col("_at") + F.col("_shift")).drop("_path", "_block", "_at", "_shift")


def scan_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata with a boolean label, a numeric age and ``file_order``; a missing file gives no rows."""
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException:
        return spark.createDataFrame([], METADATA_SCHEMA + ", file_order long")
    columns = []
    for c in raw.columns:
        value = missing_to_null(F.col(f"`{c}`"))
        if c == "label_positive":
            value = F.lower(F.trim(value)).isin("true", "1", "1.0")
        elif c == "age":
            value = value.try_cast("double")
        columns.append(value.alias(c))
    return in_file_order(raw).select(*columns, "file_order")


@dataclass
class RepertoireData:
    """Metadata and sequence rows of one dataset."""

    metadata: DataFrame
    sequences: DataFrame


def load_dataset(spark: SparkSession, root: str, dataset: str) -> RepertoireData:
    metadata = scan_metadata(spark, f"{root}/{dataset}/metadata.csv").withColumn("dataset", F.lit(dataset))
    return RepertoireData(metadata, scan_repertoires(spark, root, [dataset]))


def labelled_rows(rows: DataFrame, metadata: DataFrame | None) -> DataFrame:
    """Rows with ``ID`` and label by file name; without metadata the file stem is the id."""
    if metadata is None:
        return rows.withColumn("ID", F.col("repertoire_id"))
    m = metadata.select("dataset", F.col("repertoire_id").alias("ID"), F.regexp_replace("filename", r"\.tsv$", "").alias("repertoire_id"),
                        "label_positive")
    return rows.drop("label_positive").join(m, REP)


def missing_files(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """Repertoires named in the metadata that have no file."""
    return metadata.select(*REP, "filename").join(files.select("dataset", "filename").distinct(), ["dataset", "filename"], "left_anti")


def completeness(metadata: DataFrame, files: DataFrame, datasets: DataFrame) -> DataFrame:
    """Files and metadata rows per dataset; a dataset needs both."""
    f = files.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_files"))
    m = metadata.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_metadata"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = datasets.select("dataset").join(f, "dataset", "left").join(m, "dataset", "left").select("dataset", zero("n_files"), zero("n_metadata"))
    return out.withColumn("complete", (F.col("n_files") > 0) & (F.col("n_metadata") > 0))
