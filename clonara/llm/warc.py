"""WARC archives: written as whole-file gzip streams, normalised to one member per record, read back by offset.

``write_streams`` writes records as Spark text files under one gzip stream per file, as some crawlers leave them.
``normalise`` inflates every stream once, record by record, writes each record as a gzip member of its own and
returns the offsets as a sidecar table. ``read_records`` inflates members from those offsets in pieces of bounded
size, so a large archive is read by many tasks.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonara.llm.common import stage
from clonara.session import shared_path

END = "\r\n\r\n"
DATE = "2026-01-01T00:00:00Z"
#: Archive bytes that one task reads back at least.
PIECE_BYTES = 8 << 20
#: Rows of the table of repeated payloads up to which it is broadcast (some 60 bytes a row).
BROADCAST_ROWS = 500_000

INDEX = "page_id long, record_type string, payload_digest string, archive string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32 as WARC headers carry it: eight groups of five hex digits become four base-32 digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) with refers_to set where the payload stands under a larger page_id."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    small = rows.filter(F.octet_length("payload") >= least_bytes).select("page_id", "digest")
    repeated = stage(small.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1 and last is not null").select(F.col("digest").alias("_digest"), "last"), "payloads")
    other = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    joined = rows.join(other, rows["digest"] == other["_digest"], "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\x00-\x1F\x7F]+", " "), F.lit("\r\n")), F.lit(""))


def record_text(typed: DataFrame) -> DataFrame:
    """One column: the record of each row without the closing empty lines."""
    size = F.octet_length("payload")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.concat(http, "payload"))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return typed.withColumn("_block", block).select(F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"),
        _line("WARC-Record-ID", name(F.coalesce(F.col("page_id").cast("string"), F.lit("unknown")))),
        _line("WARC-Target-URI", F.col("url")), F.lit(f"WARC-Date: {DATE}\r\n"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("WARC-Refers-To", name(F.col("refers_to"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(F.lit("")),
        _line("X-Payload-Length", size),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("_block").cast("string"), F.lit(END),
        "_block").alias("value"))


def write_streams(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Every page as a record, many records to a gzip stream. Equal payloads of ``least_bytes`` or more are written
    once, under the largest page_id; others refer to it. A null html is an empty payload, a null url has no header."""
    (record_text(with_types(pages, least_bytes)).write.option("lineSep", END).option("compression", "gzip")
     .option("zlib.compress.level", "BEST_SPEED").text(path))


def _open(path: str):
    """(file system, path in it) for a Hadoop path."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def inflated(source) -> Iterator[bytes]:
    """Pieces of an inflated gzip file of one or more members."""
    inflate = zlib.decompressobj(31)
    while data := source.read(1 << 18):
        while data:
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            if piece := inflate.decompress(data):
                yield piece
            data = inflate.unused_data


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, whole record with its closing lines); one record is held at a time."""
    held = bytearray()

    def more(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while more(1):
        end = held.find(b"\r\n\r\n")
        while end < 0:
            if not more(len(held) + 1):
                raise ValueError("a record's header is cut off")
            end = held.find(b"\r\n\r\n")
        lines = held[:end].decode("utf-8").split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = end + 4 + int(headers["Content-Length"])
        if not more(size + 4) or held[size:size + 4] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield headers, bytes(held[end + 4:size]), bytes(held[:size + 4])
        del held[:size + 4]


def _page(name: str | None) -> int | None:
    tail = (name or "").removeprefix("<urn:page:").rstrip(">")
    return int(tail) if tail.lstrip("-").isdigit() else None


def normalise(spark: SparkSession, streams: str, path: str, level: int = 1) -> DataFrame:
    """Rewrite the archives in ``streams`` with one gzip member per record; returns the offset index.

    The index is written beside the archives as the folder ``index``. A task writes under a name of its own and
    renames, so a repeated or speculative task leaves the same file. Empty streams give no archive and no rows.
    """

    def run(batches):
        from pyarrow import fs as pafs  # noqa: F401

        for batch in batches:
            for source in batch["path"]:
                files, inner = _open(source)
                target = f"{path}/{os.path.basename(source)}"
                out_files, out_inner = _open(target)
                out_files.create_dir(os.path.dirname(out_inner), recursive=True)
                rows, offset, own = [], 0, f"{out_inner}.{uuid.uuid4().hex}"
                with files.open_input_stream(inner, compression=None) as stream, out_files.open_output_stream(own, compression=None) as out:
                    for headers, _, whole in records(inflated(stream)):
                        deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = deflate.compress(whole) + deflate.flush()
                        out.write(member)
                        rows.append((_page(headers.get("WARC-Record-ID")), headers["WARC-Type"],
                                     headers.get("WARC-Payload-Digest", "").removeprefix("sha1:"), target, offset, len(member)))
                        offset += len(member)
                        if len(rows) >= 20_000:
                            yield _index_rows(rows)
                            rows = []
                try:
                    out_files.move(own, out_inner)
                except OSError:  # another attempt was first, with the same bytes
                    out_files.delete_file(own)
                if rows:
                    yield _index_rows(rows)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(streams).select("path", "length")
    found = found.filter("length > 0").select("path").repartition(max(1, found.count()))
    found.mapInPandas(run, INDEX).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def _index_rows(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=["page_id", "record_type", "payload_digest", "archive", "offset", "length"])
    return pdf.astype({"page_id": "Int64"})


def read_records(index: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Every indexed record, read from its archive; a response's payload must have the digest of its header."""

    def run(batches):
        for batch in batches:
            for archive, start, stop in zip(batch["archive"], batch["start"], batch["stop"]):
                files, inner = _open(archive)
                rows, held = [], 0
                with files.open_input_file(inner) as file:
                    file.seek(start)
                    for headers, block, _ in records(inflated(_Limited(file, stop - start))):
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = block.split(b"\r\n\r\n", 1)[1] if kind == "response" else None
                        if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
                        size = int(headers["X-Payload-Length"]) if payload is None else len(payload)
                        rows.append((_page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), kind, digest, size, _page(headers.get("WARC-Refers-To")), payload))
                        held += len(block)
                        if held >= 1 << 24:
                            yield _record_rows(rows)
                            rows, held = [], 0
                if rows:
                    yield _record_rows(rows)

    piece = F.floor(F.col("offset") / piece_bytes)
    pieces = stage(index.groupBy("archive", piece.alias("piece")).agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop")), "pieces")
    return pieces.repartition(max(1, pieces.count()), "archive", "piece").mapInPandas(run, RECORDS)


class _Limited:
    """The next ``n`` bytes of a file."""

    def __init__(self, file, n: int):
        self.file, self.left = file, n

    def read(self, n: int) -> bytes:
        data = self.file.read(min(n, self.left))
        self.left -= len(data)
        return data


def _record_rows(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"])
    return pdf.astype({"page_id": "Int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages written as whole-file streams, normalised to single members and read back (columns of ``RECORDS``).

    One row per page row; repeated rows of the page that keeps a payload are all responses. Rows with a null page_id
    refer to the page that keeps their payload, or are responses if no page with an id has it. An empty table gives
    no rows. Other columns are not read. Control characters in a url become spaces.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_streams(pages, f"{path}/streams", least_bytes)
    return read_records(normalise(spark, f"{path}/streams", f"{path}/members"))
