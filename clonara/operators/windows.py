"""Windows of sequences counted where a repertoire's rows lie together.

The rows of a group meet once, as a list; windows are counted from the letters' codes in Arrow batches, so no window is
shuffled, sorted or held by Spark. Groups with more than ``GROUP_ROWS`` rows are left to their callers, which spread them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from clonara.constants import AMINO_ACIDS

#: Rows of a group that may meet in one task.
GROUP_ROWS = 200_000
#: Letters that are counted at once, unless one group has more.
BLOCK_LETTERS = 1_000_000

# what a window must be to match STRICT as Java reads it: its $ also stands before a last line end
_STRICT = re.compile(f"[{AMINO_ACIDS}]+(?:\r\n|[\n\r\u0085\u2028\u2029])?")


def split_by_size(df: DataFrame, keys: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of ordinary groups, and those of groups above ``GROUP_ROWS``; None for none of them.

    Groups are counted first. Large ones are few: at most one for each ``GROUP_ROWS`` rows of the table.
    """
    if not keys:
        return None, df
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GROUP_ROWS).drop("_n").collect()
    if not large:
        return df, None
    schema = StructType([StructField(f"_{i}", df.schema[c].dataType) for i, c in enumerate(keys)])
    listed = F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in large], schema))
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(keys)])
    return df.join(listed, same, "left_anti"), df.join(listed, same, "left_semi")


def _grouped(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per group: an array of its rows' sequences."""
    return df.groupBy(*keys).agg(F.collect_list(seq).alias("_seqs"))


def _of(df: DataFrame, keys: list[str], *columns: tuple[str, object]) -> StructType:
    return StructType([df.schema[c] for c in keys] + [StructField(n, t) for n, t in columns])


# ---- letters and windows of a block --------------------------------------------------


class _Block:
    """Some groups of a batch: their letters one behind another, where sequences begin and whose they are."""

    def __init__(self, seqs: pa.ListArray, first: int, last: int):
        lists = seqs.slice(first, last - first)
        self.sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        width = np.int64 if pa.types.is_large_string(flat.type) else np.int32
        at = np.frombuffer(flat.buffers()[1], width)[flat.offset:flat.offset + len(flat) + 1].astype(np.int64) if len(flat) else np.zeros(1, np.int64)
        data = np.frombuffer(flat.buffers()[2], np.uint8)[at[0]:at[-1]] if len(flat) and flat.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        if len(data) and data.max() >= 0x80:
            before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            data, at = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), before[at]
        self.lengths = np.diff(at)
        self.group = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.letters, self.starts = data, at[:-1]
        used = np.flatnonzero(np.bincount(data)) if len(data) else np.zeros(0, np.int64)
        self.alphabet = max(len(used), 1)
        place = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.int64)
        place[used] = np.arange(len(used))
        self.codes = place[data]
        self.row = np.repeat(np.arange(len(self.lengths)), self.lengths)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of every window, number of its k-mer, a place of every k-mer); k-mers are numbered in their order."""
        left = np.repeat(self.starts + self.lengths, self.lengths) - np.arange(len(self.letters))
        begin = np.flatnonzero(left >= k)
        code, most = self.codes[begin], self.alphabet
        for j in range(1, k):
            if most * self.alphabet >= 2**62:
                known, code = np.unique(code, return_inverse=True)
                most = len(known)
            code = code * self.alphabet + self.codes[begin + j]
            most *= self.alphabet
        if most <= 4_000_000:  # numbered without sorting
            seen = np.zeros(most, np.int64)
            seen[code] = begin + 1
            found = np.flatnonzero(seen)
            number = np.zeros(most, np.int32)
            number[found] = np.arange(len(found), dtype=np.int32)
            return self.row[begin], number[code].astype(np.int64), seen[found] - 1
        _, place, code = np.unique(code, return_index=True, return_inverse=True)
        return self.row[begin], code, begin[place]

    def names(self, places: np.ndarray, k: int) -> pa.Array:
        """The k-mers that begin at the places."""
        if self.letters.dtype == np.uint8:
            letters = self.letters[places[:, None] + np.arange(k)]
            offsets = np.arange(len(places) + 1, dtype=np.int32) * k
            return pa.StringArray.from_buffers(len(places), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters)))
        return pa.array([self.letters[p:p + k].tobytes().decode("utf-32-le") for p in places], pa.string())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, _Block]]:
    for batch in batches:
        seqs = batch.column(batch.num_columns - 1)
        if not batch.num_rows:
            continue
        offsets = seqs.offsets.to_numpy()
        values = seqs.values
        width = np.int64 if pa.types.is_large_string(values.type) else np.int32
        at = np.frombuffer(values.buffers()[1], width)[values.offset:values.offset + len(values) + 1] if len(values) else np.zeros(1, width)
        ends = at[offsets[1:]].astype(np.int64) - int(at[offsets[0]])
        first = 0
        while first < batch.num_rows:
            done = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + BLOCK_LETTERS, "right")))
            yield batch, first, _Block(seqs, first, last)
            first = last


def _pairs(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of numbers in order with how often they come; ``b`` is below ``width``."""
    joined = np.sort(a * width + b)
    first = np.flatnonzero(np.concatenate([[True], joined[1:] != joined[:-1]])) if len(joined) else np.zeros(0, np.int64)
    one = joined[first]
    return one // width, one % width, np.diff(np.append(first, len(joined)))


def _strict(names: pa.Array) -> np.ndarray:
    return np.fromiter((_STRICT.fullmatch(n) is not None for n in names.to_pylist()), bool, len(names))


def _keys(batch: pa.RecordBatch, first: int, groups: np.ndarray) -> list[pa.Array]:
    at = pa.array(groups + first)
    return [batch.column(i).take(at) for i in range(batch.num_columns - 1)]


# ---- operators -----------------------------------------------------------------------


def counted(df: DataFrame, keys: list[str], ks: list[int], valid_only: bool = False, once_per_row: bool = False, seq: str = "junction_aa") -> DataFrame:
    """(keys, k, kmer, count, _total): windows of each group's rows, or rows with the window; ``_total`` is the sum for the length."""

    def count(batches):
        for batch, first, block in _blocks(batches):
            for k in ks:
                row, code, places = block.windows(k)
                if not len(places):
                    continue
                if once_per_row:
                    row, code, _ = _pairs(row, code, len(places))
                group, code, n = _pairs(block.group[row], code, len(places))
                names = block.names(places, k)
                if valid_only:
                    kept = _strict(names)[code]
                    group, code, n = group[kept], code[kept], n[kept]
                total = np.bincount(group, n, len(block.sizes)).astype(np.int64)[group]
                yield pa.RecordBatch.from_arrays(
                    [*_keys(batch, first, group), pa.array(np.full(len(n), k, np.int32)), names.take(pa.array(code)), pa.array(n.astype(np.int64)), pa.array(total)],
                    names=[*keys, "k", "kmer", "count", "_total"])

    lists = _grouped(df, keys, seq)
    return lists.mapInArrow(count, _of(df, keys, ("k", IntegerType()), ("kmer", StringType()), ("count", LongType()), ("_total", LongType())))


def hashed_sums(df: DataFrame, keys: list[str], ks: list[int], buckets: int, seq: str = "junction_aa") -> DataFrame:
    """(keys, k, bucket, s, ss, max, n_seqs): sums over a group's rows of the share of a row's windows in each bucket.

    Only windows of the standard letters fall in a bucket; the share is that of all windows of the row.
    """

    def add(batches):
        for batch, first, block in _blocks(batches):
            for k in ks:
                row, code, places = block.windows(k)
                if not len(places):
                    continue
                names = block.names(places, k)
                bucket = np.fromiter((zlib.crc32(n.encode()) % buckets for n in names.to_pylist()), np.int64, len(names))
                kept = _strict(names)[code]
                row, bucket, n = _pairs(row[kept], bucket[code[kept]], buckets)
                x = n / np.maximum(block.lengths[row] - k + 1, 1)
                at = block.group[row] * buckets + bucket
                order = np.argsort(at, kind="stable")
                at, x = at[order], x[order]
                if not len(at):
                    continue
                start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                group, bucket = at[start] // buckets, at[start] % buckets
                yield pa.RecordBatch.from_arrays(
                    [*_keys(batch, first, group), pa.array(np.full(len(start), k, np.int32)), pa.array(bucket), pa.array(np.add.reduceat(x, start)),
                     pa.array(np.add.reduceat(x * x, start)), pa.array(np.maximum.reduceat(x, start)), pa.array(block.sizes[group].astype(np.int64))],
                    names=[*keys, "k", "bucket", "s", "ss", "max", "n_seqs"])

    sums = (("k", IntegerType()), ("bucket", LongType()), ("s", DoubleType()), ("ss", DoubleType()), ("max", DoubleType()), ("n_seqs", LongType()))
    return _grouped(df, keys, seq).mapInArrow(add, _of(df, keys, *sums))
