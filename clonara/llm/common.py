"""Pieces that several text operators share: word windows as 64-bit hashes, batches and stage tables."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonara.session import materialize

#: Words of letters and digits, as used on lower-cased text.
LETTERS_DIGITS = re.compile(r"[^\W_]+")

#: Stands for a null document id inside keys; ids are never this small.
NO_ID = -(2**63)

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2**64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Megabytes of texts that a writing task gathers before it writes them.
ROW_GROUP_MB = 16


def stage(df: DataFrame, name: str) -> DataFrame:
    """A result that several jobs read, as a table in the shared folder."""
    return materialize(df, name, row_group_mb=ROW_GROUP_MB)


def known_id(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


class WordHashes(dict):
    """Hash of each word, remembered; forgets all when it holds too many words."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring word hashes, by differences of a running sum."""
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * down[: n - width + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width`` values; width is a power of two."""
    step = 1
    while step < width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return x


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary array whose item i holds the bytes of values[cuts[i]:cuts[i + 1]]."""
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def chunks_of_groups(batches, keys: list[str], rows: int):
    """Sorted record batches, joined and cut so that no group of equal keys is divided.

    A group that is larger than ``rows`` comes whole; callers bound their groups beforehand.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(whole.num_rows, bool)
        for k in keys:
            v = whole[k].to_numpy()
            same &= v == v[-1]
        cut = whole.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield whole.slice(0, cut)
        held = whole.slice(cut).combine_chunks().to_batches()
        n = whole.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
