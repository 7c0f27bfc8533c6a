"""Benchmark decontamination: short test items found inside long documents.

Items are split by size: class c holds items of more than 2**(c-1) and at most 2**c distinct shingles. An item is
represented by its smallest shingle hashes (a bottom-k MinHash sketch). k follows from the largest size of the class:
a document that holds a share ``threshold`` of an item's n shingles misses at most (1 - threshold) * n of them, so one
of any (1 - threshold) * 2**c + 1 is in the document. The sketch lookup therefore loses no pair, where banded MinHash
would at the tiny resemblance of a short item and a long document. Candidates are verified on the shingles' words.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonara.llm.common import LETTERS_DIGITS, WordHashes, window_hashes

#: Bytes of item text that are shipped to the tasks at once; a larger benchmark is searched in blocks.
BLOCK_BYTES = 8_000_000
#: Words of documents that are searched at once.
CHUNK_WORDS = 1_000_000

SCHEMA = "doc_id long, item_id long, n_shingles int, n_shared int, containment double"


def words_of(text: str | None) -> list[str]:
    return LETTERS_DIGITS.findall(text.lower()) if text else []


def shingles_of(words: list[str], width: int) -> list[str]:
    """Distinct shingles in order; an item of fewer words is one shingle."""
    w = min(width, len(words))
    return list(dict.fromkeys(" ".join(words[i:i + w]) for i in range(len(words) - w + 1))) if w else []


def sketch_size(n: int, threshold: float) -> int:
    upper = 1 << max(0, math.ceil(math.log2(n)))
    return min(n, math.floor((1 - threshold) * upper + 1e-9) + 1)


class SketchIndex:
    """Sketches of a block of items by shingle width: sorted hashes and the items that have them."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float, width: int):
        self.ids, self.shingles, self.hashes, self.threshold = [], [], [], threshold
        found: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        cache = WordHashes()
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            w = min(width, len(words))
            hashes = np.unique(window_hashes(cache.array(words), w))
            for h in hashes[:sketch_size(len(hashes), threshold)].tolist():
                found[w][h].append(len(self.ids))
            self.ids.append(item_id)
            self.shingles.append(frozenset(shingles_of(words, width)))
            self.hashes.append(hashes)
        self.widths = {}
        for w, by_hash in found.items():
            order = sorted(by_hash)
            keys = np.array(order, np.uint64)
            seen = np.zeros(1 << 16, bool)
            seen[(keys >> np.uint64(48)).astype(np.int64)] = True
            self.widths[w] = (keys, seen, [by_hash[h] for h in order])

    def search(self, words: list[str], hashes: np.ndarray, starts: np.ndarray):
        """(document index, item index, shared shingles) for the documents between ``starts``."""
        for w, (keys, seen, owners) in self.widths.items():
            windows = window_hashes(hashes, w)
            at = np.flatnonzero(seen[(windows >> np.uint64(48)).astype(np.int64)])
            where = np.minimum(np.searchsorted(keys, windows[at]), len(keys) - 1)
            hit = keys[where] == windows[at]
            at, where = at[hit], where[hit]
            doc = np.searchsorted(starts, at, side="right") - 1
            inside = at + w <= starts[doc + 1]
            pairs = {(d, i) for d, k in zip(doc[inside].tolist(), where[inside].tolist()) for i in owners[k]}
            for d, i in sorted(pairs):
                a, b = int(starts[d]), int(starts[d + 1])
                near = a + np.flatnonzero(np.isin(windows[a:b - w + 1], self.hashes[i]))
                shared = self.shingles[i] & {" ".join(words[p:p + w]) for p in near.tolist()}
                if len(shared) >= self.threshold * len(self.shingles[i]) - 1e-9:
                    yield d, i, len(shared)


def _search_block(docs: DataFrame, items: list[tuple[int, str | None]], threshold: float, width: int) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(SketchIndex(items, threshold, width))

    def run(batches):
        block, cache = index.value, WordHashes()

        def flush(ids, words, starts):
            rows = [(ids[d], block.ids[i], len(block.shingles[i]), n, n / len(block.shingles[i]))
                    for d, i, n in block.search(words, cache.array(words), np.array(starts, np.int64))]
            names = ["doc_id", "item_id", "n_shingles", "n_shared", "containment"]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

        ids, words, starts = [], [], [0]
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                words += words_of(text.as_py())
                starts.append(len(words))
                if len(words) >= CHUNK_WORDS:
                    yield flush(ids, words, starts)
                    ids, words, starts = [], [], [0]
        if ids:
            yield flush(ids, words, starts)

    return docs.mapInArrow(run, SCHEMA)


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """Pairs (document, item) where the document holds at least ``threshold`` of the item's distinct shingles.

    Words are runs of letters and digits of the lower-cased text. An item of fewer than ``width`` words is one
    shingle, looked for as that run of words. Items without words (null or empty text) match nothing; documents
    without words hold nothing. Repeated rows of either table give repeated pairs; null ids stay null. Other columns
    are not read. The result has one row per pair and no order.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    found = None
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        part = _search_block(docs, [(r.item_id, r.text) for r in rows], threshold, width)
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaked(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """Documents that hold no item, all columns kept; documents with a null id are matched as one document."""
    leaked = find_leaks(docs, items, threshold, width).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(leaked, docs["doc_id"].cast("long").eqNullSafe(leaked["_leaked"]), "left_anti")
