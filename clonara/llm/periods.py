"""Runs of periodic words in texts, by Lyndon arrays from a suffix sorter's grouping phase.

A run is a stretch that keeps its smallest period and cannot be extended. For one of the two orders (an order of the
words and its reverse) the longest Lyndon word at a place in the run's first period is a root of the run, so all runs
are found among the longest Lyndon words at every place under both orders, extended to both sides as far as words one
period apart are equal.

The Lyndon words come from grouping alone, without sorting suffixes. Suffixes are grouped by first word; groups are
taken from the highest down; each of their suffixes points to the nearest one to its left in a lower group, and the
suffixes pointed at leave their group for a new one above it, the higher the more pointers they have. The common prefix
of a group, when its turn comes, is the longest Lyndon word at each of its places.

Only stretches whose word sequences all occur twice in the text can hold a run, and only those are grouped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonara.llm.common import WordHashes, window_hashes

MIN_WORDS = 24
EXPONENT = 3
#: Rows of a result batch.
_ROWS = 512

RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def lyndon_lengths(ranks: list[int], k: int) -> list[int]:
    """Length of the longest Lyndon word at every place of a sequence of ranks 0 to k - 1, all of them in use."""
    n = len(ranks)
    group = ranks.copy()
    members: list[list[int]] = [[] for _ in range(k)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    below, above = list(range(-1, k - 1)), [*range(1, k), -1]
    width = [1] * k
    lengths = [0] * n
    #: Nearest place at or left of a place whose group has not had its turn, as place + 1; zero is none.
    left = list(range(n + 1))
    g = k - 1
    while g >= 0:
        w = width[g]
        turn = [i for i in members[g] if group[i] == g]
        members[g] = []
        for i in turn:
            lengths[i] = w
            left[i + 1] = i
        pointers: dict[int, int] = {}
        for i in turn:
            j = i
            while left[j] != j:
                j = left[j]
            while left[i] != j and i != j:
                left[i], i = j, left[i]
            if j:
                pointers[j - 1] = pointers.get(j - 1, 0) + 1
        leaving: dict[tuple[int, int], list[int]] = {}
        for j, times in pointers.items():
            leaving.setdefault((group[j], -times), []).append(j)
        for old, times in sorted(leaving):
            new, places = len(width), leaving[old, times]
            width.append(width[old] - times * w)
            members.append(places)
            for j in places:
                group[j] = new
            up = above[old]
            above[old] = new
            below.append(old)
            above.append(up)
            if up >= 0:
                below[up] = new
        g = below[g]
    return lengths


def _equal_from(codes: np.ndarray, i: int, p: int) -> int:
    """How many places from i on hold the word p places later."""
    n, done, step = len(codes) - p, 0, 64
    while i + done < n:
        size = min(step, n - i - done)
        same = codes[i + done:i + done + size] == codes[i + done + p:i + done + p + size]
        if not same.all():
            return done + int(np.argmin(same))
        done += size
        step *= 2
    return done


def _equal_before(codes: np.ndarray, i: int, p: int) -> int:
    """How many places left of i hold the word p places later."""
    done, step = 0, 64
    while i - done > 0:
        size = min(step, i - done)
        same = (codes[i - done - size:i - done] == codes[i - done - size + p:i - done + p])[::-1]
        if not same.all():
            return done + int(np.argmin(same))
        done += size
        step *= 2
    return done


def _runs_of_codes(codes: np.ndarray, k: int, min_words: int, exponent: int) -> set[tuple[int, int, int]]:
    found: set[tuple[int, int, int]] = set()
    shared = min_words - 2 * min_words // exponent
    for ranks in (codes, k - 1 - codes):
        period = np.array(lyndon_lengths(ranks.tolist(), k), np.int64)
        # in a run's first period the root is followed by more than exponent - 2 periods and by ``shared`` words
        at = np.flatnonzero(np.arange(len(codes)) + period + np.maximum(shared, (exponent - 2) * period) <= len(codes))
        for d in range(shared):
            at = at[codes[at + d] == codes[at + period[at] + d]]
        at = at[np.lexsort((at, period[at]))]
        last, end = 0, 0
        for i, p in zip(at.tolist(), period[at].tolist()):
            if p == last and i < end - p:
                continue  # within the run that was just extended
            start = i - _equal_before(codes, i, p)
            last, end = p, i + p + _equal_from(codes, i, p)
            if end - start >= max(min_words, exponent * p):
                found.add((start, end - start, p))
    return found


def find_runs(words: list[bytes], hashes: np.ndarray, min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``min_words`` words and ``exponent`` (3 or more) periods, by start, then period.

    ``hashes`` are of the words; equal hashes of different words cost time only.
    """
    if exponent < 3 or min_words < exponent:
        raise ValueError("runs of three periods and as many words or more")
    if len(words) < min_words:
        return []
    width = min_words // exponent
    grams = window_hashes(hashes, width)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(len(grams) + 2, bool)
    twice[order[1:][same] + 1] = True
    twice[order[:-1][same] + 1] = True
    edges = np.flatnonzero(twice[1:] != twice[:-1])
    out: list[tuple[int, int, int]] = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        part = words[a:b + width - 1]
        if len(part) < min_words:
            continue
        ranks = {w: r for r, w in enumerate(sorted(set(part)))}
        codes = np.fromiter(map(ranks.__getitem__, part), np.int64, len(part))
        out.extend((a + s, n, p) for s, n, p in _runs_of_codes(codes, len(ranks), min_words, exponent))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run contains after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def collapse_runs(docs: DataFrame, min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """Per row: doc_id, runs (array of start, length, period by start, then period) and collapsed, the text of the kept words.

    Words are separated by spaces and the controls 9 to 13, and numbered from 0. A word is dropped if a run contains it
    after the run's first period; kept words are joined by one space. Null and wordless texts have no runs and an empty
    collapsed text. Repeated rows give repeated results; a null doc_id stays null. Other columns are not read.
    """

    def run(batches):
        memory = WordHashes()
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                runs, texts = [], []
                for text in part.column(1):
                    words = (text.as_py() or b"").split()
                    found = find_runs(words, memory.array(words), min_words, exponent)
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    texts.append(b" ".join(collapsed(words, found)))
                columns = [part.column(0), pa.array(runs, _RUN_TYPE), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")
