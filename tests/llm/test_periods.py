"""Runs of words against a version that looks at every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from clonara.llm import periods
from clonara.llm.common import WordHashes, table
from clonara.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
HASHES = WordHashes()
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_lyndon(w):
    out = []
    for i in range(len(w)):
        j = i + 1
        while j < len(w) and w[j:] > w[i:]:
            j += 1
        out.append(j - i)
    return out


def plain_runs(words, least=24, exponent=3):
    codes = np.unique(np.array(words, object), return_inverse=True)[1] if words else np.zeros(0, int)
    found = {}
    for p in range(1, len(words) // exponent + 1):
        same = np.r_[False, codes[:-p] == codes[p:], False]
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a + p >= max(least, exponent * p):
                found.setdefault((a, b - a + p), p)  # the smallest period comes first
    return sorted(((a, n, p) for (a, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc, text):
    words = WORDS.findall(text or "")
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_lyndon_words_by_grouping():
    draw = random.Random(1)
    for _ in range(3000):
        w = [draw.randrange(draw.choice([1, 2, 3, 5])) for _ in range(draw.randint(1, 40))]
        letters = sorted(set(w))
        ranks = [letters.index(x) for x in w]
        assert periods.lyndon_lengths(ranks, len(letters)) == plain_lyndon(ranks)


@pytest.mark.parametrize("least,exponent", [(3, 3), (6, 3), (8, 4), (24, 3)])
def test_runs_as_by_every_period(least, exponent):
    draw = random.Random(least)
    for _ in range(1500):
        letters, w = draw.choice([1, 2, 3]), []
        while len(w) < draw.randint(5, 80):
            w += [b"%d" % draw.randrange(letters) for _ in range(draw.randint(1, 6))] * draw.randint(1, 6)
        assert periods.find_runs(w, HASHES.array(w), least, exponent) == plain_runs(w, least, exponent)


def test_equal_hashes_of_different_words():
    draw = random.Random(5)
    for _ in range(300):
        w = [b"%d" % draw.randrange(4) for _ in range(10)] * draw.randint(1, 5) + [b"%d" % draw.randrange(9) for _ in range(30)]
        flat = np.array([int(x) % 2 for x in w], np.uint64)
        assert periods.find_runs(w, flat) == plain_runs(w)


def test_other_limits_are_refused():
    with pytest.raises(ValueError):
        periods.find_runs([b"a"] * 30, HASHES.array([b"a"] * 30), 24, 2)


def test_long_texts():
    first, second = [b"a"], [b"a", b"b"]
    while len(second) < 20_000:
        first, second = second, second + first
    assert len(periods.find_runs(second, HASHES.array(second))) > 1000
    for w in ([b"x"] * 100_000, [b"%d" % i for i in range(300)] * 300):
        (start, length, period), = periods.find_runs(w, HASHES.array(w))
        assert (start, length, period) == (0, len(w), len(set(w)))


def test_rows(make_docs, odd_rows):
    rows = odd_rows + [(None, "on and " * 30), (7, "the same words " * 40), (20, "a b c " * 20 + "end " * 50), (21, "😀 é " * 24)]
    got = periods.collapse_runs(make_docs(rows)).collect()
    want = []
    for doc, text in rows:
        words = WORDS.findall(text or "")
        runs = plain_runs(words)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        want.append((doc, runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted([(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got], key=key) == sorted(want, key=key)
    assert periods.collapse_runs(make_docs([(1, "x")]).limit(0)).count() == 0


def test_query_over_whole_documents(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = sorted(tuple(r) for r in QUERIES["op12_periods"](spark, SF).collect())
    assert got == sorted(plain_row(*d) for d in docs)
    assert sum(r[1] > 0 for r in got) > 5


def test_query_over_odd_rows(spark, tmp_path, make_docs, odd_rows):
    hit = [i for i in range(100, 1000) if zlib.crc32(str(i).encode()) % 10 == 0]
    draw = random.Random(2)
    rows = odd_rows + [(None, "on and " * 30), (hit[0], None), (hit[1], " \t"), (hit[2], "one")]
    rows += [(i, " ".join(draw.choice("abc 日 é 😀".split()) for _ in range(draw.randint(1, 200)))) for i in hit[3:]]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([tuple(r) for r in QUERIES["op12_periods"](spark, str(tmp_path)).collect()], key=key) == sorted([plain_row(*r) for r in rows], key=key)
