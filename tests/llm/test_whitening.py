"""Whitened vectors against a dense decomposition in one process."""

import math

import numpy as np
import pytest
from clonara.llm import whitening
from clonara.llm.common import table
from clonara.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, n long, i int, v string, _v long, component int"


def symmetric(kind, draw):
    d = int(draw.integers(1, 40))
    if kind == "full":
        a = draw.standard_normal((d, d))
        a = a @ a.T
    elif kind == "equal":
        q, _ = np.linalg.qr(draw.standard_normal((d, d)))
        a = q @ np.diag(draw.integers(0, 4, d) * 1.0) @ q.T
    elif kind == "diagonal":
        a = np.diag(draw.integers(0, 3, d) * 1.0)
    else:
        x = draw.standard_normal((max(1, d // 2), d)) * 10.0 ** draw.integers(-3, 3, d)
        a = x.T @ x
    return (a + a.T) / 2


@pytest.mark.parametrize("kind", ["full", "equal", "diagonal", "deficient"])
def test_slicing(kind):
    draw = np.random.default_rng(1)
    for _ in range(40):
        a = symmetric(kind, draw)
        want = np.linalg.eigvalsh(a)[::-1]
        most, k = np.abs(want).max(), min(32, len(a))
        for shift in draw.uniform(-most, most, 5):
            assert whitening.count_above(a, shift) == (want > shift).sum()
        values, vectors = whitening.Slicer(a).leading(32)
        assert np.abs(values - want[:k]).max() <= 1e-9 * most
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-6
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-8 * most


def test_wrong_numbers_are_noticed():
    s = whitening.Slicer(np.diag([5.0, 4.0, 1.0]))
    s.certify([5.0, 4.0, 1.0])
    with pytest.raises(ArithmeticError):
        s.certify([5.0, 1.0])


def plain(rows):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in good), default=0)
    x = [[math.floor(64 * c) + 1000000 for c in v] + [1000000] * (width - len(v)) for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x]).reshape(n, width)
    values, basis = np.linalg.eigh(centred.T @ centred / max(n, 1))
    return [i for i, _ in good], n, deviation, centred, values[::-1], basis[:, ::-1]


def same(got, rows, components=32):
    ids, n, deviation, centred, values, basis = plain(rows)
    k = min(components, len(values))
    assert len(got) == n * k
    some = [c for c in range(k) if values[c] > 1e-12 * max(values[0], 0)]
    white = np.full((n, k), np.nan)
    white[:, some] = centred @ basis[:, some] / np.sqrt(values[some])
    key = lambda r: (r.vec_id is None, r.vec_id or 0, r.deviation or 0)
    by = {c: sorted([r for r in got if r.component == c + 1], key=key) for c in range(k)}
    order = sorted(range(n), key=lambda j: (ids[j] is None, ids[j] or 0, deviation[j]))
    for c in range(k):
        assert [r.vec_id for r in by[c]] == [ids[j] for j in order] and [r.deviation for r in by[c]] == [deviation[j] for j in order]
        assert {r.n for r in by[c]} == {n} and len({r.identity_error for r in got}) == 1
        if c in some:
            w = np.array([r.whitened for r in by[c]])
            gap = min([abs(values[c] - values[e]) for e in range(len(values)) if e != c], default=1.0) / values[0]
            if gap > 1e-6:
                assert np.abs(np.abs(w) - np.abs(white[order, c])).max() < 1e-6
            assert abs(by[c][0].explained * values.sum() / values[c] - 1) < 1e-6
        else:
            assert {r.whitened for r in by[c]} <= {None}
    if some:
        w = np.array([[r.whitened for r in by[c]] for c in some])
        error = np.abs(np.cov(w, bias=True).reshape(len(some), -1) - np.eye(len(some))).max()
        assert error < 1e-6 and abs(got[0].identity_error - error) < 1e-8


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    same(QUERIES["op13_whitening"](spark, SF).collect(), rows)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "v", 3, 4) for i, v in rows], SCHEMA).repartition(3)


def test_odd_rows(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=6).tolist()) for i in range(40)]
    rows += [(41, None), (42, [1.0, None, 2.0]), (43, [float("nan")]), (44, [float("inf")] * 6), (45, [1.0, 2.0]), (46, []), (None, [0.5] * 6), (7, rows[7][1]), (7, [1.0] * 6), (50, [-0.0] * 6)]
    same(whitening.whiten(frame(spark, rows)).collect(), rows)


@pytest.mark.parametrize("rows", [
    [], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0, 3.0])] * 5, [(1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [5.0, 5.0])],
    [(i, [float(i == j) for j in range(5)]) for i in range(5)]])
def test_few_or_equal_rows(spark, rows):
    same(whitening.whiten(frame(spark, rows)).collect(), rows)


def test_large_entries(spark):
    rows = [(1, [1e300, 1.0]), (2, [0.0, 2.0]), (3, [-1e300, 3.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 6 and {r.deviation for r in got if r.vec_id != 2} == {None} and {r.deviation for r in got if r.vec_id == 2} == {0}
