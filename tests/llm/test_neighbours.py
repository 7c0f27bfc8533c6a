import numpy as np
import pandas as pd
import plain
from clonara.llm import neighbours
from clonara.llm.common import table
from pyspark.sql import functions as F

KIND = "vec_id long, embedding array<float>, rank int, score double, shard int, ids string"
SF = "/root/testdata/sf0.1"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 1.0, 5, "i") for i, v in rows], KIND).repartition(3)


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def test_recall_against_brute_force(spark):
    vectors = table(spark, SF, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    ids = [i for i, _ in rows if i % 100 == 0]
    got = answers(neighbours.nearest(vectors, vectors.filter(F.col("vec_id").isin(ids)), shard_rows=2000))
    want = plain.nearest(rows, ids)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in ids]
    assert np.mean(hits) >= 0.9
    for q in ids:
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)


def test_small_tables_are_exact_with_ties_copies_and_lengths(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4).astype(np.float32) * (1 + i % 5)]) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 0.0]) for i in range(50)] + [(200, [2.0, 4.0, 0.0, 0.0]), (201, [-1.0, -2.0, 0.0, 0.0])]
    bad = [(300, None), (301, []), (302, [0.0] * 4), (303, [1.0, None, 2.0, 3.0]), (304, [float("nan"), 1.0, 1.0, 1.0]), (305, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4)]
    other = [(400, [1.0, 2.0]), (401, [2.0, 2.0])]
    table_ = frame(spark, rows + bad + other + [rows[3]])
    got = answers(neighbours.nearest(table_, table_))
    want = plain.nearest(rows, [i for i, _ in rows])
    assert set(got) == {i for i, _ in rows} | {400, 401}
    for q, near in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in near]
        np.testing.assert_allclose([s for _, s in got[q]], [s for _, s in near], rtol=1e-12, atol=1e-12)
    assert got[400] == [(401, 6.0)]


def test_many_shards(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(300)]
    got = answers(neighbours.nearest(frame(spark, rows), frame(spark, rows[::7]), shard_rows=40))
    want = plain.nearest(rows, [i for i, _ in rows[::7]])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_recall_over_full_shards(spark, tmp_path):
    rng = np.random.default_rng(6)
    n, dims = 4 * neighbours.SHARD_ROWS, 64
    x = rng.normal(size=(n, dims)).astype(np.float32)
    pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)}).to_parquet(tmp_path / "embeddings.parquet")
    vectors = table(spark, str(tmp_path), "embeddings")
    got = answers(neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0)))
    asked = np.arange(0, n, 20)
    scores = x[asked].astype(float) @ x.T.astype(float)
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-scores, 20, axis=1)[:, :20]
    hits = [len({i for i, _ in got[q]} & set(b.tolist())) / 20 for q, b in zip(asked.tolist(), best)]
    print(f"recall {np.mean(hits):.4f}, least {np.min(hits):.2f}, {len(hits)} queries")
    assert len(got) == len(asked) and np.mean(hits) >= 0.9


def test_queries_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(200)] + [(900 + i, [float(i), 1.0]) for i in range(3)]
    want = plain.nearest(rows[:200], [i for i, _ in rows[:200]])
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 10)
    monkeypatch.setattr(neighbours, "TASK_BLOCKS", 2)
    got = answers(neighbours.nearest(frame(spark, rows), frame(spark, rows), shard_rows=50))
    assert {q: [i for i, _ in got[q]] for q in want} == {q: [i for i, _ in v] for q, v in want.items()}
    assert [i for i, _ in got[900]] == [901, 902]


def test_few_rows_and_none(spark):
    assert answers(neighbours.nearest(frame(spark, [(1, [1.0]), (2, [2.0])]), frame(spark, [(1, [1.0])]))) == {1: [(2, 2.0)]}
    assert neighbours.nearest(frame(spark, [(1, [1.0])]), frame(spark, [(1, [1.0])])).count() == 0
    assert neighbours.nearest(frame(spark, []), frame(spark, [])).count() == 0
    assert neighbours.nearest(frame(spark, [(1, [1.0])]), frame(spark, [])).count() == 0
