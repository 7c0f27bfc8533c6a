"""Queries without a SQL twin, and distributed helpers, against plain Python."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonara.constants import AMINO_ACIDS, REP
from clonara.operators import encode, evaluate, kmers, ranking, ranks, sampling

KEY = ["row_order", "junction_aa", "v_call", "j_call", "templates"]


def test_hashed_statistics(spark, tables):
    df = tables.rearrangements.where("repertoire_id <= 'rep_000002'").select(*REP, "junction_aa")
    bags = defaultdict(list)
    for r in df.collect():
        s = r.junction_aa
        if s and len(s) >= 5 and all(c in AMINO_ACIDS + "X*-." for c in s.upper()):
            bags[(r.dataset, r.repertoire_id)].append(s.upper())
    want = {}
    for rep, seqs in bags.items():
        table = np.zeros((len(seqs), 64))
        for i, s in enumerate(seqs):
            for j in range(len(s) - 2):
                w = s[j:j + 3]
                if all(c in AMINO_ACIDS for c in w):
                    table[i, zlib.crc32(w.encode()) % 64] += 1 / max(len(s) - 2, 1)
        for b in np.nonzero(table.any(axis=0))[0]:
            want[(*rep, int(b))] = (table[:, b].mean(), table[:, b].std(), table[:, b].max())
    got = {(r.dataset, r.repertoire_id, r.bucket): (r.mean, r.std, r.max) for r in kmers.hashed_statistics(df, (3,), 64).collect()}
    assert got.keys() == want.keys() and len(want) > 20
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


@pytest.mark.parametrize("n", [30, 1500])
def test_samples_are_subsets_of_exact_size(spark, tables, n):
    df = tables.rearrangements
    sizes = {r.repertoire_id: r["count"] for r in df.groupBy("repertoire_id").count().collect()}
    for sample in (sampling.weighted_sample(df, n, KEY), sampling.uniform_sample(df, n, KEY)):
        got = {r.repertoire_id: r["count"] for r in sample.groupBy("repertoire_id").count().collect()}
        assert got == {k: min(n, v) for k, v in sizes.items()}
        assert sample.exceptAll(df).count() == 0
    assert sampling.weighted_sample(df, n, KEY).exceptAll(sampling.weighted_sample(df, n, KEY)).count() == 0


def test_weighted_sample_prefers_weight(spark):
    heavy = [("d", "r", f"s{i}", 1000.0 if i < 20 else 1.0) for i in range(200)]
    df = spark.createDataFrame(heavy, "dataset string, repertoire_id string, junction_aa string, templates double")
    got = {r.junction_aa for r in sampling.weighted_sample(df, 20, ["junction_aa"]).collect()}
    assert len([s for s in got if int(s[1:]) < 20]) >= 18
    none = df.withColumn("templates", F.lit(0.0))
    assert sampling.weighted_sample(none, 20, ["junction_aa"]).count() == 20


@pytest.mark.parametrize("k,partitions", [(7, 4), (1000, 4), (1000, 300)])
def test_top_k_matches_a_full_sort(spark, k, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 101).alias("v"), "id")
    got = {(r.g, r.id): r.r for r in ranks.top_k(df, ["g"], [F.desc("v"), F.asc("id")], k, rank="r").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    groups = defaultdict(list)
    for i in range(5000):
        groups[i % 3].append((-(i * 7919 % 101), i))
    want = {(g, i): n + 1 for g, items in groups.items() for n, (_, i) in enumerate(sorted(items)[:k])}
    assert got == want


def test_dense_numbers_match_a_full_sort(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), F.xxhash64("id").alias("h"), "id")
    got = ranks.dense_numbers(df, ["g"], F.shiftright("h", 54), [F.asc("h")], "n").collect()
    for g in (0, 1):
        mine = sorted((r.h, r.n) for r in got if r.g == g)
        assert [n for _, n in mine] == list(range(1, 2001))


def test_auc_with_ties(spark):
    rng = np.random.RandomState(1)
    data = [(bool(rng.rand() < 0.4), float(rng.randint(-3, 15)) / 10) for _ in range(400)]
    pos, neg = [p for y, p in data if y], [p for y, p in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame([(1, y, p) for y, p in data], "g int, label_positive boolean, p double")
    assert evaluate.roc_auc(df, ["g"]).first().auc == pytest.approx(want, abs=1e-12)
    assert evaluate.roc_auc(df.where("label_positive"), ["g"]).first().auc is None


def test_quota_rows_hold_an_important_kmer(spark, tables):
    important = spark.createDataFrame([("ASS",), ("GGG",)], "kmer string")
    got = ranking.rank_quota(tables.rearrangements, important, KEY, k=100).collect()
    counts = Counter((r.dataset, r.label_positive) for r in got)
    assert all("ASS" in r.junction_aa or "GGG" in r.junction_aa for r in got)
    hits = Counter((r.dataset, r.label_positive) for r in tables.rearrangements.collect() if r.junction_aa and ("ASS" in r.junction_aa or "GGG" in r.junction_aa))
    for (d, y), v in counts.items():
        pos = min(70, hits[d, True])
        assert v == (pos if y else min(100 - pos, hits[d, False]))


def test_encoded_bags_are_square(spark, tables):
    for r in encode.encode_bags(tables.rearrangements, 600, ["row_order", "v_call", "j_call", "templates"]).collect():
        assert len(r.tokens) == 600 and all(len(t) == 20 for t in r.tokens)
        assert any(t == [0] * 20 for t in r.tokens) and any(t[0] == 2 for t in r.tokens)


def test_rank_gain_by_hand(spark, rows, metadata):
    mined = spark.createDataFrame([("d_1", "CASSYNLTK", 3.0), ("d_1", "GGGG", 1.0)], "dataset string, junction_aa string, score double")
    weights = spark.createDataFrame([(3, "CAS", 0.5), (4, "SSLA", 2.0)], "k int, kmer string, weight double")
    got = {r.junction_aa: (r.score, r["rank"]) for r in ranking.rank_gain(rows, metadata, mined, weights).collect()}
    assert got["CASSYNLTK"] == (6.5, 1)
    assert got["CASSLAPGATNEKLFF"] == (5.0, 2)  # two rows of 0.5 + 2.0
    assert got["GGGG"] == (2.0, 3) and len(got) == 6


def test_repertoire_larger_than_the_rest_is_exact(spark):
    """One repertoire with most rows, and one sequence with a third of them."""
    n = 6000
    df = spark.range(n).select(F.lit("d").alias("dataset"), F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 7)).alias("repertoire_id"),
                               (F.col("id") % 2 == 0).alias("label_positive"),
                               F.when(F.col("id") % 3 == 0, "CASSHOTF").otherwise(F.concat(F.lit("CASS"), F.translate((F.col("id") % 500).cast("string"), "0123456789", "ACDEFGHIKL"), F.lit("F"))).alias("junction_aa"))
    counts = Counter()
    for r in df.collect():
        for i in range(len(r.junction_aa) - 2):
            counts[(r.repertoire_id, r.junction_aa[i:i + 3])] += 1
    got = {(r.repertoire_id, r.kmer): r["count"] for r in kmers.kmer_counts(df, (3,)).collect()}
    assert got == dict(counts)


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_quantiles_match_numpy(spark, n):
    rng = np.random.RandomState(n)
    p, size = np.round(rng.rand(n), 2), rng.randint(1, 10 ** 6, n)
    df = spark.createDataFrame([(1, float(a), int(b)) for a, b in zip(p, size)], "g int, p double, size long")
    wanted = {"a": 0.25, "b": 0.5, "c": 0.9}
    for column, values, b in (("p", p, ranks.unit_bin("p")), ("size", size, ranks.log_bin("size"))):
        got = ranks.quantiles(df, ["g"], column, wanted, b).first()
        assert [got[k] for k in wanted] == pytest.approx([np.quantile(values, q) for q in wanted.values()])
