"""Known values on tiny inputs, and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from clonara.functions import text
from clonara.functions.fisher import with_fisher
from clonara.operators import clonotypes, diversity, genes, kmers, lengths, reports


def _sizes(spark, values):
    return spark.createDataFrame([("d", "r", float(v)) for v in values], "dataset string, repertoire_id string, templates double")


@pytest.mark.parametrize("name,values,want", [
    ("shannon", [100, 50, 25, 25], 1.75), ("gini", [1, 1, 1, 1], 0.0), ("gini", [100, 1, 1, 1], 0.7208737864), ("gini", [7], 1.0),
    ("simpson", [50, 50], 0.5), ("d50", [40, 30, 20, 10], 0.5), ("clonality", [1, 1, 1, 1], 0.0), ("clonality", [100], 1.0)])
def test_index(spark, name, values, want):
    got = diversity.index(_sizes(spark, values), name).first()[name]
    assert got == pytest.approx(want, abs=1e-9)


def test_index_without_sizes_is_zero(spark):
    empty = spark.createDataFrame([("d", "r", None)], "dataset string, repertoire_id string, templates double")
    assert all(diversity.index(empty, n).first()[n] == 0.0 for n in ("shannon", "gini", "simpson", "d50", "clonality"))
    assert diversity.diversity_set(empty.withColumn("junction_aa", F.lit(None).cast("string"))).first().n_unique_clones == 1.0


def test_half_boundary(spark):
    # 50 of 100 is reached exactly by the first clone
    stats = diversity.size_statistics(diversity.row_sizes(_sizes(spark, [50, 30, 20]))).first()
    assert (stats.half, stats.below_half) == (1, 1)
    assert stats.top10 == pytest.approx(1.0)


def test_weighted_length(spark):
    df = spark.createDataFrame([("d", "r", s, float(w)) for s, w in (("CASSLGQAY", 100), ("CASSFTQY", 50), ("CAW", 25))],
                               "dataset string, repertoire_id string, junction_aa string, templates double")
    got = lengths.length_weighted(df).first()
    assert got.mean_cdr3_length == pytest.approx(7.857143, abs=1e-6) and got.median_cdr3_length == 9.0


def test_gene_rules(spark):
    df = spark.createDataFrame([("TRBV20-1*01",), ("TRBJ2-7",), (None,), ("",), ("*01",), ("A/B",)], "c string")
    got = [tuple(r) for r in df.select(text.gene_norm("c"), text.gene_family("c"), text.gene_family_alt("c"), text.sentinel_fill("c")).collect()]
    assert got == [("TRBV20-1", "TRBV20", "TRBV20", "TRBV20-1*01"), ("TRBJ2-7", "TRBJ2", "TRBJ2", "TRBJ2-7"), ("UNKNOWN", "UNK", None, "-999.0"),
                   ("", "UNK", None, "-999.0"), ("", "UNK", "*01", "*01"), ("A/B", "A/B", "A", "A/B")]


def test_usage(spark):
    df = spark.createDataFrame([("d", "r", v, j) for v, j in (("TRBV20-1*01", "TRBJ2-7"), ("TRBV20-1*02", "TRBJ2-7"), ("TRBV7-3", "TRBJ1-1"), (None, "TRBJ1-1"))],
                               "dataset string, repertoire_id string, v_call string, j_call string")
    assert {r.gene: round(r.value, 4) for r in genes.usage(df, "v").collect()} == {"TRBV20-1": 0.6667, "TRBV7-3": 0.3333}
    assert {r.pair: round(r.value, 4) for r in genes.pair_usage(df).collect()} == {"TRBV20-1_TRBJ2-7": 0.6667, "TRBV7-3_TRBJ1-1": 0.3333}


def test_gene_diversity(spark):
    df = spark.createDataFrame([("d", "r", "TRBV20-1", "J")] * 90 + [("d", "r", "TRBV7-3", "J")] * 10,
                               "dataset string, repertoire_id string, v_call string, j_call string")
    got = {r.kind: r for r in genes.gene_diversity(df).collect()}
    assert got["v"].shannon == pytest.approx(0.325083, abs=1e-6) and got["j"].simpson == pytest.approx(0.0)


def test_dataset_id(spark):
    names = ["train_dataset_7", "test_dataset_7_1", "study", "a1_b", "x_12_3"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    assert [r[0] for r in df.select(text.dataset_id("c")).collect()] == [7, 7, 1, 1, 12]


def test_templates(spark):
    df = spark.createDataFrame([("17",), ("2.5",), ("x",), (None,), ("NaN",), ("",)], "c string")
    assert [r[0] for r in df.select(text.coerce_templates("c")).collect()] == [17.0, 2.5, 1.0, 1.0, 1.0, 1.0]


def test_short_sequences_have_no_windows(spark, rows):
    got = {r.junction_aa for r in kmers.kmer_extract(rows, 3).collect()}
    assert "CA" not in got and "CASSYNLTK" in got
    assert kmers.kmer_counts(rows, (3,)).where("repertoire_id = 'r3'").count() == 0


def test_full_vocabulary(spark):
    got = [r.kmer for r in kmers.full_vocabulary(spark, 2).orderBy("index").collect()]
    assert len(got) == len(set(got)) == 400 and got[0] == "AA" and got[1] == "AC" and got[-1] == "YY"


def _exact_fisher(a, c, n1, n0, greater):
    hits, total = a + c, math.comb(n1 + n0, a + c)
    p = lambda x: math.comb(n1, x) * math.comb(n0, hits - x) / total
    lo, hi = max(0, hits - n0), min(n1, hits)
    return sum(p(x) for x in range(lo, hi + 1) if (x >= a if greater else p(x) <= p(a) * (1 + 1e-7)))


@pytest.mark.parametrize("alternative", ["two-sided", "greater"])
def test_fisher_against_exact_sums(spark, alternative):
    cases = [(a, c, 10, 10) for a in range(11) for c in range(11)] + [(a, c, 7, 3) for a in range(8) for c in range(4)]
    cases += [(40, 12, 150, 170), (3, 90, 500, 400), (16, 15, 17, 40), (0, 9, 3000, 2000)]
    df = spark.createDataFrame(cases, "pos long, neg long, n_pos long, n_neg long")
    for r in with_fisher(df, alternative).collect():
        hits = r.pos + r.neg
        want = 1.0 if hits in (0, r.n_pos + r.n_neg) else _exact_fisher(r.pos, r.neg, r.n_pos, r.n_neg, alternative == "greater")
        assert r.p_value == pytest.approx(want, rel=1e-9), r


def test_fisher_golden_and_symmetry(spark):
    df = spark.createDataFrame([(8, 1, 10, 10), (1, 8, 10, 10), (5, 0, 5, 5), (5, 5, 5, 5)], "pos long, neg long, n_pos long, n_neg long")
    by_table = {(r.pos, r.neg): (r.odds_ratio, r.p_value) for r in with_fisher(df).collect()}
    got = [by_table[k] for k in ((8, 1), (1, 8), (5, 0), (5, 5))]
    assert got[0][1] == pytest.approx(0.005477, abs=1e-6) and got[0][1] == pytest.approx(got[1][1])
    assert got[0][0] == pytest.approx(36.0) and math.isinf(got[2][0]) and math.isnan(got[3][0])


def test_student_p(spark):
    cases = [(2.228139, 10.0, 0.05), (12.706205, 1.0, 0.05), (0.0, 5.0, 1.0), (-2.228139, 10.0, 0.05), (4.302653, 2.0, 0.05), (3.182446, 3.0, 0.05), (1.960000, 100000.0, 0.05)]
    rows = spark.createDataFrame(cases, "t double, df double, p double")
    for r in rows.withColumn("got", reports.student_p(F.col("t"), F.col("df"))).collect():
        assert r.got == pytest.approx(r.p, abs=1e-5)


def test_null_sequences_count_for_genes_only(spark, rows):
    shares = {r.feature: r.value for r in genes.family_usage(rows).where("repertoire_id = 'r2'").collect()}
    assert shares["v_fam_UNK"] == pytest.approx(0.25) and shares["j_fam_UNK"] == pytest.approx(0.5)
    assert clonotypes.presence(rows).where("repertoire_id = 'r2'").count() == 3


def test_atchley_of_empty_repertoire(spark, rows):
    got = lengths.atchley(rows).where("repertoire_id = 'r3'").first()
    assert got.atchley_PAF_mean == 0.0 and got.atchley_PAF_std == 0.0 and got.atchley_PAF_min is None


def test_tokens(spark):
    df = spark.createDataFrame([("ACX",), ("Y" * 30,)], "c string")
    got = [r[0] for r in df.select(text.encode_tokens("c", 5)).collect()]
    assert got == [[1, 2, 21, 0, 0], [20] * 5]
    assert [r[0] for r in df.select(text.encode_kmers("c", 3)).collect()][0] == [0]
    assert spark.createDataFrame([("AAAC",)], "c string").select(text.encode_kmers("c", 3)).first()[0] == [1, 2]
