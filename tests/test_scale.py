"""Cases that small tables do not reach: many repertoires per class, large lists, hot k-mers, both sides of plan choices."""

import pytest
from pyspark.sql import functions as F

from clonara.operators import clonotypes, kmers, ranking
from clonara.operators.ranks import top_k
from clonara.sources import stores


@pytest.fixture(scope="module")
def many(spark):
    """60 repertoires per class; CASSLATEF only in the last 20 positive ones, its genes only in the very last."""
    rows, meta = [], []
    for i in range(60):
        for positive in (True, False):
            rep = f"{'p' if positive else 'q'}{i:03d}"
            meta.append(("train_dataset_7", rep, f"{rep}.tsv", positive))
            rows += [("train_dataset_7", rep, positive, s, "TRBV1-1", "TRBJ1-1", 1.0, n) for n, s in enumerate(["CASSCOMMF", f"CASS{'ACDEFGHIKL'[i % 10]}{'MNPQRS'[i // 10]}F"])]
            if positive and i >= 40:
                rows.append(("train_dataset_7", rep, positive, "CASSLATEF", "TRBV9-9" if i == 59 else "", "TRBJ2-2" if i == 59 else "", 1.0, 9))
    return (spark.createDataFrame(rows, "dataset string, repertoire_id string, label_positive boolean, junction_aa string, v_call string, j_call string, templates double, row_order int"),
            spark.createDataFrame(meta, "dataset string, repertoire_id string, filename string, label_positive boolean"))


def test_late_repertoires_are_mined_ranked_and_get_genes(spark, many):
    rows, meta = many
    mined = clonotypes.mine_enriched(rows, meta)
    assert {r.junction_aa: (r.pos_freq, r.neg_freq) for r in mined.collect()} == {"CASSLATEF": (20 / 60, 0.0)}
    assert clonotypes.mine_enriched(rows, meta, max_files=30).count() == 0
    assert "CASSLATEF" in {r.junction_aa for r in clonotypes.mine_by_dataset(rows, meta).collect()}
    fisher = {r.junction_aa: r for r in clonotypes.mine_fisher(rows, meta).collect()}
    assert fisher["CASSLATEF"].direction == "positive" and fisher["CASSLATEF"].p_value < 1e-5 and "CASSCOMMF" not in fisher
    assert {r.junction_aa: r.significant for r in clonotypes.mine_fisher_greater(rows, meta).collect()} == {"CASSLATEF": True}
    weights = spark.createDataFrame([(3, "LAT", 1.0)], "k int, kmer string, weight double")
    ranked = ranking.rank_gain(rows, meta, mined, weights)
    assert ranked.where("rank = 1").first().junction_aa == "CASSLATEF"
    calls = {r.junction_aa: (r.v_call, r.j_call) for r in ranking.vj_lookup(ranked, rows, meta).collect()}
    assert calls["CASSLATEF"] == ("TRBV9-9", "TRBJ2-2")


def test_list_width_by_dataset(many):
    rows, meta = many
    everything = {"min_freq": 0.0, "enrichment": 0.0}
    assert clonotypes.mine_enriched(rows, meta, top_n=5, widths={7: 2}, **everything).count() == 2
    assert clonotypes.mine_enriched(rows, meta, top_n=5, widths={8: 2}, **everything).count() == 5
    assert clonotypes.mine_enriched(rows, meta, **everything).count() > 5


def test_both_kmer_score_joins_agree_with_a_hot_kmer(spark, monkeypatch):
    seqs = spark.range(3000).select(F.lit("d_1").alias("dataset"), F.concat(F.lit("CAS"), F.translate(F.col("id").cast("string"), "0123456789", "ACDEFGHIKL")).alias("junction_aa"))
    weights = kmers.explode_kmers(seqs.select("junction_aa"), (3, 4)).select("k", "kmer").distinct().withColumn("weight", F.ascii(F.col("kmer")) * 1.0 + F.length("kmer"))
    scores = lambda: {r.junction_aa: r.kmer_score for r in ranking.with_kmer_score(seqs, weights, [3, 4], once=False).collect()}
    small = scores()
    plan = ranking.with_kmer_score(seqs, weights, [3, 4], once=False)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", 0)
    assert scores() == small and len(small) == 3000


def test_wide_lists_are_cut_exactly(spark):
    df = spark.range(9000).select(F.lit("a").alias("g"), (F.col("id") * 7919 % 9001).alias("score"), "id")
    for k in (999, 1000, 5000):
        got = top_k(df, ["g"], [F.desc("score"), F.asc("id")], k, rank="rank", salt_on=["id"])
        scores = [r.score for r in got.orderBy("rank").collect()]
        assert len(scores) == k and scores == sorted((i * 7919 % 9001 for i in range(9000)), reverse=True)[:k]


def test_vocabulary_holds_names_of_every_repertoire(many):
    rows, meta = many
    features = rows.select("dataset", "repertoire_id", F.concat(F.lit("s_"), "junction_aa").alias("feature")).distinct()
    assert "s_CASSLATEF" in {r.feature for r in stores.feature_vocabulary(features, meta).collect()}
    assert "s_CASSLATEF" not in {r.feature for r in stores.feature_vocabulary(features, meta, 10).collect()}


def test_column_index_is_the_sorted_place(spark):
    names = ["", "a", "aa", "ab", "b", "k3_AAA", "k3_AAC", "k4_AAAA", "k3_AA", "Z", "é"]
    rows = spark.createDataFrame([(n,) for n in names + names], "feature string")
    got = {r["feature"]: r["index"] for r in kmers.column_index(rows).collect()}
    order = sorted(n for n in names if n != "é") + ["é"]
    assert got == {n: i for i, n in enumerate(order)}
