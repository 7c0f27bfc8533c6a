"""Invariants over the generated data."""

import pytest
from pyspark.sql import functions as F

from clonara.constants import REP
from clonara.operators import blend, clonotypes, diversity, evaluate, kmers, ranking, reports
from clonara.plans.report_queries import full_submission, submission


def test_shares_sum_to_one(tables):
    shares = kmers.kmer_frequencies(tables.rearrangements).groupBy(*REP, F.substring("feature", 1, 6)).agg(F.sum("value").alias("s"))
    assert shares.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_index_ranges(tables):
    d = diversity.diversity_set(tables.rearrangements)
    ok = "gini_coefficient >= 0 AND gini_coefficient < 1 AND d50_index > 0 AND d50_index <= 1 AND top_clone_fraction <= top10_clone_fraction"
    assert d.where(f"NOT ({ok})").count() == 0


def test_blend_at_one_is_identity(tables):
    a, b = submission(tables, "p_a"), submission(tables, "p_b")
    assert reports and blend.blend_drift(a, blend.blend_global(a, b, 1.0)).first().max_diff == 0.0


def test_repeated_id_fails(tables):
    a = submission(tables, "p_a")
    with pytest.raises(Exception, match="repeated ID"):
        blend.blend_global(a, a.union(a)).collect()


def test_overlap_reconciles(tables):
    a = clonotypes.mine_enriched(tables.rearrangements, tables.metadata, min_freq=0.4, enrichment=1.0)
    b = clonotypes.mine_enriched(tables.rearrangements, tables.metadata, min_freq=0.6, enrichment=1.0)
    for r in clonotypes.miner_overlap(a, b).where("dataset <> 'overall'").collect():
        if r.a_count and r.b_count:
            assert r.overlap + r.a_only == r.a_count and r.overlap + r.b_only == r.b_count


def test_ranks_are_contiguous(tables):
    r = ranking.rank_weighted_frequency(tables.rearrangements).groupBy("dataset").agg(F.count("*").alias("n"), F.max("rank").alias("m"), F.count_distinct("rank").alias("d"))
    assert r.where("n <> m OR n <> d").count() == 0


def test_held_out_repertoires_do_not_mine(tables):
    """With a fold excluded the mined frequencies come from the other repertoires only."""
    m = tables.metadata
    fold = m.where(F.col("repertoire_id") <= "rep_000004")
    rest = m.join(fold.select(*REP), REP, "left_anti")
    a = clonotypes.mine_enriched(tables.rearrangements, m, exclude_fold=fold)
    b = clonotypes.mine_enriched(tables.rearrangements, rest)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_validation_finds_faults(spark, tables):
    good = full_submission(tables)
    seen = {r.check: r.ok for r in reports.validate_submission(good, good.count(), 0).collect()}
    assert seen["row_count"] and seen["no_nulls"] and seen["probability_range"] and seen["column_order"]
    bad = good.withColumn("label_positive_probability", F.when(F.col("ID") == "rep_000001", 1.5).otherwise(F.col("label_positive_probability"))).withColumn(
        "v_call", F.when(F.col("ID") == "rep_000002", None).otherwise(F.col("v_call")))
    seen = {r.check: (r.ok, r.observed) for r in reports.validate_submission(bad).collect()}
    assert seen["probability_range"] == (False, 1) and seen["no_nulls"] == (False, 1) and not seen["row_count"][0]
    swapped = {r.check: r.ok for r in reports.validate_submission(good.select(*reversed(good.columns))).collect()}
    assert not swapped["column_order"]


def test_perfect_and_reversed_scores(tables):
    p = tables.predictions.select(F.lit(1).alias("g"), "label_positive", F.col("label_positive").cast("double").alias("p"))
    assert evaluate.roc_auc(p, ["g"]).first().auc == 1.0 and evaluate.balanced_accuracy(p, ["g"]).first().balanced_accuracy == 1.0
    assert evaluate.roc_auc(p.withColumn("p", 1 - F.col("p")), ["g"]).first().auc == 0.0
