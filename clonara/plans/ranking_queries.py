"""Registered sequence rankings.

k-mer weights are made from the data's own k-mers by a fixed rule on their letters.
"""

from pyspark.sql import functions as F

from clonara.constants import REP
from clonara.operators import clonotypes, kmers, ranking
from clonara.plans.clonotype_queries import _DRAW, _LAST, enriched_cte, fisher_cte, greater_cte
from clonara.plans.kmer_queries import _occ, _union
from clonara.plans.profile_queries import rounded
from clonara.plans.registry import query

_KS = (3, 4, 5)
_WSQL = f"""imp AS (SELECT k, kmer, ((31 * ascii(substr(kmer, 1, 1)) + 7 * ascii(substr(kmer, 2, 1)) + ascii(substr(kmer, 3, 1))) % 97)::DOUBLE AS weight
FROM (SELECT DISTINCT k, kmer FROM ({_union(_occ, _KS)})))"""


def weights(t, ks=_KS):
    """Weight of every k-mer of the data by its first three letters."""
    seqs = t.rearrangements.select("junction_aa").distinct()
    letter = lambda i: F.ascii(F.substring("kmer", i, 1))
    w = (31 * letter(1) + 7 * letter(2) + letter(3)) % 97
    return kmers.explode_kmers(seqs, ks).select("k", "kmer").distinct().withColumn("weight", w.cast("double"))


def coefficients(t):
    """Signed coefficients and scales from the same rule."""
    return weights(t).select("k", "kmer", (F.col("weight") - 48).alias("coefficient"), (1 + F.col("weight") % 5).alias("scale"))


def _files(name, cond="label_positive"):
    return f"""{name} AS (SELECT r.* FROM rearrangements r JOIN (SELECT dataset, repertoire_id FROM metadata WHERE {cond}) f
  ON f.dataset = r.dataset AND f.repertoire_id = r.repertoire_id)"""


def _score(name, source, ks, once, table="imp"):
    """SQL: window weights of each distinct sequence of ``source``."""
    d = f"(SELECT DISTINCT dataset, junction_aa FROM {source} WHERE junction_aa IS NOT NULL)"
    parts = " UNION ALL ".join(
        f"SELECT {'DISTINCT' if once else ''} dataset, junction_aa, {k} AS k, substr(junction_aa, i, {k}) AS kmer{'' if once else ', i'} FROM "
        f"(SELECT dataset, junction_aa, unnest(range(1, length(junction_aa) - {k} + 2)) AS i FROM {d} WHERE length(junction_aa) >= {k})" for k in ks)
    return f"{name} AS (SELECT dataset, junction_aa, sum(weight) AS ks FROM ({parts}) JOIN {table} USING (k, kmer) GROUP BY ALL)"


_ORDER = "round(score, 6) DESC, junction_aa"


def _top(k, cols="dataset, junction_aa", order=_ORDER, source="sc"):
    return (f"SELECT {cols}, round(score, 6) AS score, row_number() OVER (PARTITION BY dataset ORDER BY {order})::INT AS rank "
            f"FROM {source} QUALIFY rank <= {k}")


_VALID = "regexp_matches(junction_aa, '^[ACDEFGHIKLMNPQRSTVWY]+$')"
_ALPHA = "regexp_matches(junction_aa, '^[A-Za-z]+$')"


@query("rank_mined_first", f"""WITH {enriched_cte()}, {_files('pf_')}, o AS (SELECT DISTINCT dataset, junction_aa FROM pf_ WHERE length(junction_aa) > 0),
sc AS (SELECT coalesce(o.dataset, m.dataset) AS dataset, coalesce(o.junction_aa, m.junction_aa) AS junction_aa, coalesce(score, 0)::DOUBLE AS score
  FROM mined m FULL JOIN o ON o.dataset = m.dataset AND o.junction_aa = m.junction_aa) {_top(50000)}""")
def _(t):
    r, m = t.rearrangements, t.metadata
    return rounded(ranking.rank_clone_scores(r, m, clonotypes.mine_enriched(r, m)))


@query("rank_gain", f"""WITH {enriched_cte()}, {_WSQL}, {_files('pf_')}, n AS (SELECT dataset, junction_aa, count(*) AS n FROM pf_ WHERE {_VALID} GROUP BY ALL),
{_score('g', 'n', (3, 4), False)}, sc AS (SELECT dataset, junction_aa, 2 * coalesce(score, 0) + coalesce(n, 0) * coalesce(ks, 0) AS score
  FROM (SELECT dataset, junction_aa FROM n UNION SELECT dataset, junction_aa FROM mined) LEFT JOIN n USING (dataset, junction_aa)
  LEFT JOIN g USING (dataset, junction_aa) LEFT JOIN mined USING (dataset, junction_aa) WHERE {_VALID}) {_top(50000)}""")
def _(t):
    r, m = t.rearrangements, t.metadata
    return rounded(ranking.rank_gain(r, m, clonotypes.mine_enriched(r, m), weights(t)))


@query("rank_gain_bonus", f"""WITH {greater_cte()}, {_WSQL}, {_files('pf_')}, n AS (SELECT dataset, junction_aa, count(*) AS n FROM pf_ WHERE {_ALPHA} GROUP BY ALL),
{_score('g', 'n', (3, 4), False)}, sc AS (SELECT dataset, junction_aa, coalesce(score, 0) + CASE WHEN significant THEN 2 ELSE 0 END + coalesce(n, 0) * coalesce(ks, 0) AS score
  FROM (SELECT dataset, junction_aa FROM n UNION SELECT dataset, junction_aa FROM mined) LEFT JOIN n USING (dataset, junction_aa)
  LEFT JOIN g USING (dataset, junction_aa) LEFT JOIN mined USING (dataset, junction_aa)), k AS ({_top(50000)}) SELECT * FROM k WHERE {_VALID}""")
def _(t):
    r, m = t.rearrangements, t.metadata
    return rounded(ranking.rank_gain_bonus(r, m, clonotypes.mine_fisher_greater(r, m), weights(t)))


@query("rank_difference", f"""WITH {fisher_cte()}, {_WSQL}, {_files('pf_')}, {_files('nf_', 'NOT label_positive')},
pc AS (SELECT dataset, junction_aa, count(*) AS p FROM pf_ WHERE length(junction_aa) >= 8 GROUP BY ALL),
q AS (SELECT dataset, junction_aa, count(*) AS q FROM nf_ WHERE junction_aa IS NOT NULL GROUP BY ALL),
u AS (SELECT dataset, junction_aa FROM pc UNION SELECT dataset, junction_aa FROM mined WHERE direction = 'positive'),
{_score('g', 'u', (3, 4), False)}, sc AS (SELECT dataset, junction_aa, CASE WHEN direction = 'positive' THEN 2 * score ELSE 0 END
  + coalesce((p - coalesce(q, 0)) / (p + coalesce(q, 0) + 1), 0) + 0.1::DOUBLE * coalesce(ks, 0) AS score FROM u LEFT JOIN pc USING (dataset, junction_aa)
  LEFT JOIN q USING (dataset, junction_aa) LEFT JOIN g USING (dataset, junction_aa) LEFT JOIN mined USING (dataset, junction_aa)) {_top(50000)}""")
def _(t):
    r, m = t.rearrangements, t.metadata
    return rounded(ranking.rank_difference(r, m, clonotypes.mine_fisher(r, m), weights(t)))


@query("rank_freq", f"""WITH {_files('pf_')}, sc AS (SELECT dataset, junction_aa, count(*)::DOUBLE AS score FROM pf_ WHERE length(junction_aa) >= 8 AND {_ALPHA} GROUP BY ALL)
{_top(50000, "dataset, junction_aa, 'TRBV20-1' AS v_call, 'TRBJ2-7' AS j_call")}""")
def _(t):
    return rounded(ranking.rank_frequency(t.rearrangements, t.metadata))


@query("rank_distinct_kmers", f"""WITH {_files('pf_')}, d AS (SELECT DISTINCT dataset, junction_aa FROM pf_ WHERE junction_aa IS NOT NULL),
w AS (SELECT DISTINCT dataset, junction_aa, substr(upper(junction_aa), i, 4) AS kmer FROM (SELECT dataset, junction_aa, unnest(range(1, length(junction_aa) - 2)) AS i FROM d)),
sc AS (SELECT dataset, junction_aa, count(kmer) FILTER (regexp_matches(kmer, '^[ACDEFGHIKLMNPQRSTVWY]+$'))::DOUBLE AS score FROM d LEFT JOIN w USING (dataset, junction_aa) GROUP BY ALL)
{_top(50000)}""")
def _(t):
    return rounded(ranking.rank_distinct_kmers(t.rearrangements, t.metadata))


_T3 = "d3 AS (SELECT DISTINCT dataset, junction_aa, v_call, j_call FROM rearrangements WHERE junction_aa IS NOT NULL)"
_TOP3 = _top(50000, "dataset, junction_aa, v_call, j_call", "round(score, 6) DESC, junction_aa, v_call NULLS FIRST, j_call NULLS FIRST")


def _triples(table, ks, once, table_sql=""):
    return f"""WITH {_WSQL}, {table_sql}{_T3}, {_score('g', 'd3', ks, once, table)},
sc AS (SELECT d3.*, coalesce(ks, 0)::DOUBLE AS score FROM d3 LEFT JOIN g USING (dataset, junction_aa)) {_TOP3}"""


@query("rank_linear", _triples("lin", _KS, True, "lin AS (SELECT k, kmer, (weight - 48) / (1 + weight % 5) AS weight FROM imp), "))
def _(t):
    return rounded(ranking.rank_linear(t.rearrangements, coefficients(t)))


@query("rank_importance", _triples("imp", _KS, True))
def _(t):
    return rounded(ranking.rank_importance(t.rearrangements, weights(t)))


@query("rank_occurrence", _triples("imp", (3,), False))
def _(t):
    return rounded(ranking.rank_occurrence(t.rearrangements, weights(t)))


@query("rank_top1000", _triples("top", (3,), False, """top AS (SELECT k, kmer, abs(weight - 48) AS weight FROM imp WHERE k = 3
  ORDER BY abs(weight - 48) DESC, k, kmer LIMIT 1000), """))
def _(t):
    three = coefficients(t).where(F.col("k") == 3)
    return rounded(ranking.rank_top_weights(t.rearrangements, three))


@query("rank_quota", f"""WITH {_WSQL}, q AS (SELECT *, {_DRAW} AS u FROM rearrangements r WHERE EXISTS (SELECT 1 FROM imp WHERE k = 3 AND weight >= 80 AND contains(r.junction_aa, imp.kmer))),
c AS (SELECT dataset, count(*) FILTER (label_positive) AS np, count(*) FILTER (NOT label_positive) AS nn FROM q GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY dataset, label_positive ORDER BY u, {_LAST})::INT AS rank FROM q)
SELECT dataset, repertoire_id, label_positive, junction_aa, v_call, j_call, rank FROM k JOIN c USING (dataset)
WHERE rank <= CASE WHEN label_positive THEN least(35000, np) ELSE least(50000 - least(35000, np), nn) END""")
def _(t):
    important = weights(t, (3,)).where(F.col("weight") >= 80)
    key = ["row_order", "junction_aa", "v_call", "j_call", "templates"]
    return ranking.rank_quota(t.rearrangements, important, key, k=50000)


@query("rank_quota_sizes", f"""WITH {_WSQL}, q AS (SELECT dataset, label_positive, count(*) AS n FROM rearrangements r WHERE EXISTS (SELECT 1 FROM imp
  WHERE k = 3 AND weight >= 80 AND contains(r.junction_aa, imp.kmer)) GROUP BY ALL), p AS (SELECT dataset, least(35000, coalesce(max(n) FILTER (label_positive), 0)) AS tp FROM q GROUP BY ALL)
SELECT dataset, label_positive, CASE WHEN label_positive THEN least(35000, n) ELSE least(50000 - tp, n) END AS n FROM q JOIN p USING (dataset)""")
def _(t):
    important = weights(t, (3,)).where(F.col("weight") >= 80)
    key = ["row_order", "junction_aa", "v_call", "j_call", "templates"]
    return (ranking.rank_quota(t.rearrangements, important, key, k=50000).groupBy("dataset", "label_positive")
            .agg(F.count(F.lit(1)).alias("n")))


_SO = "repertoire_id, row_order, v_call NULLS FIRST, j_call NULLS FIRST"


@query("rank_weighted_freq", f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {_SO}) AS o FROM rearrangements WHERE junction_aa IS NOT NULL),
sc AS (SELECT dataset, junction_aa, sum(CASE WHEN label_positive THEN 2.0 ELSE 0.5 END)::DOUBLE AS score, count(*) AS count,
  coalesce(arg_min(v_call, o) FILTER (v_call <> ''), 'TRBV20-1') AS v_call, coalesce(arg_min(j_call, o) FILTER (j_call <> ''), 'TRBJ2-7') AS j_call FROM f GROUP BY ALL)
{_top(50000, 'dataset, junction_aa, count, v_call, j_call', 'score DESC, count DESC, junction_aa')}""")
def _(t):
    return rounded(ranking.rank_weighted_frequency(t.rearrangements))


@query("rank_first_seen", """WITH f AS (SELECT *, row_number() OVER (PARTITION BY dataset, junction_aa ORDER BY NOT label_positive, repertoire_id, row_order,
  v_call NULLS FIRST, j_call NULLS FIRST) AS o FROM rearrangements WHERE length(junction_aa) > 0)
SELECT dataset, junction_aa, coalesce(v_call, '-999.0') AS v_call, coalesce(j_call, '-999.0') AS j_call, row_number() OVER (PARTITION BY dataset
  ORDER BY NOT label_positive, repertoire_id, row_order, junction_aa)::INT AS rank FROM f WHERE o = 1 QUALIFY rank <= 50000""")
def _(t):
    return ranking.rank_first_seen(t.rearrangements)


@query("rank_attention", f"""WITH w AS (SELECT dataset, junction_aa, templates / sum(templates) OVER (PARTITION BY dataset, repertoire_id) AS weight, label_positive
  FROM rearrangements WHERE junction_aa IS NOT NULL AND templates IS NOT NULL),
sc AS (SELECT dataset, junction_aa, sum(weight) AS score FROM w WHERE label_positive GROUP BY ALL) {_top(50000)}""")
def _(t):
    r = t.rearrangements.where(F.col("junction_aa").isNotNull() & F.col("templates").isNotNull())
    mass = r.groupBy(*REP).agg(F.sum("templates").alias("mass"))
    w = r.groupBy(*REP, "label_positive", "junction_aa").agg(F.sum("templates").alias("t")).join(mass, REP)
    return rounded(ranking.rank_attention(w.withColumn("weight", F.col("t") / F.col("mass"))))


_LOOK = f"""{_files('a_')}, {_files('b_', 'TRUE')},
x AS (SELECT dataset, junction_aa, v_call, j_call, 0 AS late, repertoire_id, row_order FROM a_ UNION ALL
  SELECT dataset, junction_aa, v_call, j_call, 1, repertoire_id, row_order FROM b_),
vj AS (SELECT dataset, junction_aa, v_call, j_call FROM x SEMI JOIN mined USING (dataset, junction_aa) WHERE v_call <> ''
  QUALIFY row_number() OVER (PARTITION BY dataset, junction_aa ORDER BY late, repertoire_id, row_order, v_call, j_call) = 1)"""


@query("vj_lookup", f"WITH {fisher_cte()}, {_LOOK} SELECT * FROM vj")
def _(t):
    r, m = t.rearrangements, t.metadata
    return ranking.vj_lookup(clonotypes.mine_fisher(r, m), r, m)


_RANKED = f"k AS (SELECT dataset, junction_aa, row_number() OVER (PARTITION BY dataset ORDER BY {_ORDER})::INT AS rank FROM mined)"


def _ranked_mined(t):
    r, m = t.rearrangements, t.metadata
    return ranking._ranked(clonotypes.mine_enriched(r, m).select("dataset", "junction_aa", "score"), 50000).drop("score")


_GRID = "g AS (SELECT dataset, unnest(range(1, 50001))::INT AS rank FROM (SELECT DISTINCT dataset FROM metadata))"


@query("pad_topk", f"WITH {enriched_cte()}, {_RANKED}, {_GRID} SELECT g.dataset, g.rank, coalesce(junction_aa, 'CASSXXXXF') AS junction_aa FROM g LEFT JOIN k USING (dataset, rank)")
def _(t):
    return ranking.pad_top_k(_ranked_mined(t), t.metadata, 50000)


@query("pad_topk_variable", f"""WITH {enriched_cte()}, {_RANKED}, {_GRID} SELECT g.dataset, g.rank,
coalesce(junction_aa, 'CASS' || repeat('X', (g.rank - 1) % 10 + 5) || 'F') AS junction_aa FROM g LEFT JOIN k USING (dataset, rank)""")
def _(t):
    return ranking.pad_variable(_ranked_mined(t), t.metadata, 50000)


@query("rank_ids", f"WITH {enriched_cte()}, {_RANKED} SELECT dataset, junction_aa, rank, dataset || '_seq_top_' || rank AS ID FROM k")
def _(t):
    return ranking.with_ids(_ranked_mined(t))


@query("repair_seqs", """SELECT DISTINCT dataset, CASE WHEN NOT regexp_matches(s, '^[ACDEFGHIKLMNPQRSTVWY]+$') AND s <> '-999.0' THEN 'CASSXXXXF' ELSE s END AS junction_aa
FROM (SELECT dataset, coalesce(junction_aa, '-999.0') AS s FROM rearrangements)""")
def _(t):
    rows = t.rearrangements.select("dataset", F.coalesce("junction_aa", F.lit("-999.0")).alias("junction_aa"))
    return ranking.repair_sequences(rows).distinct()


@query("distinct_rearr", "SELECT DISTINCT dataset, junction_aa, v_call, j_call FROM rearrangements WHERE junction_aa IS NOT NULL")
def _(t):
    return ranking.distinct_rearrangements(t.rearrangements)


@query("sequence_rows", f"""WITH {fisher_cte()}, {_LOOK}, k AS (SELECT dataset, junction_aa, row_number() OVER (PARTITION BY dataset ORDER BY {_ORDER})::INT AS rank FROM mined),
g AS (SELECT dataset, unnest(range(1, 50001))::INT AS rank FROM (SELECT DISTINCT dataset FROM metadata)),
row_ AS (SELECT g.dataset, g.rank, k.junction_aa, v_call, j_call FROM g LEFT JOIN k USING (dataset, rank) LEFT JOIN vj ON vj.dataset = k.dataset AND vj.junction_aa = k.junction_aa)
SELECT dataset || '_seq_top_' || rank AS ID, dataset, -999.0::DOUBLE AS label_positive_probability, coalesce(junction_aa, 'CASSXXXXF') AS junction_aa,
coalesce(nullif(v_call, ''), '-999.0') AS v_call, coalesce(nullif(j_call, ''), '-999.0') AS j_call FROM row_""")
def _(t):
    r, m = t.rearrangements, t.metadata
    mined = clonotypes.mine_fisher(r, m)
    ranked = ranking._ranked(mined.select("dataset", "junction_aa", "score"), 50000)
    return ranking.sequence_rows(ranked, ranking.vj_lookup(mined, r, m), m, k=50000)
