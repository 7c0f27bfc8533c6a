"""Registered queries on shared and enriched sequences, and on sampling."""

from pyspark.sql import functions as F

from clonara.constants import REP
from clonara.operators import clonotypes, sampling
from clonara.operators.model import stratified_folds
from clonara.plans.profile_queries import rounded
from clonara.plans.registry import query

_PRES = """p AS (SELECT DISTINCT dataset, repertoire_id, label_positive, junction_aa FROM rearrangements WHERE junction_aa IS NOT NULL)"""
_SEQ = f"""{_PRES}, s AS (SELECT dataset, junction_aa, count(*) AS n, count(*) FILTER (label_positive) AS d FROM p GROUP BY ALL)"""


@query("public_set", f"WITH {_PRES} SELECT dataset, junction_aa, count(*) AS n_repertoires FROM p GROUP BY ALL HAVING count(*) >= 2")
def _(t):
    return clonotypes.public_sequences(t.rearrangements)


@query("disease_enrichment", f"WITH {_SEQ} SELECT dataset, junction_aa, round(d / (n + 1e-6), 6) AS enrichment FROM s WHERE n >= 5")
def _(t):
    return rounded(clonotypes.disease_enrichment(t.rearrangements))


@query("public_features", f"""WITH {_SEQ}, e AS (SELECT dataset, junction_aa, CASE WHEN n >= 5 THEN d / (n + 1e-6) END AS e FROM s WHERE n >= 2),
u AS (SELECT dataset, repertoire_id, count(*) AS u, count(e.junction_aa) AS n, count(*) FILTER (e.e > 0.6) AS ne, avg(e.e) AS av, max(e.e) AS mx
  FROM p LEFT JOIN e USING (dataset, junction_aa) GROUP BY ALL),
w AS (SELECT dataset, repertoire_id, sum(templates) AS t, sum(CASE WHEN e.junction_aa IS NOT NULL THEN templates END) AS pt
  FROM rearrangements LEFT JOIN e USING (dataset, junction_aa) GROUP BY ALL)
SELECT dataset, repertoire_id, coalesce(n, 0) AS n_public, round(coalesce(n / greatest(u, 1), 0), 6)::DOUBLE AS frac_public,
coalesce(ne, 0) AS n_disease_enriched, round(coalesce(av, 0), 6)::DOUBLE AS avg_disease_enrichment, round(coalesce(mx, 0), 6)::DOUBLE AS max_disease_enrichment,
round(coalesce(pt, 0) / greatest(t, 1), 6)::DOUBLE AS public_template_fraction FROM w LEFT JOIN u USING (dataset, repertoire_id)""")
def _(t):
    r = t.rearrangements
    return rounded(clonotypes.PublicClones().fit(r).transform(r))


@query("public_stats", f"""WITH {_SEQ} SELECT dataset, count(*) AS n_public, count(*) FILTER (n >= 5 AND d / (n + 1e-6) > 0.6) AS n_disease_enriched,
count(*) FILTER (n >= 5 AND d / (n + 1e-6) < 0.4) AS n_healthy_enriched FROM s WHERE n >= 2 GROUP BY ALL""")
def _(t):
    return clonotypes.PublicClones().fit(t.rearrangements).stats()


@query("public_ranked", f"""WITH {_SEQ} SELECT dataset, junction_aa, round(d / (n + 1e-6), 6) AS enrichment,
row_number() OVER (PARTITION BY dataset ORDER BY d / (n + 1e-6) DESC, junction_aa)::INT AS rank FROM s WHERE n >= 5 QUALIFY rank <= 50000""")
def _(t):
    return rounded(clonotypes.PublicClones().fit(t.rearrangements).ranked())


def _counts(p=""):
    return f"""{p}m AS (SELECT dataset, repertoire_id, label_positive FROM metadata),
{p}z AS (SELECT dataset, count(*) FILTER (label_positive) AS n_pos, count(*) FILTER (NOT label_positive) AS n_neg FROM {p}m GROUP BY ALL),
{p}p AS (SELECT DISTINCT r.dataset, r.repertoire_id, m.label_positive, r.junction_aa FROM rearrangements r
  JOIN {p}m m ON m.dataset = r.dataset AND m.repertoire_id = r.repertoire_id WHERE r.junction_aa IS NOT NULL),
{p}c AS (SELECT dataset, junction_aa, count(*) FILTER (label_positive) AS a, count(*) FILTER (NOT label_positive) AS c FROM {p}p GROUP BY ALL),
{p}f AS (SELECT *, a / greatest(n_pos, 1) AS pf, c / greatest(n_neg, 1) AS nf FROM {p}c JOIN {p}z USING (dataset))"""


def _enriched(p=""):
    return f"""{_counts(p)}, {p}mined AS (SELECT dataset, junction_aa, ln((pf + 1e-6) / (nf + 1e-6)) AS score, pf AS pos_freq, nf AS neg_freq
  FROM {p}f WHERE a > 0 AND pf >= 0.15 AND pf > nf * 5.0::DOUBLE)"""


def _fisher(where, tail, p="", alternative="two-sided"):
    lf = lambda x: f"lgamma(({x}) + 1)"
    ch = lambda n, x: f"({lf(n)} - {lf(x)} - {lf(f'{n} - ({x})')})"
    lp = lambda x: f"({ch('n_pos', x)} + {ch('n_neg', f'a + c - ({x})')} - {ch('(n_pos + n_neg)', 'a + c')})"
    pv = (f"list_sum(list_transform(list_filter(range(greatest(0, a + c - n_neg), least(n_pos, a + c) + 1), lambda x: {lp('x')} <= {lp('a')} + 1e-7), lambda x: exp({lp('x')})))"
          if alternative == "two-sided" else f"list_sum(list_transform(range(a, least(n_pos, a + c) + 1), lambda x: exp({lp('x')})))")
    empty = "(n_pos = 0 OR n_neg = 0 OR a + c = 0 OR a + c = n_pos + n_neg)"
    return f"""{_counts(p)}, {p}t AS (SELECT *, CASE WHEN {empty} THEN 'nan'::DOUBLE WHEN n_pos - a > 0 AND c > 0
  THEN a * (n_neg - c) / ((n_pos - a) * c) ELSE 'inf'::DOUBLE END AS odds_ratio, CASE WHEN {empty} THEN 1.0 ELSE least({pv}, 1.0) END AS p_value
  FROM {p}f WHERE {where}), {p}mined AS (SELECT dataset, junction_aa, {tail})"""


_TWO = ("length(junction_aa) >= 8 AND (pf >= 0.1 OR nf >= 0.1)",
        """-log10(p_value + 1e-10) * sign(CASE WHEN isinf(odds_ratio) THEN 1 ELSE ln(odds_ratio + 1e-10) END) AS score, p_value, odds_ratio, pf AS pos_freq,
  nf AS neg_freq, CASE WHEN odds_ratio > 1 THEN 'positive' ELSE 'negative' END AS direction FROM {p}t WHERE round(p_value, 9) < 0.01::DOUBLE AND NOT isnan(odds_ratio)""")
_GREATER = ("a > 0 AND pf >= 0.05 AND (nf = 0 OR pf > nf * 3.0::DOUBLE)",
            """ln((pf + 1e-6) / (nf + 1e-6)) + CASE WHEN round(p_value, 9) < 0.1::DOUBLE THEN 1 ELSE 0 END AS score, pf AS pos_freq, nf AS neg_freq, p_value, round(p_value, 9) < 0.1::DOUBLE AS significant
  FROM {p}t""")


def fisher_cte(p=""):
    return _fisher(_TWO[0], _TWO[1].format(p=p), p)


def greater_cte(p=""):
    return _fisher(_GREATER[0], _GREATER[1].format(p=p), p, "greater")


enriched_cte = _enriched


@query("mine_enriched", f"WITH {_enriched()} SELECT dataset, junction_aa, round(score, 6) AS score, round(pos_freq, 6) AS pos_freq, round(neg_freq, 6) AS neg_freq FROM mined")
def _(t):
    return rounded(clonotypes.mine_enriched(t.rearrangements, t.metadata))


FOLD_IDS = """h AS (SELECT dataset, repertoire_id, label_positive, ('0x' || substr(md5(concat_ws('|', '42', dataset, repertoire_id)), 1, 12))::BIGINT AS h FROM metadata),
n AS (SELECT dataset, least(5, greatest(2, least(count(*) FILTER (label_positive), count(*) FILTER (NOT label_positive)))) AS n FROM metadata GROUP BY ALL),
folds AS (SELECT dataset, repertoire_id, label_positive, ((row_number() OVER (PARTITION BY dataset, label_positive ORDER BY h, repertoire_id) - 1) % n)::INT AS fold FROM h JOIN n USING (dataset))"""


@query("mine_by_fold", f"""WITH {FOLD_IDS}, held AS (SELECT DISTINCT dataset, fold FROM folds),
seen AS (SELECT h.dataset, h.fold, f.repertoire_id, f.label_positive FROM held h JOIN folds f ON f.dataset = h.dataset WHERE f.fold <> h.fold),
sizes AS (SELECT dataset, fold, count(*) FILTER (label_positive) AS n_pos, count(*) FILTER (NOT label_positive) AS n_neg FROM seen GROUP BY ALL),
p AS (SELECT DISTINCT dataset, repertoire_id, junction_aa FROM rearrangements WHERE junction_aa IS NOT NULL),
c AS (SELECT dataset, fold, junction_aa, count(*) FILTER (label_positive) AS a, count(*) FILTER (NOT label_positive) AS b FROM p JOIN seen USING (dataset, repertoire_id) GROUP BY ALL),
r AS (SELECT dataset, fold, junction_aa, a, a::DOUBLE / greatest(n_pos, 1) AS pf, b::DOUBLE / greatest(n_neg, 1) AS nf FROM c JOIN sizes USING (dataset, fold))
SELECT dataset, fold, junction_aa, round(ln((pf + 1e-6) / (nf + 1e-6)), 6) AS score, round(pf, 6) AS pos_freq, round(nf, 6) AS neg_freq FROM r WHERE a > 0 AND pf >= 0.15 AND pf > nf * 5.0::DOUBLE""")
def _(t):
    return rounded(clonotypes.mine_by_fold(t.rearrangements, stratified_folds(t.metadata, 5, 42, ["dataset"])))


@query("mine_enriched_all", f"WITH {_enriched()} SELECT dataset, junction_aa, round(score, 6) AS score, round(pos_freq, 6) AS pos_freq, round(neg_freq, 6) AS neg_freq FROM mined")
def _(t):
    return rounded(clonotypes.mine_enriched(t.rearrangements, t.metadata))


@query("mine_fisher", f"""WITH {fisher_cte()} SELECT dataset, junction_aa, round(score, 6) AS score, round(p_value, 6) AS p_value,
round(odds_ratio, 6) AS odds_ratio, round(pos_freq, 6) AS pos_freq, round(neg_freq, 6) AS neg_freq, direction FROM mined""")
def _(t):
    return rounded(clonotypes.mine_fisher(t.rearrangements, t.metadata))


@query("mine_fisher_greater", f"""WITH {greater_cte()} SELECT dataset, junction_aa, round(score, 6) AS score, round(p_value, 6) AS p_value,
round(pos_freq, 6) AS pos_freq, round(neg_freq, 6) AS neg_freq, significant FROM mined""")
def _(t):
    return rounded(clonotypes.mine_fisher_greater(t.rearrangements, t.metadata))


_T = lambda v, d: f"CASE coalesce(TRY_CAST(nullif(regexp_extract(dataset, '(^|[_ ])([0-9]+)([_ ]|$)', 2), '') AS INT), 1) WHEN 7 THEN {v[0]} WHEN 8 THEN {v[1]} ELSE {d} END"


_BY_DATASET = f"""{_counts()}, mined AS (SELECT dataset, junction_aa, ln((pf + 1e-6) / (nf + 1e-6)) AS score, pf, nf FROM f
WHERE a > 0 AND length(junction_aa) >= 8 AND regexp_matches(junction_aa, '^[A-Za-z]+$')
AND pf >= {_T((0.10, 0.12), 0.15)} AND pf > nf * ({_T((3.0, 4.0), 5.0)})::DOUBLE)"""


@query("mine_by_dataset", f"""WITH {_BY_DATASET} SELECT dataset, junction_aa, round(score, 6) AS score, round(pf, 6) AS pos_freq, round(nf, 6) AS neg_freq FROM mined
QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY mined.score DESC, junction_aa) <= {_T((6000, 4000), 2500)}""")
def _(t):
    return rounded(clonotypes.mine_by_dataset(t.rearrangements, t.metadata, limited=True))


_HITS = """h AS (SELECT r.*, {cols} FROM (SELECT DISTINCT dataset, repertoire_id, CASE WHEN regexp_matches(junction_aa, '^[A-Za-z]+$') THEN junction_aa END AS junction_aa
  FROM rearrangements) r LEFT JOIN mined USING (dataset, junction_aa))"""
_Z = lambda e, n: f"round(coalesce({e}, 0), 6)::DOUBLE AS {n}"
_RATIO = _Z("count(score) / nullif(count(junction_aa), 0)", "pub_hit_ratio")


def _hits_sql(mined):
    return f"""WITH {mined}, {_HITS.format(cols='score')} SELECT dataset, repertoire_id, {_Z('sum(score)', 'pub_score_sum')},
{_Z('max(score)', 'pub_score_max')}, count(score)::DOUBLE AS pub_hits, {_RATIO} FROM h GROUP BY ALL"""


def hits_by_dataset():
    return _hits_sql(_BY_DATASET)


@query("public_hits", _hits_sql(_enriched()))
def _(t):
    return rounded(clonotypes.public_hits(t.rearrangements, clonotypes.mine_enriched(t.rearrangements, t.metadata)))


_PS, _NS = "CASE WHEN direction = 'positive' THEN score END", "CASE WHEN direction = 'negative' THEN score END"


@query("public_hits_signed", f"""WITH {fisher_cte()}, {_HITS.format(cols='score, direction')} SELECT dataset, repertoire_id,
{_Z(f'sum({_PS})', 'pub_pos_score_sum')}, {_Z(f'max({_PS})', 'pub_pos_score_max')}, count({_PS})::DOUBLE AS pub_pos_hits,
{_Z(f'sum({_NS})', 'pub_neg_score_sum')}, {_Z(f'min({_NS})', 'pub_neg_score_max')}, count({_NS})::DOUBLE AS pub_neg_hits,
{_Z(f'coalesce(sum({_PS}), 0) - abs(coalesce(sum({_NS}), 0))', 'pub_net_score')}, {_RATIO} FROM h GROUP BY ALL""")
def _(t):
    return rounded(clonotypes.public_hits_signed(t.rearrangements, clonotypes.mine_fisher(t.rearrangements, t.metadata)))


_SIG = "CASE WHEN significant THEN score END"


@query("public_hits_sig", f"""WITH {greater_cte()}, {_HITS.format(cols='score, significant')} SELECT dataset, repertoire_id, {_Z('sum(score)', 'pub_score_sum')},
{_Z('max(score)', 'pub_score_max')}, count(score)::DOUBLE AS pub_hits, {_RATIO}, count({_SIG})::DOUBLE AS pub_sig_hits,
{_Z(f'sum({_SIG})', 'pub_sig_score_sum')} FROM h GROUP BY ALL""")
def _(t):
    return rounded(clonotypes.public_hits_significant(t.rearrangements, clonotypes.mine_fisher_greater(t.rearrangements, t.metadata)))


@query("miner_overlap", f"""WITH {_enriched('x_')}, {fisher_cte('y_')},
j AS (SELECT coalesce(a.dataset, b.dataset) AS dataset, a.junction_aa IS NOT NULL AS ia, b.junction_aa IS NOT NULL AS ib
  FROM x_mined a FULL JOIN y_mined b ON a.dataset = b.dataset AND a.junction_aa = b.junction_aa),
g AS (SELECT dataset, count(*) FILTER (ia) AS a_count, count(*) FILTER (ib) AS b_count, count(*) FILTER (ia AND ib) AS o,
  count(*) FILTER (ia AND NOT ib) AS ao, count(*) FILTER (ib AND NOT ia) AS bo FROM j GROUP BY ALL),
q AS (SELECT dataset, a_count, b_count, CASE WHEN a_count > 0 AND b_count > 0 THEN o / (o + ao + bo) ELSE 0 END AS jaccard,
  CASE WHEN a_count > 0 AND b_count > 0 THEN o ELSE 0 END AS overlap, CASE WHEN a_count > 0 AND b_count > 0 THEN ao ELSE 0 END AS a_only,
  CASE WHEN a_count > 0 AND b_count > 0 THEN bo ELSE 0 END AS b_only FROM g)
SELECT dataset, a_count, b_count, round(jaccard, 6)::DOUBLE AS jaccard, overlap, a_only, b_only FROM q UNION ALL
SELECT 'overall', sum(a_count)::BIGINT, sum(b_count)::BIGINT, round(avg(jaccard) FILTER (jaccard > 0), 6)::DOUBLE, sum(overlap)::BIGINT,
sum(a_only)::BIGINT, sum(b_only)::BIGINT FROM q""")
def _(t):
    a = clonotypes.mine_enriched(t.rearrangements, t.metadata)
    b = clonotypes.mine_fisher(t.rearrangements, t.metadata)
    return rounded(clonotypes.miner_overlap(a, b))


_CC = "c AS (SELECT dataset, label_positive, junction_aa, count(*) AS n FROM rearrangements WHERE junction_aa IS NOT NULL GROUP BY ALL)"


@query("clonotype_counts", f"""WITH {_CC} SELECT dataset, label_positive, count(*) AS n_unique, count(*) FILTER (n >= 5) AS n_frequent,
sum(n)::BIGINT AS n_rows FROM c GROUP BY ALL""")
def _(t):
    return clonotypes.clonotype_counts(t.rearrangements)


@query("clonotype_top", f"""WITH {_CC} SELECT dataset, label_positive, junction_aa, n FROM c WHERE n >= 5
QUALIFY row_number() OVER (PARTITION BY dataset, label_positive ORDER BY n DESC, junction_aa) <= 20""")
def _(t):
    return clonotypes.clonotype_top(t.rearrangements)


@query("shared_seqs", """SELECT dataset, junction_aa FROM rearrangements WHERE label_positive AND junction_aa IS NOT NULL
INTERSECT SELECT dataset, junction_aa FROM rearrangements WHERE NOT label_positive AND junction_aa IS NOT NULL""")
def _(t):
    return clonotypes.shared_sequences(t.rearrangements)


@query("shared_words", """SELECT dataset, junction_aa FROM word_bags WHERE label_positive
INTERSECT SELECT dataset, junction_aa FROM word_bags WHERE NOT label_positive""")
def _(t):
    return clonotypes.shared_sequences(t.word_bags)


# ---- sampling ----------------------------------------------------------------------

_KEY = ["row_order", "junction_aa", "v_call", "j_call", "templates"]


_DRAW = """(('0x' || substr(md5(concat_ws('|', '42', dataset, repertoire_id, row_order, junction_aa, v_call, j_call, templates)), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656"""
_LAST = "row_order NULLS FIRST, junction_aa NULLS FIRST, v_call NULLS FIRST, j_call NULLS FIRST, templates NULLS FIRST"


def _drawn(order, n):
    return f"""WITH u AS (SELECT *, {_DRAW} AS u, coalesce(templates, 1.0::DOUBLE) AS w FROM rearrangements),
z AS (SELECT *, CASE WHEN w > 0 THEN -ln(u) / w ELSE 'inf'::DOUBLE END AS wait FROM u)
SELECT * EXCLUDE (u, w, wait, row_order) FROM z QUALIFY row_number() OVER (PARTITION BY dataset, repertoire_id ORDER BY {order}, {_LAST}) <= {n}"""


@query("weighted_sample", _drawn("wait, u", 200))
def _(t):
    return sampling.weighted_sample(t.rearrangements, 200, _KEY).drop("row_order")


@query("weighted_sample_sizes", "SELECT dataset, repertoire_id, least(count(*), 2000) AS n FROM rearrangements GROUP BY ALL")
def _(t):
    return sampling.weighted_sample(t.rearrangements, 2000, _KEY).groupBy(*REP).agg(F.count(F.lit(1)).alias("n"))


@query("uniform_sample", _drawn("u", 200))
def _(t):
    return sampling.uniform_sample(t.rearrangements, 200, _KEY).drop("row_order")


@query("uniform_sample_sizes", "SELECT dataset, repertoire_id, least(count(*), 200) AS n FROM rearrangements GROUP BY ALL")
def _(t):
    return sampling.uniform_sample(t.rearrangements, 200, _KEY).groupBy(*REP).agg(F.count(F.lit(1)).alias("n"))


@query("topk", """SELECT junction_aa, count(*) AS n FROM rearrangements WHERE junction_aa IS NOT NULL GROUP BY ALL
ORDER BY n DESC, junction_aa LIMIT 100""")
def _(t):
    counts = t.rearrangements.where(F.col("junction_aa").isNotNull()).groupBy("junction_aa").agg(F.count(F.lit(1)).alias("n"))
    return sampling.top_rows(counts, 100, [F.desc("n"), F.asc("junction_aa")])
