"""Registered gene usage, diversity, length and physico-chemistry queries."""

from pyspark.sql import functions as F

from clonara.constants import AMINO_ACIDS, ATCHLEY, ATCHLEY_NAMES, CHARGE, HYDROPATHY, REP, VOLUME
from clonara.operators import diversity, genes, lengths
from clonara.plans.registry import query


def rounded(df, digits=6):
    """Round every floating column."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- genes -------------------------------------------------------------------------

_NORM = "coalesce(trim(split_part({c}, '*', 1)), 'UNKNOWN')"
_V, _J = _NORM.format(c="v_call"), _NORM.format(c="j_call")
_FAM = "coalesce(nullif(upper(split_part(split_part({c}, '*', 1), '-', 1)), ''), 'UNK')"
_FV, _FJ = _FAM.format(c="v_call"), _FAM.format(c="j_call")
_P = "PARTITION BY dataset, repertoire_id"


def _usage(expr, out):
    return f"""WITH g AS (SELECT dataset, repertoire_id, {expr} AS g FROM rearrangements),
    c AS (SELECT dataset, repertoire_id, g, count(*) AS n FROM g WHERE NOT contains(g, 'UNKNOWN') GROUP BY ALL)
    SELECT dataset, repertoire_id, g AS {out}, round(n / sum(n) OVER ({_P}), 6) AS value FROM c"""


@query("v_usage", _usage(_V, "gene"))
def _(t):
    return rounded(genes.usage(t.rearrangements, "v"))


@query("j_usage", _usage(_J, "gene"))
def _(t):
    return rounded(genes.usage(t.rearrangements, "j"))


_PAIR = f"{_V} || '_' || {_J}"


@query("vj_usage", f"""WITH g AS (SELECT dataset, repertoire_id, {_PAIR} AS pair FROM rearrangements),
c AS (SELECT dataset, repertoire_id, pair, count(*) AS n FROM g WHERE NOT contains(pair, 'UNKNOWN') GROUP BY ALL),
k AS (SELECT *, row_number() OVER ({_P} ORDER BY n DESC, pair) AS rn FROM c)
SELECT dataset, repertoire_id, pair, round(n / sum(n) OVER ({_P}), 6) AS value FROM k WHERE rn <= 50""")
def _(t):
    return rounded(genes.pair_usage(t.rearrangements))


_GV = f"""g AS (SELECT dataset, repertoire_id, 'v' AS kind, {_V} AS gene FROM rearrangements
  UNION ALL SELECT dataset, repertoire_id, 'j', {_J} FROM rearrangements
  UNION ALL SELECT dataset, repertoire_id, 'vj', {_PAIR} FROM rearrangements),
k AS (SELECT * FROM g WHERE NOT contains(gene, 'UNKNOWN')),
v AS (SELECT kind, gene, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, gene) AS rank
  FROM (SELECT kind, gene, count(*) AS n FROM k GROUP BY ALL)
  QUALIFY rank <= CASE kind WHEN 'v' THEN 50 WHEN 'j' THEN 15 ELSE 100 END)"""


@query("gene_vocab", f"WITH {_GV} SELECT kind, gene, n, rank::INT AS rank FROM v")
def _(t):
    return genes.gene_vocabulary(t.rearrangements)


@query("gene_transform", f"""WITH {_GV}, c AS (SELECT dataset, repertoire_id, kind, gene, count(*) AS n FROM k GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY dataset, repertoire_id, kind) AS x FROM c),
r AS (SELECT DISTINCT dataset, repertoire_id FROM rearrangements)
SELECT r.dataset, r.repertoire_id, v.kind, v.gene, round(coalesce(x, 0.0::DOUBLE), 6) AS value FROM r CROSS JOIN v LEFT JOIN s
ON s.dataset = r.dataset AND s.repertoire_id = r.repertoire_id AND s.kind = v.kind AND s.gene = v.gene""")
def _(t):
    return rounded(genes.GeneFeaturizer().fit(t.rearrangements).transform(t.rearrangements))


@query("gene_diversity", f"""WITH g AS (SELECT dataset, repertoire_id, 'v' AS kind, {_V} AS gene FROM rearrangements
  UNION ALL SELECT dataset, repertoire_id, 'j', {_J} FROM rearrangements),
c AS (SELECT dataset, repertoire_id, kind, gene, count(*) AS n FROM g WHERE gene <> 'UNKNOWN' GROUP BY ALL),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY dataset, repertoire_id, kind) AS p,
  row_number() OVER (PARTITION BY dataset, repertoire_id, kind ORDER BY n) AS i FROM c)
SELECT dataset, repertoire_id, kind, round(-sum(p * ln(p + 1e-10)), 6) AS shannon, round(1 - sum(p * p), 6) AS simpson,
round(2 * sum(i * p) / (count(*) * sum(p)) - (count(*) + 1) / count(*), 6) AS gini FROM p GROUP BY ALL""")
def _(t):
    return rounded(genes.gene_diversity(t.rearrangements))


def _ranked(parts, limits, keep="TRUE"):
    union = " UNION ALL ".join(f"SELECT dataset, repertoire_id, '{k}' AS kind, {e} AS gene FROM rearrangements" for k, e in parts.items())
    cases = " ".join(f"WHEN '{k}' THEN {n}" for k, n in limits.items())
    return f"""g AS ({union}), c AS (SELECT dataset, repertoire_id, kind, gene, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY dataset, repertoire_id, kind) AS x FROM c),
h AS (SELECT *, row_number() OVER (PARTITION BY dataset, repertoire_id, kind ORDER BY n DESC, gene) AS rn FROM s
  WHERE gene IS NOT NULL QUALIFY rn <= CASE kind {cases} END),
f AS (SELECT dataset, repertoire_id, kind || '_' || gene AS feature, round(x, 6) AS value FROM h WHERE {keep})"""


@query("family_usage", f"WITH {_ranked({'v_fam': _FV, 'j_fam': _FJ}, {'v_fam': 40, 'j_fam': 20})} SELECT * FROM f")
def _(t):
    return rounded(genes.family_usage(t.rearrangements))


@query("vj_family", f"""WITH {_ranked({'vj_pair': f"{_FV} || '_' || {_FJ}"}, {'vj_pair': 30})},
e AS (SELECT dataset, repertoire_id, count(*)::DOUBLE AS u, max(x) AS top1, sum(x + 1e-10) AS z,
  sum((x + 1e-10) * ln(x + 1e-10)) AS y FROM s GROUP BY ALL)
SELECT * FROM f UNION ALL SELECT dataset, repertoire_id, 'vj_pair_unique', u FROM e
UNION ALL SELECT dataset, repertoire_id, 'vj_pair_entropy', round(ln(z) - y / z, 6) FROM e
UNION ALL SELECT dataset, repertoire_id, 'vj_pair_top1', round(top1, 6) FROM e""")
def _(t):
    return rounded(genes.family_pairs(t.rearrangements))


_RAW = {"v_usage": "v_call", "j_usage": "j_call",
        "vj_pair": "translate(v_call, '*/', '__') || '_' || translate(j_call, '*/', '__')"}


@query("raw_usage", f"WITH {_ranked(_RAW, {'v_usage': 20, 'j_usage': 20, 'vj_pair': 50})} SELECT * FROM f")
def _(t):
    return rounded(genes.raw_usage(t.rearrangements))


@query("raw_usage50", f"""WITH {_ranked({'v': 'v_call', 'j': 'j_call', 'vj': "coalesce(v_call, 'nan') || '_' || coalesce(j_call, 'nan')"},
{'v': 50, 'j': 50, 'vj': 50})} SELECT * FROM f""")
def _(t):
    return rounded(genes.raw_usage_pairs(t.rearrangements))


_ALT = "CASE WHEN {c} IN ('', 'nan', '-999.0') THEN NULL WHEN contains({c}, '-') THEN split_part({c}, '-', 1) ELSE split_part({c}, '/', 1) END"
_AV, _AJ = _ALT.format(c="v_call"), _ALT.format(c="j_call")


@query("family_pair_usage", f"""WITH g AS (SELECT dataset, repertoire_id, 'v' AS kind, {_AV} AS gene FROM rearrangements
  UNION ALL SELECT dataset, repertoire_id, 'j', {_AJ} FROM rearrangements
  UNION ALL SELECT dataset, repertoire_id, 'vj', {_AV} || '_' || {_AJ} FROM rearrangements),
c AS (SELECT dataset, repertoire_id, kind, gene, count(*) AS n FROM g WHERE gene IS NOT NULL GROUP BY ALL)
SELECT dataset, repertoire_id, kind || '_' || gene AS feature,
round(n / sum(n) OVER (PARTITION BY dataset, repertoire_id, kind), 6) AS value FROM c""")
def _(t):
    return rounded(genes.family_pair_usage(t.rearrangements))


@query("raw_usage_k3", f"WITH {_ranked({'v': 'v_call', 'j': 'j_call'}, {'v': 20, 'j': 20})} SELECT * FROM f")
def _(t):
    return rounded(genes.top_calls(t.rearrangements))


# ---- diversity ---------------------------------------------------------------------


def _clones(rows, rest, total="sum(x) OVER ({p})".format(p=_P)):
    """SQL over one row per clone (x = its size): sums by sorting the clones themselves."""
    return f"""WITH x AS ({rows}), r AS (SELECT DISTINCT dataset, repertoire_id FROM rearrangements),
y AS (SELECT *, {total} AS t, sum(x) OVER ({_P}) AS s, count(*) OVER ({_P}) AS n,
  row_number() OVER ({_P} ORDER BY x) AS i, row_number() OVER ({_P} ORDER BY x DESC) AS d,
  sum(x) OVER ({_P} ORDER BY x DESC ROWS UNBOUNDED PRECEDING) AS cum FROM x),
a AS (SELECT dataset, repertoire_id, any_value(n) AS n, any_value(s) AS s,
  -sum(CASE WHEN x > 0 THEN x / s * ln(x / s) ELSE 0 END) AS h, 1 - sum((x / t) * (x / t)) AS gs,
  2 * sum(i * x) / (any_value(n) * any_value(s)) - (any_value(n) + 1) / any_value(n) AS g,
  coalesce(min(CASE WHEN 2 * cum >= t THEN d END), any_value(n) + 1) AS half,
  sum(CASE WHEN 2 * cum <= t THEN 1 ELSE 0 END) AS below,
  max(x) / any_value(s) AS top1, sum(CASE WHEN d <= 10 THEN x ELSE 0 END) / any_value(s) AS top10,
  -sum(x / s * ln(x / s + 1e-10)) AS he, sum(x / s + 1e-10) AS z, sum((x / s + 1e-10) * ln(x / s + 1e-10)) AS zz
  FROM y GROUP BY dataset, repertoire_id)
{rest}"""


_TEMPLATES = "SELECT dataset, repertoire_id, templates AS x FROM rearrangements WHERE templates > 0"
_COERCED = "SELECT dataset, repertoire_id, coalesce(templates, 1.0)::DOUBLE AS x FROM rearrangements"
_MULTI = "SELECT dataset, repertoire_id, count(*)::DOUBLE AS x FROM rearrangements WHERE junction_aa IS NOT NULL GROUP BY dataset, repertoire_id, junction_aa"
_SET = {"shannon": "h / ln(2)", "gini": "CASE WHEN n = 1 THEN 1.0 ELSE g END", "simpson": "gs", "d50": "half / n",
        "clonality": "CASE WHEN n = 1 THEN 1.0 ELSE 1 - h / ln(n) END"}


def _index_query(name):
    @query(name, _clones(_TEMPLATES, f"SELECT dataset, repertoire_id, round(coalesce({_SET[name]}, 0), 6)::DOUBLE AS {name} FROM r LEFT JOIN a USING (dataset, repertoire_id)"))
    def _(t):
        return rounded(diversity.index(t.rearrangements, name))


for _name in _SET:
    _index_query(_name)

_ALL = """SELECT dataset, repertoire_id, round(coalesce(h / ln(2), 0), 6)::DOUBLE AS shannon_entropy,
round(coalesce(CASE WHEN n = 1 THEN 1.0 ELSE g END, 0), 6)::DOUBLE AS gini_coefficient, round(coalesce(gs, 0), 6)::DOUBLE AS simpson_index,
round(coalesce(half / n, 0), 6)::DOUBLE AS d50_index, round(coalesce(CASE WHEN n = 1 THEN 1.0 ELSE 1 - h / ln(n) END, 0), 6)::DOUBLE AS clonality,
coalesce(n, 0)::DOUBLE AS n_unique_clones, round(coalesce(top1, 0), 6)::DOUBLE AS top_clone_fraction,
round(coalesce(top10, 0), 6)::DOUBLE AS top10_clone_fraction FROM r LEFT JOIN a USING (dataset, repertoire_id)"""


@query("diversity_all", _clones(_TEMPLATES, _ALL))
def _(t):
    return rounded(diversity.diversity_set(t.rearrangements))


@query("diversity_all_sequences", _clones(_MULTI, _ALL))
def _(t):
    return rounded(diversity.diversity_set(t.rearrangements, "sequence"))


@query("clone_size", _clones(_COERCED, """SELECT dataset, repertoire_id, round(ln(z) - zz / z, 6) AS clone_entropy,
round(gs, 6) AS clone_gini, round(top1, 6) AS clone_max_freq FROM a WHERE s > 0"""))
def _(t):
    return rounded(diversity.clone_size(t.rearrangements))


@query("clone_size_extended", _clones(_COERCED, """SELECT dataset, repertoire_id, round(he / ln(2), 6) AS shannon, round(1 - gs, 6) AS simpson,
round(greatest(0, g), 6)::DOUBLE AS gini, round(half / n, 6) AS d50,
round(1 - he / ln(2) / CASE WHEN n > 1 THEN log2(n) ELSE 1 END, 6) AS clonality, n::DOUBLE AS richness FROM a"""))
def _(t):
    return rounded(diversity.clone_size_extended(t.rearrangements))


@query("seq_diversity", _clones(_MULTI, """SELECT dataset, repertoire_id, round(coalesce(he, 0), 6) AS shannon, round(coalesce(gs, 0), 6) AS gini_simpson,
round(coalesce(1 - he / CASE WHEN n > 1 THEN ln(n) ELSE 1 END, 0), 6) AS clonality, round(coalesce(half / n, 0), 6) AS d50,
coalesce(n, 0) AS richness, round(coalesce(ln(1 + n), 0), 6) AS richness_log FROM r LEFT JOIN a USING (dataset, repertoire_id)"""))
def _(t):
    return rounded(diversity.sequence_diversity(t.rearrangements))


@query("seq_clonality", _clones(
    "SELECT dataset, repertoire_id, x, rows FROM (" + _MULTI + ") JOIN (SELECT dataset, repertoire_id, count(*) AS rows FROM rearrangements GROUP BY ALL) USING (dataset, repertoire_id)",
    """SELECT dataset, repertoire_id, round(h / ln(2), 6) AS shannon_entropy, round(gs, 6) AS gini_simpson, half AS d50,
round(CASE WHEN n > 1 THEN 1 - h / ln(n) ELSE 0 END, 6)::DOUBLE AS clonality_score FROM a""", total="rows"))
def _(t):
    return rounded(diversity.sequence_clonality(t.rearrangements))


@query("seq_clonality_cum", _clones(_MULTI, """, l AS (SELECT dataset, repertoire_id, avg(length(junction_aa)) AS m,
  coalesce(stddev_samp(length(junction_aa)), 0) AS sd, min(length(junction_aa)) AS lo, max(length(junction_aa)) AS hi FROM rearrangements GROUP BY ALL)
SELECT dataset, repertoire_id, round(h, 6) AS shannon_entropy, round(gs, 6) AS gini_simpson, below::DOUBLE AS d50,
round(CASE WHEN n > 1 THEN 1 - h / ln(n) ELSE 0 END, 6)::DOUBLE AS clonality, round(m, 6) AS mean_length, round(sd, 6) AS std_length,
lo::DOUBLE AS min_length, hi::DOUBLE AS max_length, round(top1, 6) AS top_clone_freq FROM a JOIN l USING (dataset, repertoire_id)""").replace("repertoire_id)\n, l AS", "repertoire_id), l AS"))
def _(t):
    return rounded(diversity.sequence_clonality_cumulative(t.rearrangements))


_ALPHA = "(SELECT * FROM rearrangements WHERE regexp_matches(junction_aa, '^[A-Za-z]+$'))"


@query("richness", f"""SELECT dataset, repertoire_id, count(DISTINCT junction_aa)::DOUBLE AS n_unique_seqs, count(*)::DOUBLE AS n_total_seqs,
round(count(DISTINCT junction_aa) / count(*), 6) AS diversity_ratio FROM {_ALPHA} GROUP BY ALL""")
def _(t):
    return rounded(diversity.richness(t.rearrangements))


@query("clonality_index", """SELECT dataset, repertoire_id, round(CASE WHEN sum(templates) > 1
THEN (sum(templates) - count(*)) / (sum(templates) - 1) ELSE 0 END, 6) AS clonality_index FROM rearrangements GROUP BY ALL""")
def _(t):
    return rounded(diversity.clonality_index(t.rearrangements))


# ---- lengths -----------------------------------------------------------------------

_L = "length(junction_aa)"


def _q(p):
    return f"round(coalesce(quantile_cont({_L}, {p}), 0), 6)::DOUBLE"


def _z(e):
    return f"round(coalesce({e}, 0), 6)::DOUBLE"


@query("length_weighted", f"""WITH w AS (SELECT dataset, repertoire_id, {_L} AS l, coalesce(templates, 1) AS c FROM rearrangements
  WHERE {_L} > 0 AND coalesce(templates, 1) > 0),
m AS (SELECT *, sum(c) OVER ({_P} ORDER BY l, c ROWS UNBOUNDED PRECEDING) AS cum, sum(c) OVER ({_P}) AS t,
  sum(l * c) OVER ({_P}) / sum(c) OVER ({_P}) AS mu FROM w),
e AS (SELECT dataset, repertoire_id, -sum(p * log2(p)) AS h FROM (SELECT dataset, repertoire_id, l, sum(c) / any_value(t) AS p FROM m GROUP BY ALL) GROUP BY ALL)
SELECT dataset, repertoire_id, round(any_value(mu), 6) AS mean_cdr3_length, round(sqrt(sum(c * (l - mu) * (l - mu)) / any_value(t)), 6) AS std_cdr3_length,
min(CASE WHEN cum >= t / 2 THEN l END)::DOUBLE AS median_cdr3_length, min(l)::DOUBLE AS min_cdr3_length, max(l)::DOUBLE AS max_cdr3_length,
round(any_value(h), 6) AS cdr3_length_entropy FROM m JOIN e USING (dataset, repertoire_id) GROUP BY dataset, repertoire_id""")
def _(t):
    return rounded(lengths.length_weighted(t.rearrangements))


@query("length_stats", f"""SELECT dataset, repertoire_id, {_z(f'avg({_L})')} AS len_mean, {_z(f'stddev_pop({_L})')} AS len_std,
min({_L})::DOUBLE AS len_min, max({_L})::DOUBLE AS len_max, {_q(.25)} AS len_p25, {_q(.75)} AS len_p75 FROM {_ALPHA} GROUP BY ALL""")
def _(t):
    return rounded(lengths.length_stats(t.rearrangements))


_FREQS = ", ".join(f"round(avg(CASE WHEN {_L} = {n} THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS len_freq_{n}" for n in range(10, 16))


@query("length_dist", f"""SELECT dataset, repertoire_id, {_z(f'avg({_L})')} AS len_mean, {_z(f'stddev_pop({_L})')} AS len_std,
min({_L})::DOUBLE AS len_min, max({_L})::DOUBLE AS len_max, {_q(.25)} AS len_p25, {_q(.5)} AS len_p50, {_q(.75)} AS len_p75, {_FREQS},
round(avg(CASE WHEN {_L} <= 11 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS len_short_ratio,
round(avg(CASE WHEN {_L} >= 15 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS len_long_ratio FROM {_ALPHA} GROUP BY ALL""")
def _(t):
    return rounded(lengths.length_distribution(t.rearrangements))


@query("length_shape", f"""WITH m AS (SELECT dataset, repertoire_id, {_L} AS l, avg({_L}) OVER ({_P}) AS mu FROM rearrangements WHERE junction_aa IS NOT NULL),
c AS (SELECT dataset, repertoire_id, avg((l - mu) ** 2) AS m2, avg((l - mu) ** 3) AS m3, avg((l - mu) ** 4) AS m4 FROM m GROUP BY ALL),
s AS (SELECT dataset, repertoire_id, {_z(f'avg({_L})')} AS cdr3_length_mean, {_z(f'stddev_samp({_L})')} AS cdr3_length_std,
{_q(.5)} AS cdr3_length_median, {_q(.25)} AS cdr3_length_q25, {_q(.75)} AS cdr3_length_q75 FROM rearrangements GROUP BY ALL)
SELECT s.*, {_z('CASE WHEN m2 > 0 THEN m3 / m2 ** 1.5 END')} AS cdr3_length_skewness, {_z('CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 END')} AS cdr3_length_kurtosis
FROM s LEFT JOIN c USING (dataset, repertoire_id)""")
def _(t):
    return rounded(lengths.length_shape(t.rearrangements))


@query("length_stats_full", f"""SELECT dataset, repertoire_id, {_z(f'avg({_L})')} AS len_mean, {_z(f'stddev_pop({_L})')} AS len_std,
{_q(.5)} AS len_median, {_q(.25)} AS len_q25, {_q(.75)} AS len_q75, {_z(f'min({_L})')} AS len_min, {_z(f'max({_L})')} AS len_max
FROM rearrangements GROUP BY ALL""")
def _(t):
    return rounded(lengths.length_stats_full(t.rearrangements))


_LOOSE = f"(SELECT * FROM rearrangements WHERE {_L} >= 5 AND regexp_matches(upper(junction_aa), '^[ACDEFGHIKLMNPQRSTVWYX*.-]+$'))"


@query("cdr3_stats", f"""WITH a AS {_LOOSE},
s AS (SELECT dataset, repertoire_id, count(*)::DOUBLE AS n, {_z(f'avg({_L})')} AS mean, {_z(f'stddev_pop({_L})')} AS std, min({_L})::DOUBLE AS min,
  max({_L})::DOUBLE AS max, {_q(.25)} AS p25, {_q(.5)} AS p50, {_q(.75)} AS p75 FROM a GROUP BY ALL),
c AS (SELECT dataset, repertoire_id, unnest(string_split(junction_aa, '')) AS letter FROM a),
p AS (SELECT dataset, repertoire_id, letter, count(*) / sum(count(*)) OVER ({_P}) AS x FROM c GROUP BY dataset, repertoire_id, letter)
SELECT dataset, repertoire_id, 'len_' || name AS feature, value FROM (UNPIVOT s ON n, mean, std, min, max, p25, p50, p75 INTO NAME name VALUE value)
UNION ALL SELECT dataset, repertoire_id, 'aa_' || letter, round(x, 6) FROM p WHERE contains('{AMINO_ACIDS}', letter)""")
def _(t):
    return rounded(lengths.sequence_stats(t.rearrangements))


@query("rep_basic", """SELECT dataset, repertoire_id, count(junction_aa) AS seq_count, coalesce(sum(templates), 0)::DOUBLE AS total_count,
round(avg(length(coalesce(junction_aa, 'nan'))), 6) AS len_mean, round(stddev_samp(length(coalesce(junction_aa, 'nan'))), 6) AS len_std,
max(length(coalesce(junction_aa, 'nan'))) AS len_max FROM rearrangements GROUP BY ALL""")
def _(t):
    return rounded(lengths.repertoire_basics(t.rearrangements))


def _values(columns):
    rows = ", ".join("('%s', %s)" % (a, ", ".join(f"{col.get(a, 0.0)}::DOUBLE" for col in columns)) for a in AMINO_ACIDS)
    return f"(VALUES {rows})"


_LETTERS = f"""a AS (SELECT *, row_number() OVER () AS rid FROM {_ALPHA}),
x AS (SELECT dataset, repertoire_id, rid, unnest(string_split(junction_aa, '')) AS letter FROM a)"""


@query("physchem", f"""WITH {_LETTERS}, v AS (SELECT * FROM {_values([HYDROPATHY, VOLUME, CHARGE])} q(letter, h, v, c)),
s AS (SELECT dataset, repertoire_id, rid, avg(h) AS h, avg(v) AS v, avg(c) AS c FROM x JOIN v USING (letter) GROUP BY ALL)
SELECT dataset, repertoire_id, round(avg(h), 6) AS phys_hydro_mean, round(stddev_pop(h), 6) AS phys_hydro_std, round(avg(v), 6) AS phys_vol_mean,
round(stddev_pop(v), 6) AS phys_vol_std, round(avg(c), 6) AS phys_charge_mean FROM s GROUP BY ALL""")
def _(t):
    return rounded(lengths.physchem(t.rearrangements))


_F = [{a: f[i] for a, f in ATCHLEY.items()} for i in range(5)]
_FN = ", ".join(ATCHLEY_NAMES)


@query("atchley", f"""WITH {_LETTERS}, v AS (SELECT * FROM {_values(_F)} q(letter, {_FN})),
s AS (SELECT dataset, repertoire_id, rid, {', '.join(f'avg({n}) AS {n}' for n in ATCHLEY_NAMES)} FROM x JOIN v USING (letter) GROUP BY ALL),
r AS (SELECT DISTINCT dataset, repertoire_id FROM rearrangements)
SELECT r.dataset, r.repertoire_id, {', '.join(
    f'round(coalesce(avg({n}), 0), 8)::DOUBLE AS atchley_{n}_mean, round(coalesce(stddev_pop({n}), 0), 8)::DOUBLE AS atchley_{n}_std, '
    f'round(min({n}), 8) AS atchley_{n}_min, round(max({n}), 8) AS atchley_{n}_max' for n in ATCHLEY_NAMES)}
FROM r LEFT JOIN s USING (dataset, repertoire_id) GROUP BY ALL""")
def _(t):
    return rounded(lengths.atchley(t.rearrangements), 8)
