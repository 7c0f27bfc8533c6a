"""Registered k-mer queries."""

from pyspark.sql import functions as F

from clonara.constants import REP
from clonara.operators import kmers
from clonara.plans.registry import query
from clonara.session import materialize

_AA = "^[ACDEFGHIKLMNPQRSTVWY]+$"


def _occ(k, source="rearrangements", where="TRUE"):
    """SQL: one row per window of length k."""
    return (f"SELECT dataset, repertoire_id, {k} AS k, substr(junction_aa, i, {k}) AS kmer FROM (SELECT dataset, repertoire_id, "
            f"junction_aa, unnest(range(1, length(junction_aa) - {k} + 2)) AS i FROM {source} "
            f"WHERE length(junction_aa) >= {k} AND {where})")


def _once(k, source="rearrangements"):
    """SQL: one row per distinct window of a row."""
    return (f"SELECT dataset, repertoire_id, {k} AS k, unnest(list_distinct(list_transform(range(1, length(junction_aa) - {k} + 2), "
            f"lambda i: substr(junction_aa, i, {k})))) AS kmer FROM {source} WHERE length(junction_aa) >= {k}")


def _union(part, ks, *args):
    return " UNION ALL ".join(part(k, *args) for k in ks)


_COUNT = "SELECT dataset, repertoire_id, k, kmer, count(*) AS count FROM w GROUP BY ALL"


@query("kmer_extract", """
SELECT junction_aa, i AS pos, substr(junction_aa, i, 3) AS kmer FROM (
  SELECT junction_aa, unnest(range(1, length(junction_aa) - 1))::INT AS i
  FROM (SELECT DISTINCT junction_aa FROM rearrangements WHERE length(junction_aa) >= 3))
""")
def _(t):
    return kmers.kmer_extract(t.rearrangements, 3)


@query("kmer_counts", f"WITH w AS ({_union(_occ, (3, 4))}) {_COUNT}")
def _(t):
    return kmers.kmer_counts(t.rearrangements, (3, 4))


@query("kmer_counts_words", f"WITH w AS ({_union(_occ, (3, 4), 'word_bags')}) {_COUNT}")
def _(t):
    return kmers.kmer_counts(t.word_bags, (3, 4))


@query("kmer_presence", f"WITH w AS ({_union(_once, (3, 4))}) {_COUNT}")
def _(t):
    return kmers.kmer_counts(t.rearrangements, (3, 4), once_per_row=True)


_FREQ = """SELECT dataset, repertoire_id, '{p}' || k || '_' || kmer AS feature,
  round(count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY dataset, repertoire_id, k), 6) AS value FROM w
  GROUP BY dataset, repertoire_id, k, kmer"""


@query("kmer_freq", f"""WITH a AS (SELECT * FROM rearrangements WHERE regexp_matches(junction_aa, '^[A-Za-z]+$')),
v AS ({_union(_occ, (3, 4), 'a')}), w AS (SELECT * FROM v WHERE regexp_matches(kmer, '{_AA}')) {_FREQ.format(p='kmer_')}""")
def _(t):
    return kmers.kmer_frequencies(t.rearrangements).withColumn("value", F.round("value", 6))


@query("kmer_freq_raw", f"WITH w AS ({_union(_occ, (3, 4, 5))}) {_FREQ.format(p='k')}")
def _(t):
    return kmers.kmer_frequencies(t.rearrangements, (3, 4, 5), valid_only=False, prefix="k{k}_").withColumn(
        "value", F.round("value", 6))


@query("kmer_multiscale", f"""WITH w AS ({_union(_occ, (3, 4, 5))})
SELECT dataset, repertoire_id, 'k' || k || '_' || kmer AS feature, count(*)::DOUBLE AS value FROM w GROUP BY ALL""")
def _(t):
    return kmers.kmer_multiscale(t.rearrangements)


@query("kmer_vocab_full", f"""WITH aa AS (SELECT unnest(string_split('A,C,D,E,F,G,H,I,K,L,M,N,P,Q,R,S,T,V,W,Y', ',')) AS c,
  unnest(range(20)) AS i), w AS ({_occ(3)}), n AS (SELECT kmer, count(*) AS count FROM w GROUP BY ALL)
SELECT x.c || y.c || z.c AS kmer, x.i * 400 + y.i * 20 + z.i AS index, coalesce(n.count, 0) AS count
FROM aa x CROSS JOIN aa y CROSS JOIN aa z LEFT JOIN n ON n.kmer = x.c || y.c || z.c""")
def _(t):
    return kmers.full_vocabulary_counts(t.rearrangements, 3)


_VOCAB = """v AS (SELECT k, kmer, count, row_number() OVER (PARTITION BY k ORDER BY count DESC, kmer) AS rank
  FROM (SELECT k, kmer, count(*) AS count FROM w GROUP BY ALL) QUALIFY rank <= {n})"""


@query("kmer_vocab_topk", f"""WITH w AS ({_union(_once, (3, 4))}), {_VOCAB.format(n=500)}
SELECT k, kmer, count, rank::INT AS rank FROM v""")
def _(t):
    return kmers.learn_vocabulary(t.rearrangements, (3, 4), 500)


@query("kmer_vocab_topk_words", f"""WITH w AS ({_union(_once, (3, 4), 'word_bags')}), {_VOCAB.format(n=500)}
SELECT k, kmer, count, rank::INT AS rank FROM v""")
def _(t):
    return kmers.learn_vocabulary(t.word_bags, (3, 4), 500)


KMER_INDEX = f"""WITH w AS ({_union(_once, (3, 4))}), {_VOCAB.format(n=200)}
SELECT 'kmer_' || k || '_' || kmer AS feature, k, kmer,
  (rank - 1 + CASE k WHEN 3 THEN 0 ELSE (SELECT count(*) FROM v WHERE k = 3) END)::BIGINT AS index FROM v"""


@query("kmer_index", KMER_INDEX)
def _(t):
    return kmers.index_vocabulary(kmers.learn_vocabulary(t.rearrangements, (3, 4), 200))


@query("kmer_transform", f"""WITH w AS ({_union(_once, (3, 4))}), {_VOCAB.format(n=50)},
n AS (SELECT dataset, repertoire_id, k, kmer, count(*) AS c FROM w JOIN v USING (k, kmer) GROUP BY ALL),
s AS (SELECT *, c / sum(c) OVER (PARTITION BY dataset, repertoire_id, k) AS x FROM n),
r AS (SELECT DISTINCT dataset, repertoire_id FROM rearrangements)
SELECT r.dataset, r.repertoire_id, v.k, v.kmer, round(coalesce(s.x, 0.0::DOUBLE), 6) AS value FROM r CROSS JOIN v
LEFT JOIN s ON s.dataset = r.dataset AND s.repertoire_id = r.repertoire_id AND s.k = v.k AND s.kmer = v.kmer""")
def _(t):
    r = t.rearrangements
    out = kmers.vocabulary_transform(r, kmers.learn_vocabulary(r, (3, 4), 50), (3, 4), r.select(*REP).distinct(), size=100)
    return out.withColumn("value", F.round("value", 6))


@query("kmer_hashed")
def _(t):
    return kmers.hashed_statistics(t.rearrangements)


@query("kmer_positional", f"""WITH a AS (SELECT * FROM rearrangements WHERE regexp_matches(junction_aa, '^[A-Za-z]+$') AND length(junction_aa) >= 3),
e AS (SELECT dataset, repertoire_id, 'start' AS side, left(junction_aa, 3) AS kmer FROM a
      UNION ALL SELECT dataset, repertoire_id, 'end', right(junction_aa, 3) FROM a),
c AS (SELECT dataset, repertoire_id, side, kmer, count(*) AS n FROM e WHERE regexp_matches(kmer, '{_AA}') GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY dataset, repertoire_id, side) AS x,
      row_number() OVER (PARTITION BY dataset, repertoire_id, side ORDER BY n DESC, kmer) AS rn FROM c)
SELECT dataset, repertoire_id, 'pos_' || side || '_' || kmer AS feature, round(x, 6) AS value FROM s WHERE rn <= 30""")
def _(t):
    return kmers.positional_kmers(t.rearrangements).withColumn("value", F.round("value", 6))


@query("kmer_global64", f"""WITH w AS ({_occ(3)}), b AS (SELECT kmer FROM w GROUP BY kmer ORDER BY count(*) DESC, kmer LIMIT 64),
r AS (SELECT DISTINCT dataset, repertoire_id FROM rearrangements),
x AS (SELECT dataset, repertoire_id, kmer, sum(templates) AS v FROM b JOIN rearrangements ON contains(junction_aa, kmer) GROUP BY ALL)
SELECT r.dataset, r.repertoire_id, b.kmer, coalesce(x.v, 0)::DOUBLE AS value FROM r CROSS JOIN b
LEFT JOIN x ON x.dataset = r.dataset AND x.repertoire_id = r.repertoire_id AND x.kmer = b.kmer""")
def _(t):
    return kmers.global_kmers(t.rearrangements, weight="templates")


@query("aa_composition", f"""WITH a AS (SELECT * FROM rearrangements WHERE length(junction_aa) >= 5
  AND regexp_matches(upper(junction_aa), '^[ACDEFGHIKLMNPQRSTVWYX*.-]+$')),
c AS (SELECT dataset, repertoire_id, unnest(string_split(junction_aa, '')) AS letter FROM a),
s AS (SELECT dataset, repertoire_id, letter, count(*) AS n FROM c GROUP BY ALL),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY dataset, repertoire_id) AS x FROM s)
SELECT dataset, repertoire_id, letter, round(x, 6) AS value FROM p WHERE regexp_matches(letter, '{_AA}')""")
def _(t):
    return kmers.aa_composition(t.rearrangements).withColumn("value", F.round("value", 6))


@query("sparse_features", f"""WITH w AS ({_union(_occ, (3, 4))}), c AS (SELECT dataset, repertoire_id, 'k' || k || '_' || kmer AS feature, count(*)::DOUBLE AS value FROM w GROUP BY ALL),
v AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS index FROM (SELECT DISTINCT feature FROM c))
SELECT dataset, repertoire_id, row_number() OVER (PARTITION BY dataset, repertoire_id ORDER BY index)::INT - 1 AS place, index, value FROM c JOIN v USING (feature)""")
def _(t):
    counts = materialize(kmers.kmer_multiscale(t.rearrangements, (3, 4)), "counts")
    rows = kmers.sparse_rows(counts, kmers.column_index(counts))
    cells = F.arrays_zip("indices", "values")
    return rows.select(*REP, F.posexplode(cells).alias("place", "c")).select(*REP, "place", F.col("c.indices").alias("index"), F.col("c.values").alias("value"))
