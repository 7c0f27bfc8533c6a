"""Registered queries of the text operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonara.llm import bytepairs, chats, decontaminate, language, neighbours, periods, personal, secrets, sentencepieces, simhash, substrings, warc, whitening
from clonara.llm.common import table


def piece_model() -> str:
    """Place of the merge-type vocabulary among the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_ranks() -> tuple[str, str]:
    """Place of the byte-level vocabulary, and the pattern that splits text for it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.tokenize(table(spark, sf_dir, "documents"), piece_model(), keep_ids=False)


def op8_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find_personal(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op10_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.render(table(spark, sf_dir, "conversations"))


def op11_bytepairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepairs.tokenize(table(spark, sf_dir, "documents"), *byte_ranks(), keep_ids=False)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where the words of one document in ten repeat with a short period from some word on, as op12 asks.

    Words and periods are a matter of the id's hash. Rows without an id or without a word stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.expr("crc32(cast(cast(doc_id AS string) AS binary)) div 10").alias("g"), words.alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.expr("CASE WHEN n > 0 THEN cast(g % n AS int) END"))
    rows = rows.withColumn("p", F.expr("CASE WHEN n > 0 THEN cast(1 + (n - a) div (3 + g % 8) AS int) END"))
    planted = F.expr("array_join(concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast((n - a) div p + 1 AS int))), 1, n - a)), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.collapse_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    none = F.expr("cast(null AS struct<start: long, length: long, period: long>)")
    best = F.aggregate("runs", none, lambda top, r: F.when(top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
             "runs_sha256", "collapsed_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_warc, op3_simhash, op4_substrings, op5_language, op6_neighbours,
                                   op7_sentencepiece, op8_personal, op9_secrets, op10_chats, op11_bytepairs, op12_periods, op13_whitening)}

_WORDS = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op1_decontaminate": r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM benchmark),
s AS (
  SELECT side, id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w WHERE len(words) >= 5),
g AS (SELECT DISTINCT side, id, array_to_string(words[i:i + 4], ' ') AS g FROM s),
n AS (SELECT id AS item_id, count(*) AS n FROM g WHERE side = 'i' GROUP BY id),
h AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS c FROM g d JOIN g i ON d.side = 'd' AND i.side = 'i' AND d.g = i.g GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_shingles, CAST(c AS INTEGER) AS n_shared, CAST(c AS DOUBLE) / n AS containment
FROM h JOIN n USING (item_id) WHERE c >= 0.8 * n - 1e-9""",
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, t, sha1(t) AS x, max(page_id) OVER (PARTITION BY t) AS last FROM p),
b AS (SELECT *, list_transform(generate_series(0, 7), lambda i: ('0x' || substr(x, 1 + 5 * i, 5))::INTEGER) AS five FROM d)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(five, lambda v: concat(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v // 32768), 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v // 1024) % 32, 1),
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v // 32) % 32, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + v % 32, 1))), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM b""",
    "op4_substrings": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - 19)) AS i FROM w WHERE len(words) >= 20),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS g FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS rn FROM g),
c AS (SELECT DISTINCT doc_id, i + unnest(generate_series(0, 19)) AS i FROM r WHERE rn > 1),
e AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i FROM w),
k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) FILTER (c.i IS NULL) AS kept, count(c.i) AS gone FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id""",
    "op10_chats": """
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, 4611686018427387904) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(31) || text || chr(30), '' ORDER BY turn) AS body, min_by(text, turn) AS first,
  string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, count(*) AS copies, n, body, first, rendered FROM c GROUP BY n, body, first, rendered)
SELECT conv_id, CAST(0 AS BIGINT) AS segment, n AS n_turns, copies AS n_copies, rendered FROM u
WHERE NOT EXISTS (SELECT 1 FROM u l WHERE l.first = u.first AND l.n > u.n AND starts_with(l.body, u.body))""",
}
