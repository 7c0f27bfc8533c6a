"""Registered scans, sinks and scalar rules.

File scans first write the data's own rows as repertoire files to the shared folder.
"""

from pyspark.sql import functions as F

from clonara.constants import AMINO_ACIDS, REP
from clonara.functions import text
from clonara.operators import align, sampling
from clonara.plans.profile_queries import rounded
from clonara.plans.registry import query
from clonara.session import shared_path
from clonara.sources import repertoires, stores

_COLUMNS = ["junction_aa", "v_call", "j_call", "templates"]


def _layout(t, name, write):
    """Write a layout to a folder of its own."""
    path = shared_path(t.spark, name)
    write(path)
    return path


def repertoire_root(t):
    return _layout(t, "repertoires", lambda p: stores.save_repertoires(t.rearrangements.select(*REP, *_COLUMNS), p))


def metadata_root(t):
    rows = lambda: t.metadata.withColumn("label_positive", F.initcap(F.col("label_positive").cast("string")))
    return _layout(t, "metadata", lambda p: rows().write.option("header", True).partitionBy("dataset").csv(p))


def _names(t, kind="train"):
    if kind == "train":
        return t.metadata.select("dataset").distinct()
    return t.predictions.select("dataset").distinct()


# ---- scans -------------------------------------------------------------------------

_ROWS = "dataset, repertoire_id, junction_aa, v_call, nullif(j_call, '') AS j_call, coalesce(templates, 1.0)::DOUBLE AS templates"


@query("scan_repertoires", f"SELECT {_ROWS} FROM rearrangements")
def _(t):
    return repertoires.scan_repertoires(t.spark, repertoire_root(t))


@query("scan_unlabelled", f"SELECT repertoire_id AS ID, count(*) AS n, count(junction_aa) AS n_seqs FROM (SELECT {_ROWS} FROM rearrangements) GROUP BY ALL")
def _(t):
    rows = repertoires.labelled_rows(repertoires.scan_repertoires(t.spark, repertoire_root(t)), None)
    return rows.groupBy("ID").agg(F.count(F.lit(1)).alias("n"), F.count("junction_aa").alias("n_seqs"))


@query("labelled_scan", f"""SELECT r.dataset, repertoire_id AS ID, m.label_positive, junction_aa, v_call, j_call, templates FROM (SELECT {_ROWS} FROM rearrangements) r
JOIN metadata m USING (dataset, repertoire_id)""")
def _(t):
    rows = repertoires.scan_repertoires(t.spark, repertoire_root(t))
    return repertoires.labelled_rows(rows, t.metadata).select("dataset", "ID", "label_positive", *_COLUMNS)


@query("scan_metadata", """SELECT dataset, repertoire_id, filename, label_positive, sex, age::DOUBLE AS age, race, sequencing_run_id, hla_a FROM metadata""")
def _(t):
    return repertoires.scan_metadata(t.spark, metadata_root(t)).drop("file_order")


@query("first_n_reps", """SELECT dataset, repertoire_id, label_positive FROM metadata
QUALIFY row_number() OVER (PARTITION BY dataset, label_positive ORDER BY md5(repertoire_id), repertoire_id) <= 10""")
def _(t):
    # files whose order is not that of the ids
    rows = t.metadata.withColumn("_o", F.md5(F.col("repertoire_id").cast("binary"))).repartition("dataset").sortWithinPartitions("dataset", "_o", "repertoire_id").drop("_o")
    root = _layout(t, "ordered", lambda p: rows.write.option("header", True).partitionBy("dataset").csv(p))
    return sampling.first_repertoires(repertoires.scan_metadata(t.spark, root), 10).select(*REP, "label_positive")


@query("scan_sequences", """SELECT dataset, repertoire_id, junction_aa, v_call FROM rearrangements WHERE junction_aa IS NOT NULL""")
def _(t):
    rows = t.rearrangements.where(F.col("junction_aa").isNotNull()).select(*REP, "junction_aa", "v_call")
    path = _layout(t, "sequences", lambda p: stores.save_table(rows, f"{p}/sequences.tsv"))
    return repertoires.scan_sequences(t.spark, f"{path}/sequences.tsv")


@query("list_datasets", "SELECT DISTINCT dataset FROM rearrangements")
def _(t):
    return repertoires.list_datasets(repertoires.list_files(t.spark, repertoire_root(t)))


@query("missing_files", """SELECT dataset, repertoire_id, filename FROM metadata WHERE repertoire_id NOT IN
(SELECT repertoire_id FROM rearrangements WHERE junction_aa LIKE 'CASSADED%')""")
def _(t):
    rows = t.rearrangements.where(F.col("junction_aa").startswith("CASSADED")).select(*REP, *_COLUMNS)
    root = _layout(t, "partial", lambda p: stores.save_repertoires(rows, p))
    return repertoires.missing_files(t.metadata, repertoires.list_files(t.spark, root))


@query("completeness", """SELECT m.dataset, n_files, n_metadata, true AS complete FROM (SELECT dataset, count(DISTINCT repertoire_id) AS n_files FROM rearrangements GROUP BY ALL)
JOIN (SELECT dataset, count(*) AS n_metadata FROM metadata GROUP BY ALL) m USING (dataset)""")
def _(t):
    files = repertoires.list_files(t.spark, repertoire_root(t)).select(*REP).distinct()
    return repertoires.completeness(t.metadata, files, _names(t))


_NUM = "coalesce(TRY_CAST(nullif(regexp_extract(dataset, '(^|[_ ])([0-9]+)([_ ]|$)', 2), '') AS INT), 1)"


@query("dataset_id", f"""SELECT dataset, {_NUM} AS dataset_id FROM (SELECT DISTINCT dataset FROM predictions
UNION SELECT DISTINCT dataset || '_2' FROM predictions UNION SELECT DISTINCT c_mktsegment FROM customer)""")
def _(t):
    names = _names(t, "test").union(_names(t, "test").select(F.concat("dataset", F.lit("_2")))).union(
        t.base("customer").select(F.col("c_mktsegment")))
    return repertoires.dataset_numbers(names.distinct())


_PAIR = f"""a AS (SELECT dataset AS train, {_NUM} AS n FROM (SELECT DISTINCT dataset FROM metadata)), b AS (SELECT dataset AS test, {_NUM} AS n FROM (SELECT DISTINCT dataset FROM predictions))"""


@query("dataset_pairs", f"""WITH {_PAIR} SELECT train, n AS dataset_id, coalesce(string_agg(test, ',' ORDER BY test), '') AS tests FROM a LEFT JOIN b USING (n) GROUP BY ALL""")
def _(t):
    return repertoires.dataset_pairs(_names(t), _names(t, "test")).withColumn("tests", F.array_join("tests", ","))


@query("dataset_pairs_fallback", f"WITH {_PAIR} SELECT test, n AS dataset_id, coalesce(train, (SELECT min(train) FROM a)) AS train FROM b LEFT JOIN a USING (n)")
def _(t):
    return repertoires.route_tests(_names(t), _names(t, "test"))


@query("fold_routing", f"""WITH {_PAIR} SELECT b.test AS dataset, b.n AS fold_id, 'without_' || a.train AS model FROM b LEFT JOIN a USING (n)""")
def _(t):
    folds = repertoires.dataset_numbers(_names(t)).select(F.col("dataset_id").alias("fold_id"), F.concat(F.lit("without_"), "dataset").alias("model"))
    return repertoires.fold_routing(_names(t, "test"), folds)


# ---- stores ------------------------------------------------------------------------


def _counts(t, rows=None):
    rows = t.rearrangements if rows is None else rows
    return (rows.where(F.col("v_call").isNotNull()).groupBy(*REP, F.concat(F.lit("v_"), text.gene_family("v_call")).alias("feature"))
            .agg(F.count(F.lit(1)).cast("double").alias("value")))


@query("save_tsv", """SELECT dataset, repertoire_id, junction_aa, v_call, nullif(j_call, '') AS j_call, CAST(templates AS VARCHAR) AS templates FROM rearrangements""")
def _(t):
    rows = t.rearrangements.select(*REP, *_COLUMNS)
    path = _layout(t, "sink", lambda p: stores.save_table(rows, p))
    return t.spark.read.option("sep", "\t").option("header", True).csv(path)


_PREDS = "SELECT ID, dataset, p_a AS label_positive_probability, '-999.0' AS junction_aa, '-999.0' AS v_call, '-999.0' AS j_call FROM predictions"


@query("concat_outputs", f"""{_PREDS} UNION ALL SELECT DISTINCT dataset || '_seq_' || junction_aa, dataset, -999.0::DOUBLE, junction_aa, '-999.0', '-999.0'
FROM rearrangements WHERE regexp_matches(junction_aa, '^[A-Z]+$')""")
def _(t):
    seqs = t.rearrangements.where(text.valid_aa("junction_aa")).select("dataset", "junction_aa").distinct()

    def write(p):
        stores.save_table(align.submission_rows(t.predictions, F.col("p_a")), f"{p}/all_test_predictions.tsv")
        rows = seqs.withColumn("ID", F.concat("dataset", F.lit("_seq_"), "junction_aa"))
        stores.save_table(align.submission_rows(rows, sequence=True), f"{p}/all_important_sequences.tsv")

    return stores.concat_outputs(t.spark, _layout(t, "outputs", write))


@query("resume_pending", "SELECT dataset, repertoire_id FROM metadata WHERE dataset <> 'train_dataset_1'")
def _(t):
    def write(path):
        store, first = stores.FeatureStore(t.spark, path), t.metadata.where(F.col("dataset") == "train_dataset_1")
        store.fill(first, t.rearrangements, lambda rows: _counts(t, rows))

    return stores.FeatureStore(t.spark, _layout(t, "store", write)).pending(t.metadata)


@query("feature_cache", """SELECT dataset, repertoire_id, 'v_' || upper(split_part(split_part(v_call, '*', 1), '-', 1)) AS feature, count(*)::DOUBLE AS value
FROM rearrangements WHERE v_call IS NOT NULL GROUP BY ALL""")
def _(t):
    path = _layout(t, "cache", lambda p: None)
    return stores.cached_table(t.spark, path, lambda: _counts(t))


@query("scan_embeddings", "SELECT vec_id, len(embedding)::INT AS width, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def _(t):
    e = stores.scan_embeddings(t.spark, f"{t.root}/embeddings.parquet")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return rounded(e.select("vec_id", F.size("embedding").alias("width"), total.alias("total")))


@query("feature_vocab", """SELECT DISTINCT 'v_' || upper(split_part(split_part(v_call, '*', 1), '-', 1)) AS feature FROM rearrangements WHERE v_call IS NOT NULL""")
def _(t):
    return stores.feature_vocabulary(_counts(t), t.metadata)


# ---- scalar rules ------------------------------------------------------------------

_S = "(SELECT DISTINCT junction_aa FROM rearrangements WHERE junction_aa IS NOT NULL)"


def _seqs(t):
    return t.rearrangements.where(F.col("junction_aa").isNotNull()).select("junction_aa").distinct()


@query("valid_aa", f"SELECT junction_aa, regexp_matches(junction_aa, '^[{AMINO_ACIDS}]+$') AS ok FROM {_S}")
def _(t):
    return _seqs(t).withColumn("ok", text.valid_aa("junction_aa"))


@query("alpha_seq", f"SELECT junction_aa, regexp_matches(junction_aa, '^[A-Za-z]+$') AS ok FROM {_S}")
def _(t):
    return _seqs(t).withColumn("ok", text.alpha_seq("junction_aa"))


@query("loose_aa", f"SELECT junction_aa, length(junction_aa) >= 5 AND regexp_matches(upper(junction_aa), '^[{AMINO_ACIDS}X*.-]+$') AS ok FROM {_S}")
def _(t):
    return _seqs(t).withColumn("ok", text.loose_aa("junction_aa"))


@query("clean_seq", f"SELECT junction_aa, nullif(regexp_replace(upper(junction_aa), '[^{AMINO_ACIDS}X]', 'X', 'g'), '') AS cleaned FROM {_S}")
def _(t):
    return _seqs(t).withColumn("cleaned", text.clean_seq("junction_aa"))


@query("coerce_templates", """SELECT dataset, repertoire_id, templates, coalesce(templates, 1.0)::DOUBLE AS coerced, count(*) AS n FROM rearrangements GROUP BY ALL""")
def _(t):
    rows = t.rearrangements.select(*REP, "templates", text.coerce_templates(F.col("templates").cast("string")).alias("coerced"))
    return rows.groupBy(*REP, "templates", "coerced").agg(F.count(F.lit(1)).alias("n"))


def _calls(t):
    return t.rearrangements.select(F.inline(F.array(*[F.struct(F.col(c).alias("call")) for c in ("v_call", "j_call")]))).distinct()


_C = "(SELECT DISTINCT v_call AS call FROM rearrangements UNION SELECT DISTINCT j_call FROM rearrangements)"


def _call_query(name, sql, rule):
    @query(name, f"SELECT call, {sql} AS value FROM {_C}")
    def _(t):
        return _calls(t).withColumn("value", rule("call"))


_call_query("gene_family", "coalesce(nullif(upper(split_part(split_part(call, '*', 1), '-', 1)), ''), 'UNK')", text.gene_family)
_call_query("gene_norm", "coalesce(trim(split_part(call, '*', 1)), 'UNKNOWN')", text.gene_norm)
_call_query("gene_family_alt", "CASE WHEN call IN ('', 'nan', '-999.0') THEN NULL WHEN contains(call, '-') THEN split_part(call, '-', 1) ELSE split_part(call, '/', 1) END",
            text.gene_family_alt)
_call_query("gene_sanitize", "translate(call, '*/', '__')", text.gene_sanitize)
_call_query("sentinel_fill", "CASE WHEN call IS NULL OR call IN ('', 'nan', 'None') THEN '-999.0' ELSE call END", text.sentinel_fill)


@query("default_gene", "SELECT DISTINCT v_call, j_call, coalesce(nullif(v_call, ''), 'TRBV20-1') AS v, coalesce(nullif(j_call, ''), 'TRBJ2-7') AS j FROM rearrangements")
def _(t):
    r = t.rearrangements.select("v_call", "j_call").distinct()
    return r.withColumn("v", text.default_v("v_call")).withColumn("j", text.default_j("j_call"))


@query("finite_features", """SELECT vec_id, pos::INT AS pos, CASE WHEN pos % 7 = 0 OR pos % 5 = 0 OR pos % 3 = 0 THEN 0.0 ELSE x END::DOUBLE AS value
FROM (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)""")
def _(t):
    x = t.base("embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    p = F.col("pos")
    broken = F.when(p % 7 == 0, F.lit(None)).when(p % 5 == 0, F.lit(float("nan"))).when(p % 3 == 0, F.lit(float("-inf"))).otherwise(F.col("x"))
    return x.select("vec_id", "pos", text.finite(broken).alias("value"))


@query("meta_features", """WITH m AS (SELECT *, CAST(regexp_extract(dataset, '[0-9]+') AS INT) AS n FROM metadata)
SELECT dataset, repertoire_id, 'meta_sex_male' AS feature, CASE WHEN upper(sex) IN ('M', 'MALE') THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM m
UNION ALL SELECT dataset, repertoire_id, 'meta_race_white', CASE WHEN contains(lower(race), 'white') THEN 1.0 ELSE 0.0 END FROM m WHERE n = 7
UNION ALL SELECT dataset, repertoire_id, 'meta_hla_A', CASE WHEN hla_a IS NOT NULL THEN 1.0 ELSE 0.0 END FROM m WHERE n = 8""")
def _(t):
    m = t.metadata.withColumn("n", text.dataset_id("dataset")).withColumnRenamed("hla_a", "A")
    return text.metadata_features(m, "n").where(F.col("feature") != "meta_run_hash")


@query("meta_features_run", """SELECT dataset, repertoire_id, 'meta_run_hash' AS feature, (('0x' || substr(md5(coalesce(sequencing_run_id, 'nan')), 1, 8))::BIGINT % 100) / 100.0::DOUBLE AS value
FROM metadata WHERE dataset = 'train_dataset_7'""")
def _(t):
    m = t.metadata.withColumn("n", text.dataset_id("dataset"))
    return text.metadata_features(m, "n").where(F.col("feature") == "meta_run_hash")


@query("encode_tokens", f"""WITH l AS (SELECT junction_aa, unnest(range(1, 21)) AS i FROM {_S} WHERE junction_aa IS NOT NULL)
SELECT junction_aa, i::INT AS pos, CASE WHEN i > length(junction_aa) THEN 0 WHEN instr('{AMINO_ACIDS}', substr(junction_aa, i, 1)) = 0 THEN 21
ELSE instr('{AMINO_ACIDS}', substr(junction_aa, i, 1)) END::INT AS token FROM l""")
def _(t):
    rows = _seqs(t).where(F.col("junction_aa").isNotNull())
    return rows.select("junction_aa", F.posexplode(text.encode_tokens("junction_aa")).alias("pos", "token")).withColumn("pos", F.col("pos") + 1)


@query("encode_bag")
def _(t):
    from clonara.operators.encode import encode_bags

    return encode_bags(t.rearrangements, 50, ["row_order", "v_call", "j_call", "templates"])


@query("encode_kmers", f"""WITH l AS (SELECT junction_aa, unnest(range(1, length(junction_aa) - 1)) AS i FROM {_S} WHERE length(junction_aa) >= 3),
d AS (SELECT junction_aa, i, instr('{AMINO_ACIDS}', substr(junction_aa, i, 1)) AS a, instr('{AMINO_ACIDS}', substr(junction_aa, i + 1, 1)) AS b,
  instr('{AMINO_ACIDS}', substr(junction_aa, i + 2, 1)) AS c FROM l)
SELECT junction_aa, i::INT AS pos, CASE WHEN a * b * c = 0 THEN 0 ELSE (a - 1) * 400 + (b - 1) * 20 + c END::BIGINT AS token FROM d""")
def _(t):
    rows = _seqs(t).where(F.col("junction_aa").isNotNull())
    return rows.select("junction_aa", F.posexplode(text.encode_kmers("junction_aa")).alias("pos", "token")).withColumn("pos", F.col("pos") + 1)
