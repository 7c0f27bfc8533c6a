"""Views that give the base tables a repertoire shape.

The SQL text is the same for Spark and the oracle engine; only word splitting differs. A third of the rows carries one
of 200 public sequences, as often in a bag at every scale; the others take theirs from the part key, so different
sequences grow with the data, and bags and vectors per bag keep their size while their number grows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

REARRANGEMENTS = """
SELECT concat('train_dataset_', CAST(k % 8 + 1 AS STRING)) AS dataset,
  concat('rep_', lpad(CAST(r AS STRING), 6, '0')) AS repertoire_id,
  (r % 2 = 0) AS label_positive,
  CASE WHEN o % 97 = 0 THEN NULL WHEN o % 89 = 0 THEN 'CASSX*YF' WHEN o % 83 = 0 THEN 'CA'
    ELSE concat('CASS', translate(lpad(CAST((c * 7919) % 10000019 AS STRING), 8, '0'), '0123456789', 'ADEGKLPQRY'),
                repeat('G', CAST(c % 6 AS INT)), 'F') END AS junction_aa,
  CASE WHEN o % 71 = 0 THEN NULL ELSE concat('TRBV', CAST(c % 30 + 1 AS STRING), '-', CAST(c % 7 + 1 AS STRING),
                '*0', CAST(c % 3 + 1 AS STRING)) END AS v_call,
  CASE WHEN o % 73 = 0 THEN '' ELSE concat('TRBJ', CAST(c % 2 + 1 AS STRING), '-', CAST(c % 5 + 1 AS STRING)) END AS j_call,
  CASE WHEN o % 79 = 0 THEN NULL ELSE CAST(q AS DOUBLE) END AS templates,
  o * 8 + n AS row_order
FROM (SELECT l.l_suppkey AS r, CASE WHEN l.l_orderkey % 3 = 0 THEN l.l_partkey % 200 ELSE l.l_partkey + 200 END AS c, l.l_orderkey AS o, l.l_quantity AS q,
        CAST(l.l_linenumber AS BIGINT) AS n, s.s_nationkey AS k
      FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey) b
WHERE NOT (c % 10 = 0 AND r % 2 = 1) AND NOT (c % 10 = 5 AND r % 2 = 0)
"""

METADATA = """
SELECT concat('train_dataset_', CAST(s_nationkey % 8 + 1 AS STRING)) AS dataset,
  concat('rep_', lpad(CAST(s_suppkey AS STRING), 6, '0')) AS repertoire_id,
  concat('rep_', lpad(CAST(s_suppkey AS STRING), 6, '0'), '.tsv') AS filename,
  (s_suppkey % 2 = 0) AS label_positive,
  CASE s_suppkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'male' ELSE NULL END AS sex,
  CAST(20 + s_suppkey % 50 AS INT) AS age,
  CASE s_suppkey % 3 WHEN 0 THEN 'White' WHEN 1 THEN 'Asian' ELSE NULL END AS race,
  concat('run_', CAST(s_nationkey % 5 AS STRING)) AS sequencing_run_id,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE concat('A*0', CAST(s_suppkey % 4 + 1 AS STRING)) END AS hla_a
FROM {supplier}
"""

_WORDS = """
SELECT d.source AS dataset, CAST(d.doc_id AS STRING) AS repertoire_id, (l.quality = 1) AS label_positive,
  d.lang AS v_call, lower(d.w) AS junction_aa
FROM (SELECT doc_id, source, lang, %s AS w FROM {documents}) d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""
WORD_BAGS = _WORDS % r"explode(regexp_extract_all(text, r'\p{{L}}+', 0))"
WORD_BAGS_ORACLE = _WORDS % r"unnest(regexp_extract_all(text, '\p{{L}}+'))"

PREDICTIONS = """
SELECT concat('rep_', lpad(CAST(s_suppkey AS STRING), 6, '0')) AS ID,
  concat('test_dataset_', CAST(s_nationkey % 8 + 1 AS STRING)) AS dataset,
  CAST((s_suppkey * 37 + CASE WHEN s_suppkey % 2 = 0 THEN 20 ELSE 0 END) % 101 AS DOUBLE) / 100 AS p_a,
  CAST((s_suppkey * 53 + CASE WHEN s_suppkey % 2 = 0 THEN 10 ELSE 0 END) % 101 AS DOUBLE) / 100 AS p_b,
  (s_suppkey % 2 = 0) AS label_positive
FROM {supplier}
"""

EMBEDDING_BAGS = "SELECT CAST(floor(vec_id / 10) AS BIGINT) AS bag, vec_id, label, embedding FROM {embeddings}"

# name -> (text for Spark, text for the oracle engine)
VIEWS = {
    "rearrangements": (REARRANGEMENTS, REARRANGEMENTS),
    "metadata": (METADATA, METADATA),
    "word_bags": (WORD_BAGS, WORD_BAGS_ORACLE),
    "predictions": (PREDICTIONS, PREDICTIONS),
    "embedding_bags": (EMBEDDING_BAGS, EMBEDDING_BAGS),
}

class Tables:
    """Base tables and derived views of one data folder, read lazily."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        text = VIEWS[name][0]
        bases = set(re.findall(r"(?<!\{)\{(\w+)\}", text))
        return self.spark.sql(text, **{b: self.base(b) for b in bases})

    @cached_property
    def rearrangements(self) -> DataFrame:
        return self._view("rearrangements")

    @cached_property
    def metadata(self) -> DataFrame:
        return self._view("metadata")

    @cached_property
    def word_bags(self) -> DataFrame:
        return self._view("word_bags")

    @cached_property
    def predictions(self) -> DataFrame:
        return self._view("predictions")

    @cached_property
    def embedding_bags(self) -> DataFrame:
        return self._view("embedding_bags")
