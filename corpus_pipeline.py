"""A training corpus from raw documents: each stage is one of the operators in ``clonara.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonara.llm import decontaminate, language, near_copies, personal, sentencepieces
from clonara.llm.common import stage, table
from clonara.llm.queries import piece_model


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is rejected; those that stay are unchanged."""
    return language.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of near copies (five-word shingles, similarity 0.8), that of the least doc_id."""
    return near_copies.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def anonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in the texts."""
    return personal.mask_personal(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return sentencepieces.tokenize(docs, piece_model())


STAGES = [("language", identify), ("near_duplicates", deduplicate), ("decontamination", decontaminated), ("personal_data", anonymise), ("tokens", tokenise)]

#: Training, fingerprints and merges have no SQL form; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder that the next stage reads."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
