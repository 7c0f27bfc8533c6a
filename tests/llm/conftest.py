import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "text string, n_words string, fp long, doc_id long, doc long, textkey long, lang string, source string, n_chars long, fingerprint string, value string"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with further columns whose names operators use inside."""

    def make(rows, partitions=3):
        full = [(r[1], "x", 7, r[0], 9, 9, r[2] if len(r) > 2 else None, "s", len(r[1]) if r[1] is not None else None, "f", "v") for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return make


ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "x" * 5000), (7, "the same words " * 40), (8, "the same words " * 40),
    (9, "é ü ñ 日本     end"), (10, "tab\tand\x0bvertical\x0cform\rfeed"), (11, "A\x01B \x02 C"), (12, "!!! ??? ###"), (13, "😀 a@b.co 😀"),
]


@pytest.fixture
def odd_rows():
    return list(ODD)
