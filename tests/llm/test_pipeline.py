"""The pipeline against a plain version of its stages, and its SQL twins at a small scale."""

import os
import sys

import plain
import pytest
from clonara.llm import language, personal, sentencepieces
from clonara.llm.common import table
from clonara.llm.queries import ORACLES, QUERIES, piece_model

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    from compare import connect, differences

    got = QUERIES[name](spark, SF).toPandas()
    want = connect(SF).execute(ORACLES[name]).df()
    for c in got.columns:
        if got[c].dtype.kind in "iuf" or str(got[c].dtype) == "Int64":
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert differences(got, want) is None


def test_run_equals_plain_stages(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    model = language.fit(docs)
    known = {r.doc_id for r in language.predict(docs, model).collect() if not r.rejected}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in known}
    classes = plain.wide_classes(sorted(rows.items()))
    rows = {d: t for d, t in rows.items() if classes[d] == d}
    leaked = {p[0] for p in plain.leaks(list(rows.items()), items)}
    rows = {d: t for d, t in rows.items() if d not in leaked}
    of = sentencepieces.codec(piece_model())
    want = {}
    for d, t in rows.items():
        ids = of.library.encode(personal.masked(t, [(personal.KINDS.index(k), a, b) for k, a, b in plain.personal(t)]))
        want[d] = plain.sha(",".join(map(str, ids)))
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(leaked) > 0


def test_stages_keep_the_columns_of_documents(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, SF).columns == docs.columns, name
