"""Repertoire files are listed once, whatever headers they have."""

import pytest
from pyspark.sql import functions as F

from clonara.sources import repertoires


@pytest.fixture
def listings(monkeypatch):
    asked, lines = [], repertoires._lines
    monkeypatch.setattr(repertoires, "_lines", lambda spark, paths: asked.append(paths) or lines(spark, paths))
    return asked


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_other_headers_hidden_and_headless_files(spark, tmp_path, listings):
    write(tmp_path, {"d_1/a.tsv": "junction_aa\tv_call\nCASSF\tV1\n", "d_1/b b.tsv": "junction_aa\tv_call\nCAAF\tV2\n", "d_2/c.tsv": 'v_call\t"cdr3_aa"\nV3\tCCCF\n',
                     "d_2/none.tsv": "x\ty\nCAAAF\tV4\n"})
    found = sorted((r.dataset, r.repertoire_id, r.junction_aa, r.v_call) for r in repertoires.scan_repertoires(spark, str(tmp_path)).collect())
    assert [f[2:] for f in found] == [("CASSF", "V1"), ("CAAF", "V2"), ("CCCF", "V3")]
    assert listings.count(str(tmp_path)) == 1 and len(listings) == 2
    assert [r.v_call for r in repertoires.scan_repertoires(spark, str(tmp_path), ["d_2"]).collect()] == ["V3"]


def test_unlabelled_rows_need_one_listing(spark, tmp_path, listings):
    write(tmp_path, {f"d_1/r{i}.tsv": "junction_aa\tv_call\n" + "CASSF\tV1\n" * i + "\tV2\n" for i in range(4)})
    rows = repertoires.labelled_rows(repertoires.scan_repertoires(spark, str(tmp_path)), None)
    assert {r.ID: (r.n, r.n_seqs) for r in rows.groupBy("ID").agg(F.count(F.lit(1)).alias("n"), F.count("junction_aa").alias("n_seqs")).collect()} == {f"r{i}": (i + 1, i) for i in range(4)}
    assert listings == [str(tmp_path)]
