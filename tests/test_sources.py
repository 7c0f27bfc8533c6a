"""Reading and writing real file layouts."""

import os

import pytest

from clonara.session import shared_dir
from clonara.sources import repertoires, stores
from clonara.streaming.ingest import ingest_new


@pytest.fixture()
def root(tmp_path):
    d = tmp_path / "train" / "train_dataset_1"
    d.mkdir(parents=True)
    (d / "metadata.csv").write_text("repertoire_id,filename,label_positive,age,sex\nrep_001,rep_001.tsv,True,33,M\nrep_002,rep_002.tsv,False,,nan\nrep_003,rep_003.tsv,1,x,F\n")
    (d / "rep_001.tsv").write_text("junction_aa\tv_call\tj_call\ttemplates\nCASSF\tTRBV1\tTRBJ1\t3\n\tTRBV2\tNA\tbad\n")
    (d / "rep_002.tsv").write_text("junction_aa\tv_call\tj_call\ttemplates\nCAWF\tnan\tTRBJ1\t\n")
    e = tmp_path / "train" / "train_dataset_2"
    e.mkdir()
    (e / "rep_009.tsv").write_text("j_call\tcdr3_aa\nTRBJ9\tCAAAF\n")
    return str(tmp_path / "train")


def test_scan(spark, root):
    got = {(r.dataset, r.repertoire_id, r.junction_aa, r.v_call, r.j_call, r.templates) for r in
           repertoires.scan_repertoires(spark, root).select("dataset", "repertoire_id", "junction_aa", "v_call", "j_call", "templates").collect()}
    assert got == {("train_dataset_1", "rep_001", "CASSF", "TRBV1", "TRBJ1", 3.0), ("train_dataset_1", "rep_001", None, "TRBV2", None, 1.0),
                   ("train_dataset_1", "rep_002", "CAWF", None, "TRBJ1", 1.0), ("train_dataset_2", "rep_009", "CAAAF", "", "TRBJ9", 1.0)}


def test_discovery_and_missing(spark, root):
    files = repertoires.list_files(spark, root)
    assert [r.dataset for r in repertoires.list_datasets(files).collect()] == ["train_dataset_1", "train_dataset_2"]
    data = repertoires.load_dataset(spark, root, "train_dataset_1")
    assert [r.filename for r in repertoires.missing_files(data.metadata, files).collect()] == ["rep_003.tsv"]
    assert {r.ID: r.label_positive for r in repertoires.labelled_rows(data.sequences, data.metadata).collect()} == {"rep_001": True, "rep_002": False}
    meta = {r.repertoire_id: (r.label_positive, r.age, r.sex) for r in data.metadata.collect()}
    assert meta == {"rep_001": (True, 33.0, "M"), "rep_002": (False, None, None), "rep_003": (True, None, "F")}
    assert repertoires.load_dataset(spark, root, "train_dataset_2").metadata.count() == 0
    assert repertoires.scan_repertoires(spark, root, ["absent"]).count() == 0


def test_suffixes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "a.txt").write_text("x\ty\n1\t2\n")
    assert repertoires.scan_sequences(spark, str(tmp_path / "a.csv")).first().y == "2"
    assert repertoires.scan_sequences(spark, str(tmp_path / "a.txt")).first().y == "2"
    with pytest.raises(ValueError):
        repertoires.scan_sequences(spark, str(tmp_path / "a.parquet"))


def test_routing(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "dataset string")
    train, test = names("train_dataset_1", "train_dataset_7"), names("test_dataset_7_1", "test_dataset_7_2", "test_dataset_3")
    pairs = {r.train: list(r.tests) for r in repertoires.dataset_pairs(train, test).collect()}
    assert pairs == {"train_dataset_1": [], "train_dataset_7": ["test_dataset_7_1", "test_dataset_7_2"]}
    route = lambda f: {r.test: r.train for r in repertoires.route_tests(train, test, f).collect()}
    assert route("first")["test_dataset_3"] == "train_dataset_1" and route("other")["test_dataset_3"] == "other"
    assert set(route(None)) == {"test_dataset_7_1", "test_dataset_7_2"}


def test_round_trip(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    stores.save_repertoires(rows.select("dataset", "repertoire_id", "junction_aa", "v_call", "templates"), path)
    back = repertoires.scan_repertoires(spark, path)
    assert back.count() == rows.count()
    assert {r.repertoire_id for r in back.collect()} == {"r1", "r2", "r3"}


def test_empty_fields_are_a_row_and_blank_lines_are_not(spark, tmp_path):
    d = tmp_path / "train_dataset_1"
    d.mkdir()
    (d / "a.tsv").write_text("junction_aa\tv_call\tj_call\ttemplates\n\t\t\t\n\nCASSF\tTRBV1\tTRBJ1\t2\n")
    got = [tuple(r)[2:] for r in repertoires.scan_repertoires(spark, str(tmp_path)).orderBy("templates").collect()]
    assert got == [(None, None, None, 1.0), ("CASSF", "TRBV1", "TRBJ1", 2.0)]
    (d / "b.tsv").write_text("v_call\tjunction_aa\tj_call\ttemplates\nTRBV1\tCASSF\tTRBJ1\t2\n")
    (d / "c.tsv").write_text("cdr3_aa\tv_call\nCAWF\tTRBV2\n")
    (d / "d.tsv").write_text("no header here\n1\t2\n")
    (d / "e.tsv").write_text("")
    got = {tuple(r)[1:] for r in repertoires.scan_repertoires(spark, str(tmp_path)).collect()}
    assert got == {("a", None, None, None, 1.0), ("a", "CASSF", "TRBV1", "TRBJ1", 2.0), ("b", "CASSF", "TRBV1", "TRBJ1", 2.0), ("c", "CAWF", "TRBV2", "", 1.0)}
    assert {r.repertoire_id for r in repertoires.unreadable_files(spark, str(tmp_path)).collect()} == {"d"}


def test_store_resumes(spark, rows, metadata, tmp_path):
    store = stores.FeatureStore(spark, str(tmp_path / "store"))
    assert store.pending(metadata).count() == 3
    feature = lambda df: df.groupBy("dataset", "repertoire_id").count().selectExpr("dataset", "repertoire_id", "'n' AS feature", "count AS value")
    store.fill(metadata.where("repertoire_id = 'r1'"), rows, feature)
    assert {r.repertoire_id for r in store.pending(metadata).collect()} == {"r2", "r3"}
    store.fill(metadata, rows, feature)
    assert store.pending(metadata).count() == 0 and store.read().count() == 3
    store.write(feature(rows.where("repertoire_id <> 'r3'")))
    assert store.read().count() == 2


def test_store_notes_repertoires_without_features_and_mends_a_broken_run(spark, rows, metadata, tmp_path):
    store = stores.FeatureStore(spark, str(tmp_path / "store"))
    feature = lambda df: df.where("repertoire_id <> 'r2'").groupBy("dataset", "repertoire_id").count().selectExpr("dataset", "repertoire_id", "'n' AS feature", "count AS value")
    left = store.stage(feature(rows.where("repertoire_id = 'r1'")), metadata.where("repertoire_id = 'r1'"))  # a run that stopped before its commitment
    assert store.pending(metadata).count() == 3 and store.read().count() == 0
    store.fill(metadata, rows, feature)
    assert store.pending(metadata).count() == 0
    assert sorted(r.repertoire_id for r in store.read().collect()) == ["r1", "r3"]
    assert store.discard_staged() == [left] and store.read().count() == 2
    store.fill(metadata, rows, lambda df: 1 / 0)  # nothing is pending, nothing is computed


def test_a_resume_writes_new_rows_only(spark, rows, metadata, tmp_path):
    store = stores.FeatureStore(spark, str(tmp_path / "store"))
    feature = lambda df: df.groupBy("dataset", "repertoire_id").count().selectExpr("dataset", "repertoire_id", "'n' AS feature", "count AS value")
    store.fill(metadata.where("repertoire_id = 'r1'"), rows, feature)
    (first, _), = store.batches()
    before = sorted(p.name for p in tmp_path.glob(f"store/features/batch={first}/**/*.parquet"))
    store.fill(metadata, rows, feature)
    (again, _), (second, _) = store.batches()
    assert again == first and sorted(p.name for p in tmp_path.glob(f"store/features/batch={first}/**/*.parquet")) == before
    new = spark.read.parquet(str(tmp_path / f"store/features/batch={second}"))
    assert {r.repertoire_id for r in new.collect()} == {"r2", "r3"}


def test_replaced_datasets_are_read_from_the_last_batch(spark, tmp_path):
    store = stores.FeatureStore(spark, str(tmp_path / "store"))
    make = lambda *rows: spark.createDataFrame([(d, r, "n", v) for d, r, v in rows], "dataset string, repertoire_id string, feature string, value double")
    store.append(make(("a", "1", 1.0), ("b", "2", 2.0)))
    store.write(make(("a", "1", 3.0), ("a", "3", 4.0)))
    store.append(make(("a", "5", 5.0)))
    got = sorted((r.dataset, r.repertoire_id, r.value) for r in store.read().collect())
    assert got == [("a", "1", 3.0), ("a", "3", 4.0), ("a", "5", 5.0), ("b", "2", 2.0)]


def test_file_order_of_split_files(spark, tmp_path):
    ids = [f"r{(i * 7919) % 1000:04d}" for i in range(1000)]
    for name, some in (("a.csv", ids[:600]), ("b.csv", ids[600:])):
        (tmp_path / name).write_text("repertoire_id,filename,label_positive\n" + "".join(f"{i},{i}.tsv,{'True' if k % 3 else 'False'}\n\n" for k, i in enumerate(some)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = repertoires.scan_metadata(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 5
        assert [r.repertoire_id for r in got.orderBy("file_order").collect()] == ids
        assert sorted(r.file_order for r in got.collect()) == list(range(1000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stages_need_a_shared_folder_outside_local_mode():
    class Cluster:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster())


def test_cache_and_outputs(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert stores.cached_table(spark, path, lambda: spark.range(3)).count() == 3
    assert stores.cached_table(spark, path, lambda: spark.range(9)).count() == 3
    assert stores.scan_embeddings(spark, str(tmp_path / "none")) is None
    empty = stores.concat_outputs(spark, str(tmp_path / "nothing"))
    assert empty.count() == 0 and empty.columns[0] == "ID"


def test_ingest_reads_each_file_once(spark, tmp_path):
    source = tmp_path / "in" / "train_dataset_1"
    source.mkdir(parents=True)
    columns = ["junction_aa", "v_call", "j_call", "templates"]
    write = lambda name, seq: (source / name).write_text("\t".join(columns) + f"\n{seq}\tTRBV1\tNA\tx\n")
    run = lambda: ingest_new(spark, str(tmp_path / "in"), columns, str(tmp_path / "table"), str(tmp_path / "check"))
    write("a.tsv", "CASSF")
    run()
    write("b.tsv", "CAWF")
    run()
    run()
    got = {(r.dataset, r.repertoire_id, r.junction_aa, r.j_call, r.templates) for r in spark.read.parquet(str(tmp_path / "table")).collect()}
    assert got == {("train_dataset_1", "a", "CASSF", None, 1.0), ("train_dataset_1", "b", "CAWF", None, 1.0)}
    assert os.path.isdir(tmp_path / "check")
