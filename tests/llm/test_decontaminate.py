import random

import plain
from clonara.llm import decontaminate
from clonara.llm.common import table

SF = "/root/testdata/sf0.001"


def pairs(df):
    return {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in df.collect()}


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 0.5) for i, t in rows], "item_id long, text string, doc_id int, containment double")


def test_sketch_has_more_than_a_document_may_miss():
    for n in range(1, 300):
        assert decontaminate.sketch_size(n, 0.8) >= min(n, int(0.2 * n + 1e-9) + 1)


def test_equals_brute_force_on_planted_passages(spark, make_docs, odd_rows):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 6, 9, 17, 40])))) for i in range(25)] + [(99, None), (100, ""), (101, "!!"), (7, "w1 w2 w3 w4 w5 w6")]
    docs = list(odd_rows)
    for d in range(60):
        body = rng.choices(vocabulary, k=rng.randint(0, 300))
        item = (rng.choice(items)[1] or "").upper().split()
        if item and d % 2:
            for p in rng.sample(range(len(item)), len(item) // 12):
                item[p] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = [f"{w}," for w in item]
        docs.append((1000 + d, " ".join(body)))
    found = decontaminate.find_leaks(make_docs(docs), items_of(spark, items))
    want = plain.leaks(docs, items)
    assert pairs(found) == want and len(want) > 20


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    whole = pairs(decontaminate.find_leaks(docs, items))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(decontaminate, "CHUNK_WORDS", 500)
    assert pairs(decontaminate.find_leaks(docs, items)) == whole and whole


def test_dropping_keeps_columns_null_ids_and_repeats(spark, make_docs):
    item = "alpha beta gamma delta epsilon zeta eta"
    docs = make_docs([(1, "clean text"), (1, "clean text"), (None, "more clean"), (2, f"so {item} it is"), (3, item)])
    kept = decontaminate.drop_leaked(docs, items_of(spark, [(1, item)]))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "more clean"), (1, "clean text"), (1, "clean text")]


def test_empty_tables(spark, make_docs):
    none = items_of(spark, [])
    assert decontaminate.find_leaks(make_docs([(1, "a b c d e f")]), none).count() == 0
    assert decontaminate.find_leaks(make_docs([]), items_of(spark, [(1, "a b c d e f")])).count() == 0
