import random

import plain
from clonara.llm import simhash
from clonara.llm.components import components


def classes(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def copies():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, n = [], 100
    for group in range(12):
        body = rng.choices(vocabulary, k=rng.choice([2, 30, 200, 600]))
        for _ in range(rng.choice([1, 2, 12])):
            text = list(body)
            for p in rng.sample(range(len(text)), min(2, len(text) // 100)):
                text[p] = rng.choice(vocabulary)
            docs.append((n, " ".join(text).title() if n % 3 == 0 else " ".join(text)))
            n += 1
    return docs


def test_equals_brute_force(make_docs, odd_rows):
    docs = odd_rows + copies()
    assert classes(simhash.near_duplicates(make_docs(docs))) == plain.near_classes(docs)


def test_large_buckets_are_linked_by_stars_alike(make_docs, odd_rows):
    docs = odd_rows + copies()
    want = plain.near_classes(docs)
    for bound in (0, 3):
        assert classes(simhash.near_duplicates(make_docs(docs), pairs_up_to=bound)) == want


def test_links_of_made_fingerprints(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)} | {0, 2**64 - 1}
    for fp in list(fps):
        for bits in (1, 2, 3, 4, 6):
            other = fp
            for b in rng.sample(range(64), bits):
                other ^= 1 << b
            fps.add(other)
    order = sorted(fps)
    rows = [(fp - 2**64 if fp >> 63 else fp, i) for i, fp in enumerate(order)]
    distinct = spark.createDataFrame(rows, "fp long, rep long").repartition(4)
    parent = list(range(len(order)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(order):
        for j in range(i):
            if (x ^ order[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = {i: find(i) for i in range(len(order)) if find(i) != i}
    for bound in (2048, 4, 0):
        assert {r.node: r.root for r in components(simhash.near_links(distinct, bound)).collect()} == want


def test_null_ids_repeats_and_kept_rows(make_docs):
    text = "a b c d e f g h i j"
    docs = make_docs([(None, text), (5, text), (5, text), (3, text), (None, "else where"), (9, "another text of words")])
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (5, 3), (5, 3), (9, 9)]
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, text), (-1, "else where"), (3, text), (9, "another text of words")]


def test_different_texts_under_one_id_are_kept_or_dropped_by_their_own_groups(make_docs):
    first, other, third = "a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z 1 2 3 4"
    docs = make_docs([(3, first), (5, first), (5, other), (5, other), (7, other), (9, third), (9, third + " 5 6 7 8 9"), (9, third.upper())])
    for bound in (simhash.PAIRS_UP_TO, 0):
        kept = sorted((r.doc_id, r.text.lower()) for r in simhash.one_of_each(docs, bound).collect())
        assert kept == [(3, first), (5, other), (9, third), (9, third + " 5 6 7 8 9")]
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (5, 5), (7, 5), (9, 9), (9, 9), (9, 9)]


def test_empty(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    rows = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert rows == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 180)} | {201: 200}
