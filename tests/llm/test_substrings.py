import random

import numpy as np
import plain
from clonara.llm import substrings


def got(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def repeats():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [rng.choices(vocabulary, k=k) for k in (19, 20, 21, 35, 60, 150)]
    docs = []
    for d in range(90):
        body = rng.choices(vocabulary, k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(body))
            body[at:at] = rng.choice(passages)
        docs.append((1000 - d, rng.choice([" ", "\n", "  "]).join(body)))
    return docs + [(2000, " ".join(passages[5] * 3)), (2001, "same " * 200), (2002, "same " * 30)]


def test_equals_brute_force(make_docs, odd_rows):
    docs = odd_rows + repeats()
    assert got(substrings.remove_repeats(make_docs(docs, 7))) == plain.without_repeats(docs)


def test_small_chunks_and_frequent_anchors(make_docs, monkeypatch):
    docs = repeats()
    want = plain.without_repeats(docs)
    monkeypatch.setattr(substrings, "frequent_anchors", lambda df: every)
    keyed = [w for _, t in docs for w in [t.encode().split()] if len(w) >= substrings.MIN_WORDS]
    chunk = substrings._Chunk()
    for i, w in enumerate(keyed):
        chunk.add(i, 0, substrings.WordHashes().array(w))
    anchors = np.unique(chunk.windows()[4])
    for every in (anchors, anchors[::2], anchors[:0]):
        assert got(substrings.remove_repeats(make_docs(docs, 5))) == want


def test_frequent_anchors_are_those_of_the_common_passage(make_docs):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    common = " ".join(f"c{i}" for i in range(40))
    docs = [(d, f"{' '.join(str(rng.random()) for _ in range(30))} {common} {rng.random()}") for d in range(600)]
    keyed = make_docs(docs, 2).select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("textkey"), F.col("text").cast("binary"))
    assert 0 < len(substrings.frequent_anchors(keyed)) < 40
    assert got(substrings.remove_repeats(make_docs(docs, 2))) == plain.without_repeats(docs)


def test_kept_text_null_ids_and_repeated_rows(make_docs):
    body = " ".join(f"v{i}" for i in range(30))
    docs = make_docs([(None, body), (5, body + " tail"), (5, body + " tail"), (6, "short")])
    rows = sorted((r.doc_id or -1, r.kept_text, r.n_removed) for r in substrings.remove_repeats(docs).collect())
    assert rows == [(-1, body, 0), (5, "tail", 30), (5, "tail", 30), (6, "short", 0)]
    two = make_docs([(5, body), (5, body + " x " + body), (6, body)])
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(two).collect()) == [(5, 30, 0), (5, 61, 30), (6, 30, 30)]
    again = make_docs([(5, body), (5, body)])
    assert [r.n_removed for r in substrings.remove_repeats(again).collect()] == [0, 0]


def test_texts_under_one_id_are_each_compared_with_other_chunks(make_docs, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = [(3, passage), (5, passage + " tail one"), (5, passage + " tail two"), (6, "x y " + passage), (6, passage)]
    for words in (10, 600_000):
        monkeypatch.setattr(substrings, "CHUNK_WORDS", words)
        rows = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(make_docs(docs, 1)).collect())
        assert rows == [(3, 20, 0), (5, 22, 20), (5, 22, 20), (6, 20, 20), (6, 22, 20)]
    for parts in (1, 2, 5):
        rows = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(make_docs(docs[1:], parts)).collect())
        assert rows == [(5, 22, 0), (5, 22, 0), (6, 20, 20), (6, 22, 20)]


def test_one_chunk_with_two_texts_under_an_id():
    passage = [f"p{i}" for i in range(20)]
    chunk, hashes = substrings._Chunk(), substrings.WordHashes()
    for key, words in ((1, passage), (2, passage), (2, passage), (3, ["x"] + passage)):
        chunk.add(5, key, hashes.array(words))
    doc, key, start, wh, _ = chunk.windows()
    order = np.lexsort((key, start, doc, wh))
    later, first = substrings._later_places(order, wh[order][1:] == wh[order][:-1], doc, key, start)
    assert sorted(zip(key[order][later].tolist(), start[order][later].tolist())) == [(3, 1)]
    assert sorted(key[order][first].tolist()) == [1, 2, 3]


def test_empty(make_docs):
    assert substrings.remove_repeats(make_docs([])).count() == 0
