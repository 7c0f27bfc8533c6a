import zlib

import numpy as np
from clonara.llm import language
from clonara.llm.common import table

SF = "/root/testdata/sf0.01"
PROSE = {"en": "the house and the garden were quiet in the evening", "de": "das haus und der garten waren am abend ganz ruhig",
         "fr": "la maison et le jardin étaient calmes dans la soirée"}


def labelled(n=120):
    rows = []
    for i in range(n):
        lang = list(PROSE)[i % 3]
        ws = PROSE[lang].split()
        rows.append((i, " ".join(ws[(i + k) % len(ws)] for k in range(4 + i % 9)), lang))
    return rows


def test_held_out_accuracy_on_the_documents(spark):
    docs = table(spark, SF, "documents")
    model = language.fit(docs)
    got = docs.select("doc_id", "lang", "text").join(language.predict(docs, model), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").toPandas()
    assert len(got) > 100 and (got["lang"] == got["lang_pred"]).mean() >= 0.97
    assert got["score"].between(0, 1).all()


def test_fold_and_unknown_texts(make_docs, odd_rows):
    docs = make_docs(labelled() + [(1000 + i, t) for i, t in odd_rows] + [(None, "das haus und der garten")])
    rows = language.predict(docs, language.fit(docs)).collect()
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    by_id = {r.doc_id: r for r in rows}
    for i, t in odd_rows:
        r = by_id[1000 + i]
        letter = any(c.isalpha() for c in t or "")
        assert (r.lang_pred == "und") == (not letter) and (letter or (r.score == 0 and r.rejected))
        assert r.lang_pred in {"und", *PROSE}
    assert by_id[None].lang_pred == "de"


def test_labels_of_held_out_rows_are_not_learned(make_docs):
    rows = labelled()
    turned = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    a, b = language.fit(make_docs(rows)), language.fit(make_docs(turned))
    assert a.languages == b.languages and np.array_equal(a.vectors, b.vectors)


def test_draw_is_bounded_even_and_without_repeats(make_docs):
    rows = labelled(900) + [(5000, "the same row again and again", "en")] * 400
    for most in (30, 120):
        got = language.drawn(make_docs(rows).select("doc_id", "text", "lang"), most).collect()
        assert len({(r.doc_id, r.text) for r in got}) == len(got)
        assert [sum(r.lang == lang for r in got) for lang in PROSE] == [most // 3] * 3
    assert language.fit(make_docs(rows), sample_rows=120).languages == sorted(PROSE)
    assert language.drawn(make_docs([]).select("doc_id", "text", "lang"), 10) is None


def test_rejection_bound_equals_a_plain_count():
    rng = np.random.default_rng(4)
    for n, m in ((5000, 5000), (300, 900), (4, 0)):
        right, noise = rng.beta(9, 1, n), rng.beta(2, 4, m)
        bins = lambda v: np.bincount((v * language.BINS).astype(int), minlength=language.BINS)
        bound = language.rejection_bound(bins(right), bins(noise))
        assert (right < bound).sum() <= language.REJECT_SHARE * n
        step = 1 / language.BINS
        assert (m == 0 and bound == 0) or (noise < bound).sum() >= language.NOISE_SHARE * m or (right < bound + step).sum() > language.REJECT_SHARE * n
    assert language.rejection_bound(np.zeros(language.BINS), np.ones(language.BINS)) == 0


def test_texts_of_shuffled_letters_are_rejected(make_docs):
    rows = labelled(3000)
    model = language.fit(make_docs(rows), sample_rows=900, bound_rows=1500)
    noise = [(9000 + i, language.shuffled(t)) for i, t, _ in rows[:200]]
    got = {r.doc_id: r.rejected for r in language.predict(make_docs(rows + noise), model).collect()}
    assert sum(got[i] for i, _, _ in rows) <= 0.005 * len(rows)
    assert sum(got[i] for i, _ in noise) >= 0.5 * len(noise)
    kept = {r.doc_id for r in language.keep_identified(make_docs(rows + noise), model).collect()}
    assert kept == {i for i, rejected in got.items() if not rejected}


def test_subwords_match_a_plain_count():
    text = "Élan_2 été!"
    a = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in f" {text} ".lower().encode())
    want = sum(b" " not in a[i + 1:i + n - 1] for n in (3, 4) for i in range(len(a) - n + 1))
    assert len(language.subwords(text)) == want and language.subwords(text).max() < language.BUCKETS


def test_nothing_learned_and_empty(make_docs):
    docs = make_docs([(1, "no label here"), (2, None)])
    assert language.fit(docs) is None
    assert {(r.lang_pred, r.score, r.rejected) for r in language.predict(docs, None).collect()} == {("und", 0.0, True)}
    assert language.predict(make_docs([]), None).count() == 0
    assert [r.doc_id for r in language.keep_identified(docs).collect()] == [1]


def test_one_language(make_docs):
    docs = make_docs([(i, "only one language", "en") for i in range(30)])
    assert {r.lang_pred for r in language.predict(docs, language.fit(docs)).collect()} == {"en"}


def test_keeping_returns_the_rows_unchanged(make_docs, odd_rows):
    docs = make_docs(labelled() + [(1000 + i, t) for i, t in odd_rows])
    model = language.fit(docs)
    kept = language.keep_identified(docs, model)
    want = {r.doc_id for r in language.predict(docs, model).collect() if not r.rejected}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    assert set(range(120)) <= want


def last_drawn(spark, rows):
    """Place of the learnable row whose hash comes last, which no draw in the order of the hashes reaches."""
    from pyspark.sql import functions as F

    known = spark.createDataFrame(rows, "doc_id long, text string, lang string").filter(~language.held_out())
    last = known.orderBy(F.xxhash64("doc_id", "text").desc()).first()
    return next(i for i, r in enumerate(rows) if r[0] == last.doc_id)


def many():
    return [(i, f"{t} {i}", lang) for i, t, lang in labelled(18_600)]


def test_every_row_trains(spark, make_docs):
    rows = many()
    at = last_drawn(spark, rows)
    other = rows[:at] + [(rows[at][0], rows[at][1], next(lang for lang in PROSE if lang != rows[at][2]))] + rows[at + 1:]
    a, b = language.fit(make_docs(rows)), language.fit(make_docs(other))
    assert not np.array_equal(a.vectors, b.vectors)


def test_learners_see_each_different_row_once_in_any_order(make_docs, monkeypatch):
    monkeypatch.setattr(language, "CELL_ROWS", 50)
    monkeypatch.setattr(language, "LANG_ROWS", 4)
    rows = labelled(900) + [(5000 + i, "una casa y un jardín tranquilo", "es") for i in range(5)]
    a, b = language.fit(make_docs(rows)), language.fit(make_docs(rows[::-1] + rows[:200], partitions=7))
    assert np.array_equal(a.vectors, b.vectors) and (a.temperature, a.reject_below) == (b.temperature, b.reject_below)
    asked = [(9000 + i, t) for i, t in enumerate([*PROSE.values(), "una casa y un jardín tranquilo"])]
    got = {r.doc_id: r.lang_pred for r in language.predict(make_docs(asked), a).collect()}
    assert [got[9000 + i] for i in range(4)] == [*PROSE, "es"]


def test_counts_of_joined_texts(odd_rows):
    texts = [t for _, t in odd_rows] + ["Élan_2 été!", "a", "Σας"]
    for t, got in zip(texts, language.shares(texts)):
        n = np.bincount(language.subwords(t or ""), minlength=language.BUCKETS)
        assert np.allclose(got, n / max(n.sum(), 1))


def test_rows_of_one_half_set_no_bound(make_docs):
    model = language.fit(make_docs([(1, "one row alone", "en")]))
    assert model.languages == ["en"] and model.reject_below == 0


def test_keeping_takes_its_bound_from_every_different_row(make_docs, monkeypatch):
    rows, seen = many(), []
    monkeypatch.setattr(language, "rejection_bound", lambda right, noise: seen.append((right.sum(), noise.sum())) or 0.0)
    assert language.keep_identified(make_docs(rows + rows[:50])).count() == len(rows) + 50
    learnable = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in rows)
    assert seen[0][1] == learnable and 0.9 * learnable < seen[0][0] <= learnable
