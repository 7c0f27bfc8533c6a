import random

import plain
import pytest
from clonara.llm import sentencepieces
from clonara.llm.common import table
from clonara.llm.queries import piece_model

ALPHABET = "ab \n▁é😀the.\x00\t  <0x0A>日İ"


@pytest.fixture(scope="module")
def of():
    return sentencepieces.codec(piece_model())


def texts():
    rng = random.Random(3)
    out = ["", " ", "  a  b ", "▁▁x ▁", "a\n\n b\n", "<s>x</s> <0x0A>", "x" * 3000, " " * 300, "the" * 200, "é́", "ab" * 30 + " " + "ba" * 30]
    return out + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(1500)]


def test_ids_are_the_librarys(of):
    for t in texts():
        assert of.encode(t) == of.library.encode(t), t
        ids, back = sentencepieces.encoded(piece_model(), [t])[0]
        assert sentencepieces.numbers(ids).tolist() == of.library.encode(t) and back == of.library.decode(of.library.encode(t))


def test_list_and_heap_agendas_agree(of):
    for t in texts():
        for w in of.split(t):
            assert of._short(list(w)) == of._long(w)


def test_decoding_is_the_librarys(of):
    rng = random.Random(4)
    for t in texts():
        ids = of.library.encode(t)
        assert of.decode(ids) == of.library.decode(ids)
    for _ in range(1500):
        ids = [rng.randrange(3, 259) if rng.random() < 0.6 else rng.randrange(259, 32000) for _ in range(rng.randint(0, 9))]
        assert of.decode(ids) == of.library.decode(ids)


def test_a_wrong_word_fails(of):
    with pytest.raises(ValueError):
        of.check(["▁the"], [[5, 6]])


def test_rows_of_odd_texts(make_docs, odd_rows, of):
    rows = odd_rows + [(None, "a null id"), (1, None)]
    got = sorted(((r.doc_id or -1, list(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentencepieces.tokenize(make_docs(rows), piece_model()).collect()))
    want = []
    for i, t in rows:
        ids = of.library.encode(t or "")
        want.append((i or -1, ids, len(ids), plain.sha(",".join(map(str, ids))), plain.sha(of.library.decode(ids))))
    assert got == sorted(want)


def test_whole_table_with_a_small_memory(spark, of, monkeypatch):
    monkeypatch.setattr(sentencepieces, "REMEMBERED", 2000)
    docs = [t or "" for t in table(spark, "/root/testdata/sf0.001", "documents").toPandas()["text"].tolist()]
    for a in range(0, len(docs), 20):
        part = docs[a:a + 20]
        want = of.library.encode(part)
        got = sentencepieces.encoded(piece_model(), part)
        assert [sentencepieces.numbers(ids).tolist() for ids, _ in got] == want and [back for _, back in got] == of.library.decode(want)


def test_empty(make_docs):
    assert sentencepieces.tokenize(make_docs([]), piece_model(), keep_ids=False).count() == 0
