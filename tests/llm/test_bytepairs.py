"""Byte-level encoding against the tiktoken library."""

import hashlib
import random
import sys

import numpy as np
import pytest
import tiktoken

from clonara.llm import bytepairs
from clonara.llm.queries import byte_ranks

FILE, PATTERN = byte_ranks()


@pytest.fixture(scope="module")
def codec():
    return bytepairs.ByteCodec(FILE, PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_knows_its_keys(codec):
    tokens = list(codec.ranks)
    assert sorted(codec.hash.places(tokens).tolist()) == list(range(len(tokens)))
    assert all(codec.whole(tokens))
    assert not any(codec.whole([b"no such token %d" % i for i in range(1000)]))
    again = bytepairs.PerfectHash(tokens, codec.hash.shift)
    assert np.array_equal(again.places(tokens), codec.hash.places(tokens))


def test_merging_a_token_gives_it_back(codec):
    some = random.Random(3).sample(sorted(codec.ranks), 2000)
    assert all(codec.decode_bytes(codec.merge(t)) == t for t in some)


def test_characters_as_the_library(codec, library):
    texts = [f"a{chr(i)}b {chr(i)}1" for i in [*range(0x20000), *range(0x20000, sys.maxunicode + 1, 97)] if not 0xD800 <= i <= 0xDFFF]
    got = bytepairs._Remembered(codec).encoded(texts)
    bad = [t for t, (ids, _), want in zip(texts, got, map(library.encode_ordinary, texts)) if ids != ",".join(map(str, want))]
    assert bad == []


def test_remembered_pieces_as_the_library(codec, library):
    letters = " \n\t\x0b\x1c\x85\xa0　  ab'sé1²Ⅷ.日😀́"
    draw = random.Random(1)
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 14))) for _ in range(20_000)]
    texts += ["x" * 5000, "no" * 70 + " " + "no" * 70, " " * 3000, "a\n" * 500, "日本語" * 900, "<|endoftext|> it's we'll"]
    memory = bytepairs._Remembered(codec)
    for _ in range(2):
        got = [x for g in bytepairs._groups(texts, 10_000) for x in memory.encoded(g)]
        for text, (ids, back) in zip(texts, got):
            assert ids == ",".join(map(str, library.encode_ordinary(text))) and back == text.encode()
    assert max(map(len, memory.plain)) <= bytepairs.LONG and max(map(len, memory.spaced)) <= bytepairs.LONG


def test_memory_is_bounded(codec, library, monkeypatch):
    monkeypatch.setattr(bytepairs, "REMEMBERED", 50)
    memory = bytepairs._Remembered(codec)
    for k in range(20):
        texts = [f"word{k} other{k}, again{i}" for i in range(30)]
        assert [ids for ids, _ in memory.encoded(texts)] == [",".join(map(str, library.encode_ordinary(t))) for t in texts]
        assert len(memory.spaced) + len(memory.spaced.before) < 300


def test_rows(spark, make_docs, odd_rows, library):
    rows = odd_rows + [(None, "no id"), (7, "the same words " * 40)]
    got = bytepairs.tokenize(make_docs(rows), FILE, PATTERN).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = []
    for doc, text in rows:
        ids = library.encode_ordinary(text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((doc, len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode()), ids))
    assert sorted([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got], key=key) == sorted(want, key=key)
    assert bytepairs.tokenize(make_docs([(1, "x")]).limit(0), FILE, PATTERN, keep_ids=False).count() == 0
