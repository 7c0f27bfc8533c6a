import random

import numpy as np
import plain
from clonara.llm import near_copies
from clonara.llm.common import WordHashes


def copies(n=260, seed=3):
    """Texts with copies in which a share of the words is replaced, in one case of four very short."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs, d = [], 100
    for _ in range(n):
        body = rng.choices(vocabulary, k=rng.choice([3, 60, 200, 500]))
        docs.append((d, " ".join(body)))
        d += 1
        for _ in range(rng.choice([0, 1, 2])):
            text = list(body)
            for p in rng.sample(range(len(text)), int(len(text) * rng.choice([0, 0.005, 0.01, 0.02, 0.1]))):
                text[p] = rng.choice(vocabulary)
            docs.append((d, " ".join(text).upper() if d % 5 == 0 else "  ".join(text)))
            d += 1
    return docs


def kept(df):
    return sorted(r.doc_id for r in df.collect())


def test_equals_all_pairs_of_fingerprints(make_docs, odd_rows):
    docs = odd_rows + copies()
    want = sorted(d for d, root in plain.wide_classes(docs).items() if d == root)
    assert kept(near_copies.one_of_each(make_docs(docs))) == want
    assert len(docs) - len(want) > 100


def test_large_buckets_lose_nothing(make_docs, odd_rows):
    docs = odd_rows + copies(60) + [(5000 + i, " ".join(["same start of all these copies and then"] * 3 + [f"x{j}" for j in range(80)] + [f"end{i}"])) for i in range(50)]
    whole = kept(near_copies.one_of_each(make_docs(docs)))
    assert whole == sorted(d for d, root in plain.wide_classes(docs).items() if d == root)
    for rows in (1, 7):
        assert kept(near_copies.one_of_each(make_docs(docs), bucket_rows=rows)) == whole


def test_recall_by_exact_similarity():
    found = {b: [0, 0] for b in (0.8, 0.85, 0.9, 0.95)}
    rng, words = random.Random(11), WordHashes()
    rows, bits = near_copies.band_rows(0.8), near_copies.radius(0.8)
    far = [0, 0]
    for _ in range(1500):
        body = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([100, 300]))]
        other = list(body)
        for p in rng.sample(range(len(body)), rng.randint(0, max(1, len(body) // 12))):
            other[p] = f"w{rng.randrange(5000)}"
        a, b = " ".join(body), " ".join(other)
        s = plain.shingle_similarity(a, b)
        (fa, ka), (fb, kb) = (near_copies.sketch(t.encode(), words, 5, rows) for t in (a, b))
        linked = int(np.bitwise_count(fa ^ fb).sum()) <= bits and bool((ka == kb).any())
        if s >= 0.8:
            band = found[max(b for b in found if b <= s)]
            band[0] += linked
            band[1] += 1
        elif s < 0.65:
            far[0] += linked
            far[1] += 1
    assert all(n > 30 and hit >= 0.9 * n for hit, n in found.values()), found
    assert far[1] > 100 and far[0] <= 0.03 * far[1], far


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (30, 8), dtype=np.int64).view(np.uint64)
    rows = []
    for fp in base:
        for _ in range(rng.integers(1, 9)):
            fp = fp.copy()
            for bit in rng.integers(0, 512, rng.integers(0, 60)):
                fp[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
            rows.append(fp)
    fps = np.array(rows)[rng.permutation(len(rows))]
    near = [(i, j) for i in range(len(fps)) for j in range(i) if np.bitwise_count(fps[i] ^ fps[j]).sum() <= 40]
    want = plain.classes_of(range(len(fps)), near)
    for part in (fps, fps[:20]):
        child, parent = near_copies.forest(part, 40)
        n = len(part)
        assert plain.classes_of(range(n), list(zip(child.tolist(), parent.tolist()))) == (want if n == len(fps) else plain.classes_of(range(n), [p for p in near if max(p) < n]))


def test_nulls_repeats_texts_under_one_id_and_clashing_columns(make_docs):
    text, other = "a b c d e f g h i j", "k l m n o p q r s t"
    docs = make_docs([(None, text), (5, text), (5, other), (3, text), (3, text), (None, None), (9, None), (8, " "), (7, other.upper())])
    out = near_copies.one_of_each(docs)
    assert out.columns == docs.columns
    rows = sorted(((r.doc_id or -1, r.text or "") for r in out.collect()))
    assert rows == [(-1, ""), (-1, text), (3, text), (5, other), (8, " ")]
    assert near_copies.one_of_each(make_docs([])).count() == 0


def test_long_text_has_the_bits_of_a_plain_count():
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(9000)}" for _ in range(20_000))
    fp, _ = near_copies.sketch(text.encode(), WordHashes(), 5, 6)
    assert fp.tolist() == plain.wide_fingerprint(text).tolist()
