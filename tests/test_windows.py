"""Windows counted where a repertoire's rows lie together: plans, odd letters, and both sides of the bound on a group's rows."""

import re
import zlib

import pyarrow as pa
import pytest

from clonara.constants import REP
from clonara.operators import kmers, windows
from clonara.plans.catalogue import QUERIES
from support import SF

AA = "ACDEFGHIKLMNPQRSTVWY"
ODD = ["CASSLAPGF", "CASSLAPGF", "CASSX*YF", "CA", "", None, "straße über", "日本語日本語日本", "CASSF\n", "cassyf", "😀😀😀😀😀", "AAAAAAAA", "CÁSS", "W" * 40]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, r, s) for d, r, step in (("d_1", "r1", 1), ("d_1", "r2", 2), ("d_2", "r1", 3), (None, "r1", 4), ("d_2", None, 5)) for s in ODD[::step]]
    return spark.createDataFrame(rows, "dataset string, repertoire_id string, junction_aa string")


def plain(df, ks, once=False, strict=False):
    """Counts by loops over the rows."""
    found = {}
    for r in df.collect():
        s = r.junction_aa or ""
        for k in ks:
            cut = [s[i:i + k] for i in range(len(s) - k + 1)]
            for w in set(cut) if once else cut:
                if not strict or re.fullmatch(f"[{AA}]+\n?", s) or re.fullmatch(f"[{AA}]+\n?", w):
                    found[r.dataset, r.repertoire_id, k, w] = found.get((r.dataset, r.repertoire_id, k, w), 0) + 1
    return found


def as_dict(counts):
    rows = counts.collect()
    out = {(r.dataset, r.repertoire_id, r.k, r.kmer): r["count"] for r in rows}
    assert len(out) == len(rows)
    return out


def shuffles(df):
    """What the exchanges of a plan deal rows out by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


@pytest.mark.parametrize("bound", [windows.GROUP_ROWS, 5, 0])
def test_counts_are_those_of_a_loop(odd, monkeypatch, bound):
    monkeypatch.setattr(windows, "GROUP_ROWS", bound)
    for ks in ((3,), (1, 3, 5), (3, 8)):
        for once in (False, True):
            assert as_dict(kmers.kmer_counts(odd, ks, once_per_row=once)) == plain(odd, ks, once)
    assert as_dict(kmers.kmer_counts(odd, (3, 4), valid_only=True)) == plain(odd, (3, 4), strict=True)


def test_wide_alphabets(spark):
    wide = spark.createDataFrame([("d", f"r{i % 3}", "".join(chr(0x4E00 + (i * 37 + j * 101) % 3000) for j in range(9))) for i in range(400)],
                                 "dataset string, repertoire_id string, junction_aa string")
    assert as_dict(kmers.kmer_counts(wide, (2, 6))) == plain(wide, (2, 6))


def test_blocks_hold_whole_groups(monkeypatch):
    monkeypatch.setattr(windows, "BLOCK_LETTERS", 6)
    lists = [["CAS", "CA"], [], ["SSSSSSSS"], ["A"], ["é", "CAS"]]
    whole = pa.RecordBatch.from_arrays([pa.array(["x", "y", *"abcde"]), pa.array([["Q"], ["W"], *lists], pa.list_(pa.string()))], names=["g", "s"])
    blocks = [(first, len(b.sizes), b.sizes.tolist(), b.lengths.tolist()) for _, first, b in windows._blocks([whole.slice(2)])]
    assert sum(n for _, n, _, _ in blocks) == 5 and len(blocks) > 2
    assert [n for b in blocks for n in b[2]] == [2, 0, 1, 1, 2] and [n for b in blocks for n in b[3]] == [3, 2, 8, 1, 1, 3]


@pytest.mark.parametrize("bound", [windows.GROUP_ROWS, 5])
def test_hashed_statistics_are_those_of_a_loop(odd, monkeypatch, bound):
    monkeypatch.setattr(windows, "GROUP_ROWS", bound)
    got = {(r.dataset, r.repertoire_id, r.k, r.bucket): (r.mean, r.std, r.max) for r in kmers.hashed_statistics(odd, (3, 4), 16).collect()}
    shares, sizes = {}, {}
    for r in odd.dropna(subset=REP).collect():
        s = (r.junction_aa or "").upper()
        if len(s) < 5 or not re.fullmatch(f"[{AA}X*.-]+\n?", s):
            continue
        key = (r.dataset, r.repertoire_id)
        sizes[key] = sizes.get(key, 0) + 1
        for k in (3, 4):
            own = {}
            for w in (s[i:i + k] for i in range(len(s) - k + 1)):
                if re.fullmatch(f"[{AA}]+\n?", w):
                    b = zlib.crc32(w.encode()) % 16
                    own[b] = own.get(b, 0) + 1
            for b, c in own.items():
                shares.setdefault((*key, k, b), []).append(c / (len(s) - k + 1))
    assert got.keys() == shares.keys()
    for key, xs in shares.items():
        n = sizes[key[:2]]
        mean = sum(xs) / n
        want = (mean, max(sum(x * x for x in xs) / n - mean * mean, 0) ** 0.5, max(xs))
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[key], want, strict=True))


def test_a_large_repertoire_is_spread(odd, monkeypatch):
    monkeypatch.setattr(windows, "GROUP_ROWS", 5)
    assert any("kmer" in by for by in shuffles(kmers.kmer_counts(odd, (3,))))


def test_kmer_freq_shuffles_no_windows(odd):
    df = kmers.kmer_frequencies(odd)
    assert shuffles(df) and not any("kmer" in by or "junction_aa" in by for by in shuffles(df))


QUERIES_OF_WINDOWS = ["kmer_freq", "extract_hashed", "kmer_hashed", "extract_extended", "kmer_freq_raw", "extract_counts",
                      "kmer_multiscale", "extract_stacked", "extract_pairs", "kmer_counts_words", "extract_significant",
                      "extract_features", "kmer_presence", "extract_usage", "sparse_features"]


@pytest.mark.parametrize("name", QUERIES_OF_WINDOWS)
def test_queries_shuffle_no_windows(spark, name):
    by = shuffles(QUERIES[name](spark, SF))
    dealt = r"\bfeature#" if name == "sparse_features" else r"\bk#\d+, (kmer|bucket|junction_aa)#"
    assert by and not [b for b in by if re.search(dealt, b)]
