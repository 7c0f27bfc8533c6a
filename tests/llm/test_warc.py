import base64
import gzip
import hashlib

from clonara.llm import warc
from clonara.session import shared_path

KIND = "page_id long, url string, html string, digest string, payload string, refers_to long, archive string"


def pages(spark, rows):
    return spark.createDataFrame([(p, u, h, "d", "p", 5, "a") for p, u, h in rows], KIND).repartition(3)


ROWS = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "http://a/\r\n4", ""), (5, "u", "a\r\n\r\nb\r\n\r\nWARC/1.1\r\n"),
        (6, "u", "é😀\x00" * 300), (7, "u", "x" * 3_000_000), (8, "http://a/1", "<p>one</p>"), (9, "u", "\n"), (None, "u", "<p>one</p>"), (None, "u", "alone")]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip_of_odd_pages(spark):
    got = [r for r in warc.round_trip(pages(spark, ROWS)).collect()]
    assert len(got) == len(ROWS)
    by_id = {r.page_id: r for r in got if r.page_id is not None}
    last = {}
    for p, _, h in ROWS:
        if p is not None:
            last[h or ""] = max(p, last.get(h or "", p))
    for p, url, h in ROWS:
        if p is None:
            continue
        r, size = by_id[p], len((h or "").encode())
        assert (r.payload_bytes, r.payload_digest) == (size, digest(h))
        assert (r.record_type, r.refers_to) == (("response", None) if last[h or ""] == p else ("revisit", last[h or ""]))
        if r.record_type == "response":
            assert bytes(r.payload).decode() == (h or "")
    loose = sorted((r.record_type, r.refers_to) for r in got if r.page_id is None)
    assert loose == [("response", None), ("revisit", 8)]


def test_least_size_keeps_small_repeats(spark):
    got = warc.round_trip(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]), least_bytes=5).collect()
    assert {r.page_id: (r.record_type, r.refers_to) for r in got} == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_repeated_rows_of_the_kept_page_are_responses(spark):
    got = warc.round_trip(pages(spark, [(2, "u", "ab"), (2, "u", "ab"), (1, "u", "ab")])).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "revisit"), (2, "response"), (2, "response")]


def test_index_gives_each_record_as_a_member(spark):
    path = shared_path(spark, "warc-test")
    warc.write_streams(pages(spark, ROWS), f"{path}/streams")
    index = warc.normalise(spark, f"{path}/streams", f"{path}/members").collect()
    assert len(index) == len(ROWS)
    for r in index:
        with open(r.archive.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            record = gzip.decompress(f.read(r.length))
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and record.endswith(b"\r\n\r\n")
        assert r.payload_digest.encode() in record


def test_small_pieces_and_many_members(spark):
    rows = [(i, "u", f"page {i} " * (i % 50)) for i in range(400)]
    path = shared_path(spark, "warc-test")
    warc.write_streams(pages(spark, rows), f"{path}/streams")
    index = warc.normalise(spark, f"{path}/streams", f"{path}/members")
    whole = {(r.page_id, r.payload_digest, r.payload_bytes) for r in warc.read_records(index).collect()}
    parts = {(r.page_id, r.payload_digest, r.payload_bytes) for r in warc.read_records(index, piece_bytes=500).collect()}
    assert whole == parts == {(p, digest(h), len(h)) for p, _, h in rows}


def test_both_ways_to_find_repeats_agree(spark, monkeypatch):
    rows = lambda: sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.round_trip(pages(spark, ROWS)).collect())
    want = rows()
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert rows() == want


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
