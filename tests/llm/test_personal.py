import random

import plain
from clonara.llm import personal
from clonara.llm.common import table

CARD = "4111 1111 1111 1111"
ODD = ["a@b.c", "x@@y.z", "a@b", "me@x-.y..z", "a.b@c.d_e@f.g", "..@a.b", "1.2.3.4.5.6.7.8", "999.1.2.3 1.2.3.4", "001.002.003.0255", CARD, CARD.replace(" ", "-"), CARD + "5",
       "+1 (017) 555-7713", "+12", "+1 2345678.", "+1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6", "++1 555 000 111 222+33 44 55 66", "é a@b.co 😀 1.1.1.1", "+" + "1" * 40, "a" * 300 + "@" + "b" * 300 + ".c",
       "0" * 16, "1" * 200, "%%%@%.%", "me@h.o me@h.o,me@h.o"]


def counts(spans):
    return [sum(s[0] == k for s in spans) for k in personal.KINDS]


def test_base_spans_equal_brute_force():
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choice("a1@.+- ()_é%9") for _ in range(rng.randint(0, 70))) for _ in range(4000)]
    for t in texts:
        assert [(personal.KINDS[k], a, b) for k, a, b in personal.base_spans(t)] == plain.personal(t), t


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in personal.find_personal(docs).collect():
        base = plain.personal(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts(base)
        assert r.base_sha256 == plain.sha(plain.listed(base))
        assert set(plain.listed(base).split(",")) <= set(r.spans.split(","))


def contexts():
    docs = [(i, f"note {i}\nmail: user{i}@site.org, more") for i in range(40)]
    docs += [(100 + i, f"entry {i} mail: user{i}_at_site9 end") for i in range(3)]
    docs += [(200 + i, f"entry mail: none here") for i in range(2)]
    docs += [(300 + i, f"page: {i}77777 is no data, ip= 10.0.0.{i}") for i in range(8)]
    return docs + [(400, "ip = 10.0.0.x9, page: 12345"), (401, None), (None, "mail: someone7-else")]


def test_contexts_of_seeds_discover_unseen_identifiers(make_docs):
    rows = {r.doc_id: r for r in personal.find_personal(make_docs(contexts())).collect()}
    assert rows[101].spans == "email:14:28" and rows[101].n_email == 0 and rows[101].base_sha256 == plain.sha("")
    assert rows[None].spans == "email:6:19"
    assert rows[5].spans == "email:13:27"
    assert rows[200].spans == "" and rows[401].spans == ""
    assert rows[303].spans == "ip:29:37"
    assert rows[400].spans == "ip:5:14"


def test_patterns_with_many_other_instances_are_not_believed(make_docs):
    docs = [(i, f"see: u{i}@site.org") for i in range(10)] + [(100 + i, f"see: chapter{i}") for i in range(10)]
    assert all(r.spans == "" for r in personal.find_personal(make_docs(docs)).collect() if r.doc_id >= 100)


def test_masking_both_ways(make_docs):
    text = f"mail: a@b.co, card {CARD} or 1.2.3.4"
    want = "mail: [EMAIL], card [CARD] or [IP]"
    plain_docs = make_docs([(1, text), (2, None), (3, ""), (None, text)])
    masked = personal.mask_personal(plain_docs)
    assert masked.columns == plain_docs.columns
    assert sorted((r.doc_id or -1, r.text, r.n_chars) for r in masked.collect() if r.text) == [(-1, want, len(want)), (1, want, len(want))]
    rows = {r.doc_id: r for r in personal.mask_personal(make_docs(contexts() + [(1, text), (1, text)])).collect() if r.doc_id != 1}
    assert rows[101].text == "entry 1 mail: [EMAIL] end" and rows[401].text is None and rows[None].text == "mail: [EMAIL]"
    assert len(rows) == len(contexts()) - 1


def test_long_identifiers_are_marked_and_masked_to_their_end(make_docs):
    seeds = [(i, f"mail: user{i}@site.org, more") for i in range(40)]
    long = {65: "h" * 64 + "7", 1000: "k9_" + "x" * 997, 90: "h" * 64 + "8" * 26}
    docs = make_docs(seeds + [(100 + n, f"mail: {token} end") for n, token in long.items()] + [(2000, f"mail: {'j7' * 40}/a@b.co end")])
    spans = {r.doc_id: r.spans for r in personal.find_personal(docs).collect()}
    assert {n: spans[100 + n] for n in long} == {n: f"email:6:{6 + n}" for n in long}
    texts = {r.doc_id: r.text for r in personal.mask_personal(docs).collect()}
    assert {texts[100 + n] for n in long} == {"mail: [EMAIL] end"} and texts[2000] == "mail: [EMAIL][EMAIL] end"
    words = [w for _, w, *_ in personal.candidates(f"id: {long[65]} id: {long[90]}", [])]
    assert words == [long[65], long[90]]


def test_shaped_identifiers_are_found_on_mixed_cues_and_without_signs(make_docs):
    docs = [(i, f"tel: +1 555 010 {1000 + i}") for i in range(70)] + [(100 + i, f"tel: 555 123 {4000 + i}.") for i in range(30)]
    docs += [(200 + i, f"tel: none{i}") for i in range(40)]
    docs += [(300 + i, f"please call +44 20 7946 {1000 + i} now") for i in range(40)] + [(400, "please call 555 123 4567 now"), (401, "in 2019-05-03 we sold 1234567 units")]
    docs += [(500 + i, f"see: +1 555 020 {1000 + i}") for i in range(6)] + [(600 + i, f"see: 2019 05 {1000 + i}") for i in range(12)]
    rows = {r.doc_id: r.spans for r in personal.find_personal(make_docs(docs)).collect()}
    assert {rows[100 + i] for i in range(30)} == {"phone:5:17"} and rows[400] == "phone:12:24"
    assert {rows[200 + i] for i in range(40)} | {rows[600 + i] for i in range(12)} | {rows[401]} == {""}
    texts = {r.doc_id: r.text for r in personal.mask_personal(make_docs(docs)).collect()}
    assert texts[100] == "tel: [PHONE]." and texts[400] == "please call [PHONE] now"


def test_function_words_before_numbers_gain_nothing_and_a_rare_cue_finds_unseen_ones(make_docs):
    docs = [(i, f"we saw the +1 555 010 {1000 + i} and the house by the lake while the rain fell on the roof of the barn") for i in range(40)]
    docs += [(100 + i, f"over the 555 123 {4000 + i} units the price of the goods fell") for i in range(5)]
    docs += [(200 + i, f"a note with pager +44 20 7946 {1000 + i} at its end") for i in range(30)]
    docs += [(300 + i, f"a note with pager 555 987 {1000 + i} at its end") for i in range(10)]
    docs += [(400 + i, "the day was long and the night was short in the far north of the land") for i in range(200)]
    got = {r.doc_id: r.spans for r in personal.find_personal(make_docs(docs)).collect()}
    assert {got[100 + i] for i in range(5)} == {""}
    assert {got[300 + i] for i in range(10)} == {"phone:18:30"}


def test_patterns_equal_a_plain_scorer(make_docs):
    rng = random.Random(9)
    cues = ["mail", "the", "fax", "host", "id", "ask"]
    docs = []
    for i in range(600):
        cue, sign = rng.choice(cues), rng.choice([": ", "= ", " "])
        what = rng.choice([f"u{rng.randint(0, 60)}@site.org", f"+1 555 010 {rng.randint(1000, 1080)}", f"555 010 {rng.randint(1000, 1080)}", f"10.0.0.{rng.randint(0, 40)}", f"none{rng.randint(0, 9)}"])
        if cue == "mail" and rng.random() < 0.9:
            what = f"u{rng.randint(0, 200)}@site.org"
        if cue == "fax" and rng.random() < 0.9:
            what = f"+1 555 010 {rng.randint(1000, 1200)}"
        docs.append((i, f"{rng.choice(['so', 'and', 'the', 'then'])} {cue}{sign}{what} now " + "the rain fell " * rng.randint(0, 6)))
    table_ = make_docs(docs)
    found = personal.stage(personal.scan(table_), "found")
    specific = personal.specific_patterns(found, personal.word_counts(table_))
    want_specific, want = plain.patterns([t for _, t in docs], personal)
    assert {(r.pattern, r.kind) for r in specific.collect()} == want_specific
    assert {(r.pattern, r.found_kind) for r in personal.score_patterns(found, specific).collect()} == want and len(want) > 1


def test_overlapping_spans_are_masked_once():
    assert personal.masked("0123456789", [(2, 2, 6), (3, 4, 8), (0, 2, 4)]) == "01[CARD]89"


def test_empty(make_docs):
    assert personal.find_personal(make_docs([])).count() == 0
    assert personal.mask_personal(make_docs([])).count() == 0
