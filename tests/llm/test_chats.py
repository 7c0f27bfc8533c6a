import random

import plain
from clonara.llm import chats
from clonara.llm.common import table

KIND = "conv_id long, turn long, role string, text string, seg long, a long, place string, n_turns string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "p", "n") for r in rows], KIND).repartition(3)


def rendered(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.conv_id, r.segment)):
        n, copies, text = out.get(r.conv_id, (r.n_turns, r.n_copies, ""))
        out[r.conv_id] = (n, copies, text + r.rendered)
    return out


def logs():
    rng = random.Random(5)
    rows, conv = [], 0
    for talk in range(40):
        turns = [(k, rng.choice(["user", "assistant"]), f"t{rng.randint(0, 3)} <|im_end|> é") for k in range(rng.randint(1, 9))]
        for _ in range(rng.randint(1, 6)):
            for k, role, text in turns[:rng.randint(1, len(turns))]:
                rows.append((conv, k * 3, role, text))
            conv += 1
    return rows


def test_equals_brute_force(spark):
    rows = logs()
    assert rendered(chats.render(frame(spark, rows))) == plain.chats(rows)


def test_segments_of_any_size_agree(spark):
    rows = logs() + [(900, k, "user", f"x{k}") for k in range(40)] + [(901, k, "user", f"x{k}") for k in range(39)] + [(902, k, "user", f"x{k}") for k in range(40)]
    for segment in (1, 4, 7):
        assert rendered(chats.render(frame(spark, rows), segment)) == plain.chats(rows)


def test_nulls_repeats_and_ties(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (2, 0, "user", "hi"), (None, 0, "user", "hi"), (3, -5, "", ""), (3, 2, "user", "ok")]
    assert rendered(chats.render(frame(spark, rows))) == plain.chats(rows)
    tie = [(1, 0, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "b")]
    got = rendered(chats.render(frame(spark, tie)))
    assert list(got) == [1] and got[1][:2] == (2, 2)


def test_whole_table(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rendered(chats.render(table(spark, "/root/testdata/sf0.01", "conversations"))) == plain.chats(rows)


def test_native_plan_and_empty(spark):
    df = chats.render(frame(spark, logs()))
    assert not any(word in df._jdf.queryExecution().toString() for word in ("Python", "Pandas", "ArrowEval"))
    assert chats.render(frame(spark, [])).count() == 0
