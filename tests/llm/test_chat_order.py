"""The conversations that the query builds: reply order and turn texts."""

import random

from weft.llm import chat_format, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def order(r):
    return (r.thread is None, r.thread or 0, r.turn or 0, r.role is not None, r.role or "")


def test_place(spark):
    rng = random.Random(5)
    rows = [(None, 0, "user", "a1"), (None, 1, None, "b1"), (None, 2, "user", "> a1\nc1"), (None, None, "user", "lost"), (None, -5000, "user", "early")]
    rows += [(2, t * 300, "user", (f"> m {rng.randrange(t)}\n" if t and rng.random() < 0.7 else "") + f"m {t}") for t in range(40)]
    rows += [(2, 600, "assistant", "twin"), (3, 7, None, None)]
    got = chat_format.formatted(chat_format.placed(chat_format.link_quotes(spark.createDataFrame(rows, SCHEMA)))).collect()
    assert len(got) == len(rows)
    for conv in (None, 2, 3):
        mine = [r for r in got if r.conv_id == conv]
        assert [r.place for r in sorted(mine, key=order)] == list(range(len(mine)))
    assert [r.own_text for r in sorted((r for r in got if r.conv_id is None), key=lambda r: r.place)] == ["early", "a1", "c1", "b1", "lost"]
    assert next(r.turn_text for r in got if r.own_text == "b1") == "<|unknown|>\nb1\n<|end|>\n"


def test_query(spark):
    got = queries.op10_chat_format(spark, "/root/testdata/sf0.001").collect()
    places = {}
    for r in got:
        assert r.turn_text.endswith(r.own_text + "\n<|end|>\n") and r.turn_text.startswith(f"<|{r.role}|>\n")
        places.setdefault(r.conv_id, []).append(r)
    for mine in places.values():
        assert [r.place for r in sorted(mine, key=order)] == list(range(len(mine)))
