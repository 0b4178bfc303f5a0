"""Quotation linking against brute force."""

import random
import re

from pyspark.sql import functions as F

from weft.llm import chat_format
from weft.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"


def norm(t):
    p = " ".join(t.lower().split())
    return p if any(c.isalnum() for c in p) else None


def split(text):
    own, quotes, before = [], [], 0
    for line in (text or "").split("\n"):
        m = re.match(r"[ \t]*((?:>[ \t]*)+)", line)
        level = m[0].count(">") if m else 0
        rest = line[m.end():] if m else line
        if not level:
            own.append(line)
        elif level == before:
            quotes[-1][1].append(rest)
        else:
            quotes.append((level, [rest]))
        before = level
    return "\n".join(own).strip("\n"), own, [(lv, q) for lv, q in quotes if norm("\n".join(q))]


def brute(rows):
    parsed = [(c, t, r, *split(x)) for c, t, r, x in rows]
    has = [(c, t, {norm(mine), *map(norm, own), *map(norm, re.split(r"\n[ \t]*\n", mine))} - {None}) for c, t, _, mine, own, _ in parsed if t is not None]
    latest = lambda c, t, h: max((u for d, u, hs in has if d == c and u < t and h in hs), default=None)
    links = []
    for c, t, _r, _mine, _own, quotes in parsed:
        votes, linked = {}, 0
        for level, q in quotes if t is not None else []:
            whole = latest(c, t, norm("\n".join(q)))
            hits = [(whole, max(1, sum(1 for h in map(norm, q) if h)))] if whole is not None else []
            for part in [] if hits else re.split(r"\n(?:\s*\n)+", "\n".join(q)):
                lines = [h for h in map(norm, part.split("\n")) if h]
                one = latest(c, t, norm(part)) if norm(part) else None
                hits += [(one, max(1, len(lines)))] if one is not None else [(u, 1) for u in (latest(c, t, h) for h in lines) if u is not None]
            linked += bool(hits)
            for u, w in hits:
                votes[u] = votes.get(u, 0) + (w if level == 1 else 0)
        top = max(((v, u) for u, v in votes.items()), default=(0, None))
        links.append((top[1] if top[0] else None, linked))
    parent = {}
    for (c, t, *_), (p, _) in zip(parsed, links):
        if p is not None:
            parent[(c, t)] = min(p, parent.get((c, t), p))
    out = []
    for (c, t, r, mine, _own, quotes), (p, linked) in zip(parsed, links):
        thread, depth, at = t, 0, p
        while at is not None:
            thread, depth, at = at, depth + 1, parent.get((c, at))
        out.append((c, t, r, p, thread, depth, len(quotes), linked, mine))
    return sorted(out, key=str)


def compare(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("thread", F.lit("own"))
    got = sorted((tuple(r) for r in chat_format.link_quotes(df).collect()), key=str)
    assert got == brute(rows)
    return got


def test_made_conversations(spark):
    rng = random.Random(12)
    rows = []
    for c in range(12):
        texts = []
        for t in range(rng.randrange(1, 25)):
            own = "\n".join(rng.choice(["Hello there", "common line", f"point {rng.randrange(40)}", "", "?!", "Ünï code  x"]) for _ in range(rng.randrange(1, 5)))
            quote = []
            for _ in range(rng.randrange(3) if texts else 0):
                source = rng.choice(texts).split("\n")
                a = rng.randrange(len(source))
                part = source[a:a + rng.randrange(1, 4)]
                quote += [rng.choice(["> ", ">", " > "]) + (p.upper() if rng.random() < 0.3 else p) for p in part] + rng.choice([[], [""], ["reply"]])
            texts.append("\n".join(quote + [own]))
            rows.append((c if c else None, t * rng.choice([1, 700]), rng.choice(["user", "assistant", None]), texts[-1]))
    got = compare(spark, rows)
    assert sum(r[3] is not None for r in got) > 20 and max(r[5] for r in got) >= 3


def test_edge_rows(spark):
    rows = [(1, 0, "user", "first"), (1, 1, "user", "> first\nsecond"), (1, 1, "user", "> first\nsecond"), (1, 2, "x", ">> first\n> second\nthird"), (1, None, "x", "> first"), (1, 5000, "x", "> third\nlast"), (2, 0, None, None), (2, 1, "u", "> "), (None, 0, "u", "first"), (None, 1, "u", "> FIRST "), (3, 0, "u", "long " * 50_000), (3, 1, "u", "> " + "long " * 50_000)]
    compare(spark, rows)
    assert chat_format.link_quotes(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def test_rewrapped_paragraphs(spark):
    long = "one two three four\nfive six\n\nseven eight nine\nten"
    rows = [(1, 0, "u", long), (1, 1, "u", "seven eight nine"), (1, 2, "u", "> one two\n> three four five six\n>\n> seven eight\n> nine ten\nyes"), (1, 3, "u", "> zero\n> four\n> \n> seven eight nine\nno")]
    got = compare(spark, rows)
    assert [(r[1], r[3]) for r in got] == [(0, None), (1, None), (2, 0), (3, 1)]


def test_long_chain_and_format(spark):
    rows = [(7, t, "user", (f"> msg {t - 1}\n" if t else "") + f"msg {t}") for t in range(70)]
    got = compare(spark, rows)
    assert max(r[5] for r in got) == 69 and {r[4] for r in got} == {0}
    out = chat_format.formatted(chat_format.link_quotes(spark.createDataFrame(rows, SCHEMA))).orderBy("thread", "turn").first()
    assert out.turn_text == "<|user|>\nmsg 0\n<|end|>\n"


def test_table(spark):
    df = table(spark, "/root/testdata/sf0.001", "conversations")
    assert chat_format.link_quotes(df).count() == df.count()
