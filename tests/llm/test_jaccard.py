"""The similarity join against brute force: real texts, made sets around the threshold, forced blocks."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import jaccard_join
from weft.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Sorted (id, size, component); rows are told apart by place, as ids may be null or repeat."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted((k for k in range(len(rows)) if sets[k]), key=lambda k: len(sets[k]))
    for x, a in enumerate(order):
        for b in order[x + 1:]:
            if 100 * len(sets[a]) < 75 * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return sorted(((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def compare(df, **options):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = jaccard_join.near_duplicates(df, **options).collect()
    want = brute(rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    return want


def variants(seed, n, length):
    rng = random.Random(seed)
    out = []
    for g in range(n):
        base = [f"w{rng.randrange(50)}" for _ in range(length)]
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, length // 12))):
                w[rng.randrange(len(w))] = rng.choice(["x", "Y", "z", f"q{rng.randrange(9)}"])
            cut = rng.randrange(0, max(1, length // 5))
            out.append(" ".join(w[: len(w) - cut]).swapcase() if rng.random() < 0.2 else " ".join(w[: len(w) - cut]))
            base = w if rng.random() < 0.5 else base
    return out


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 20_000}, {"chunk_bytes": 30_000, "block_tokens": 1500}])
def test_table(spark, options):
    want = compare(table(spark, "/root/testdata/sf0.001", "documents"), **options)
    assert sum(i != c for i, _, c in want) > 10


def test_made_texts(spark, docs):
    texts = variants(1, 25, 60) + variants(2, 30, 12) + variants(3, 20, 7) + ["a", "a b", "A  b", "a b c d", None, "", " ", "a b c d e", "a b c d e f"]
    rows = list(enumerate(texts)) + [(None, texts[0]), (None, None), (None, "only here in this row again"), (3, texts[3]), (3, texts[3]), (900, texts[7]), (901, "x " * 9000)]
    random.Random(9).shuffle(rows)
    compare(docs(rows).withColumn("component_id", F.lit("own")), chunk_bytes=1_500)


def test_large_component_in_blocks(spark, docs):
    compare(docs(variants(5, 1, 80) + variants(6, 6, 80) * 2 + [" ".join(f"c{(k + s) % 90}" for k in range(80)) for s in range(60)]), chunk_bytes=1_500, block_tokens=400)


def test_repeated_ids_are_told_apart_by_text(spark, docs):
    long, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(60))
    rows = docs([(5, long), (5, other), (7, long), (None, other), (None, other + " end"), (9, None), (9, "")])
    want = compare(rows, chunk_bytes=60)
    assert (7, 26, 5) in want and (5, 56, 5) in want
    kept = jaccard_join.drop_near_duplicates(rows, chunk_bytes=60).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.text) == [(5, long), (5, other)] and len(kept) == 4


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_one_of_each_component_stays(spark, docs, limit):
    texts = variants(1, 12, 60) + ["", None, "a b"] + variants(2, 6, 12)
    rows = [(random.Random(i).choice([i, i, 3, None]), t) for i, t in enumerate(texts)] + [(40, texts[0]), (40, texts[0])]
    df = docs(rows).withColumn("label", F.lit("own")).withColumn("sha", F.lit(1))
    kept = jaccard_join.drop_near_duplicates(df, chunk_bytes=1_500, broadcast_bytes=limit)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                up = [up[y] if u == up[x] else u for u in up]
    first = {}
    for k in (k for k in range(len(rows)) if sets[k]):
        order = (rows[k][0] is None, rows[k][0] or 0, hashlib.sha256((rows[k][1] or "").encode()).digest())
        first[up[k]] = min(first.get(up[k], (order, rows[k])), (order, rows[k]), key=lambda x: x[0])
    want = [r for _, r in first.values()] + [rows[k] for k in range(len(rows)) if not sets[k]]
    assert got == sorted(want, key=str)


def test_hot_block_of_sets_that_share_a_base():
    """Sets that share most tokens without linking, and a few that do: all found, in seconds."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 160).astype(np.uint64)
    sets = [np.unique(np.concatenate([base, rng.integers(0, 1 << 62, 70).astype(np.uint64)])) for _ in range(1500)]
    sets += [np.unique(np.append(sets[i][:-2], rng.integers(0, 1 << 62, 3).astype(np.uint64))) for i in range(0, 300, 3)]
    sizes = np.array([len(s) for s in sets])
    nodes = np.arange(len(sets))
    began = time.time()
    links = jaccard_join.local_links(nodes, sizes, sets, nodes, 75)
    assert time.time() - began < 60
    assert sorted(tuple(sorted(x)) for x in links) == [(i, 1500 + k) for k, i in enumerate(range(0, 300, 3))]


def test_empty_table(spark, docs):
    assert jaccard_join.near_duplicates(docs(["a"]).limit(0)).count() == 0


def test_boundary_and_filters():
    assert jaccard_join.needed(4, 3, 75) == 3 and jaccard_join.needed(7, 7, 75) == 6
    assert jaccard_join.light_boundary(75, 4.0) >= 3
    for n in range(1, 40):
        for m in jaccard_join.partners(n, 75):
            assert jaccard_join.needed(n, m, 75) <= min(n, m)
