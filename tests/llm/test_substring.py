"""Repeated word windows against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weft.llm import substring_dedup
from weft.llm.common import table

WINDOW = 35
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k:k + WINDOW]) for _, w in split for k in range(len(w) - WINDOW + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - WINDOW + 1):
            if seen[tuple(w[k:k + WINDOW])] > 1:
                gone[k:k + WINDOW] = [True] * WINDOW
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def compare(df, **options):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = substring_dedup.repeated_words(df, **options).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute(rows)


@pytest.mark.parametrize(("chunk_bytes", "hot_count"), [(4 << 20, 1024), (20_000, 1024), (20_000, 3)])
def test_table(spark, chunk_bytes, hot_count):
    compare(table(spark, "/root/testdata/sf0.001", "documents"), chunk_bytes=chunk_bytes, hot_count=hot_count)


def test_made_texts(spark, docs):
    rng = random.Random(6)
    piece = [rng.choice([" ", "\n", "\t "]).join(rng.choice(["a", "b", "é", "A", "long word", " "]) for _ in range(rng.randrange(20, 60))) for _ in range(10)]
    rows = [(rng.randrange(200), " ".join(rng.choice(piece) for _ in range(rng.randrange(5)))) for _ in range(80)]
    rows += [(None, piece[0] + " x " + piece[1]), (None, None), (3, ""), (4, " \n "), (5, "w " * 34), (6, "v " * 35), (7, "u " * 36), (8, "t " * 5000), (9, piece[1] * 50), (9, piece[1] * 50), (10, " ".join(map(str, range(40)))), (11, " ".join(map(str, range(36))))]
    compare(docs(rows).withColumn("n_words", F.lit("own")), chunk_bytes=2_000)
    compare(docs(rows), chunk_bytes=2_000, hot_count=3)


def test_empty_table(spark, docs):
    assert substring_dedup.repeated_words(docs(["a"]).limit(0)).count() == 0
    assert [(r.n_words, r.n_removed) for r in substring_dedup.repeated_words(docs([None])).collect()] == [(0, 0)]
