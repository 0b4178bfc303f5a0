"""Byte repeats against brute force: one chunk, many chunks, and made-up texts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import chunks, suffix_dedup
from weft.llm.common import table

WINDOW = 50


def brute(rows):
    first, out = {}, []
    order = lambda i: (i is None, i or 0)
    rows = [(i, (t or "").encode()) for i, t in rows]
    for i, b in rows:
        for k in range(len(b) - WINDOW + 1):
            w = b[k:k + WINDOW]
            first[w] = min(first.get(w, (True, 1 << 60)), order(i))
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - WINDOW + 1):
            if first[b[k:k + WINDOW]] < order(i):
                gone[k:k + WINDOW] = b"\1" * WINDOW
        starts = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), starts, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def compare(df, **options):
    got = suffix_dedup.repeated_spans(df, **options)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    found = got.collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found], key=str) == brute(rows)
    for r in found:
        spans = np.frombuffer(r.spans, "<i8").reshape(-1, 2)
        assert len(spans) == r.n_spans and (spans[:, 1] - spans[:, 0]).sum() == r.n_removed


@pytest.mark.parametrize(("chunk_bytes", "hot_count"), [(4 << 20, 1024), (20_000, 1024), (20_000, 3)])
def test_table(spark, chunk_bytes, hot_count):
    compare(table(spark, "/root/testdata/sf0.001", "documents"), chunk_bytes=chunk_bytes, hot_count=hot_count)


def test_made_texts(spark, docs):
    rng = random.Random(4)
    piece = ["".join(rng.choice("ab é") for _ in range(rng.randrange(20, 90))) for _ in range(12)]
    rows = [(rng.randrange(200), "".join(rng.choice(piece) for _ in range(rng.randrange(6)))) for _ in range(80)]
    rows += [(None, piece[0] * 3), (None, piece[0] * 3), (3, None), (4, ""), (5, "x" * 49), (6, "x" * 50), (7, "x" * 51), (8, "x" * 3000), (9, piece[1] * 400), (9, piece[1] * 400)]
    compare(docs(rows).withColumn("spans", F.lit("own")), chunk_bytes=2_000)
    compare(docs(rows), chunk_bytes=2_000, hot_count=3)


def test_empty_table(spark, docs):
    assert suffix_dedup.repeated_spans(docs(["a"]).limit(0)).count() == 0
    assert suffix_dedup.repeated_spans(docs([None])).collect()[0].n_bytes == 0


def test_refine_sorts_suffixes():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 2, 300).astype(np.uint8)
    got = suffix_dedup.window_buckets(data)[: len(data) - WINDOW + 1]
    windows = [data[i:i + WINDOW].tobytes() for i in range(len(got))]
    assert [sorted(windows).index(w) for w in windows] == [int(np.argsort(np.argsort(got, kind="stable"))[np.flatnonzero(got == g)[0]]) for g in got]
    assert len(set(got.tolist())) == len(set(windows))
    assert len(chunks.grams(np.arange(5, dtype=np.uint64), 24)) == 0


def test_runs_cover_each_window_once_whatever_the_slices(monkeypatch):
    rng = np.random.default_rng(7)
    lens = np.array([0, 3000, 49, 50, 7, 1200, 0, 51])
    data = rng.integers(97, 101, lens.sum()).astype(np.uint8)
    blob = chunks.squeeze(np.arange(len(lens)), np.ones(len(lens), np.uint8), np.ones(len(lens), np.int64), lens, data)
    found = []
    for size in (1 << 20, 97, 1):
        monkeypatch.setattr(suffix_dedup, "SLICE_STARTS", size)
        chunk = chunks.Chunk(blob)
        start, n, least = suffix_dedup.chunk_runs(chunk)
        places = chunks.ragged(start, n)
        assert sorted(places.tolist()) == [p for a, b in zip(chunk.offs[:-1], chunk.offs[1:], strict=True) for p in range(a, b - WINDOW + 1)]
        found.append(dict(zip(places.tolist(), np.repeat(least, n).tolist(), strict=True)))
        assert len(suffix_dedup.window_hashes(chunk, np.sort(places))) == len(places)
    assert found[0] == found[1] == found[2]


def test_minimisers_fill_the_buckets_evenly():
    rng = np.random.default_rng(11)
    lens = np.array([400_000])
    blob = chunks.squeeze(np.arange(1), np.ones(1, np.uint8), np.ones(1, np.int64), lens, rng.integers(97, 123, lens.sum()).astype(np.uint8))
    _, n, least = suffix_dedup.chunk_runs(chunks.Chunk(blob))
    load = np.bincount((least >> np.uint64(58)).astype(np.int64), n, 64)
    assert load.min() > 0 and load.max() < 2 * load.mean()


def test_slices_of_a_bucket_are_cut_at_the_same_keys():
    keys = [np.array([0, 0, 5, 9], np.uint16), np.array([5, 5, 65535], np.uint16), np.array([], np.uint16)]
    loads = [np.ones(len(k), np.int64) for k in keys]
    for limit in (1, 2, 100):
        got = list(chunks.slices_of(keys, loads, limit))
        for r, key in enumerate(keys):
            assert [i for part in got for i in range(*part[r])] == list(range(len(key)))
        seen = [{int(k) for r, key in enumerate(keys) for k in key[slice(*part[r])]} for part in got]
        assert all(not a & b for i, a in enumerate(seen) for b in seen[:i])
