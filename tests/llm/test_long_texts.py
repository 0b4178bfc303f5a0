"""Texts longer than a chunk and than the slices that operators work on: results that can be told without brute force."""

import hashlib
import random

import pytest

from weft.llm import jaccard_join, quality_rules, sentencepiece_codec, substring_dedup, suffix_dedup
from weft.llm.queries import SENTENCEPIECE_MODEL


@pytest.fixture(scope="module")
def long():
    rng = random.Random(21)
    return [f"{rng.randrange(1 << 40):x}" for _ in range(600_000)]  # about 6 MB, no two windows equal


def test_bytes(spark, docs, long):
    text = " ".join(long)
    passage = text[3_000_000:3_004_000]
    got = {r.doc_id: r for r in suffix_dedup.repeated_spans(docs([(1, text), (2, "~" * 20 + passage + "!" * 20), (3, "nothing of it")])).collect()}
    assert (got[1].n_bytes, got[1].n_removed, got[3].n_removed) == (len(text), 0, 0)
    assert (got[2].n_removed, got[2].n_spans, got[2].kept_sha256) == (4000, 1, hashlib.sha256(("~" * 20 + "!" * 20).encode()).hexdigest())


def test_words(spark, docs, long):
    text, passage = " ".join(long), " ".join(long[400_000:400_100])
    got = {r.doc_id: r for r in substring_dedup.repeated_words(docs([(1, text), (2, "before " + passage + " after")])).collect()}
    assert (got[1].n_words, got[1].n_removed, got[2].n_words, got[2].n_removed) == (600_000, 100, 102, 100)
    assert got[2].kept_sha256 == hashlib.sha256(b"before after").hexdigest()


def test_near_copies(spark, docs, long):
    changed = long[:500_000] + ["other"] * 3 + long[500_003:]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs([(5, " ".join(long)), (7, " ".join(changed)), (6, " ".join(long[:300_000]))])).collect()}
    assert got == {5: (599_996, 5), 7: (599_996, 5), 6: (299_996, 6)}


def test_signals_and_ids(spark, docs, long):
    df = docs([(1, " ".join(long))])
    row = quality_rules.judge(df).first()
    assert (row.n_words, row.n_repeat_words, row.word_chars) == (600_000, 0, sum(map(len, long)))
    assert sentencepiece_codec.encode(df, SENTENCEPIECE_MODEL).first().round_trip
