"""Ids against the sentencepiece library, and exact round trips."""

import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from weft.llm import sentencepiece_codec as codec
from weft.llm.common import table
from weft.llm.queries import SENTENCEPIECE_MODEL

ODD = ["", " ", "   a", "a  b   c    d", "a" * 300, " " * 137, "x\ny\n\n z\t\tq\r\n", "你好世界 \U0001f600‍\U0001f4a9", "<s> </s> <unk> <0x0A>", "123 4567 3.14", "naïve é́ ß", "aaaaabbbbb " * 40, "\u0001\u0002 \x7f", "});\r\n//\r", "�   　"]


def random_texts(n):
    rng = random.Random(8)
    alphabet = "aaabcdeeeinorst  \n.,;()'\"0123é你\U0001f600\r\t"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL)


def test_merging_ids_equal_the_library(library):
    with open(SENTENCEPIECE_MODEL, "rb") as file:
        model = codec.Model(file.read())
    texts = ODD + random_texts(800)
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode(text), repr(text)
        assert model.decode(ids) == text.encode()
    assert model.encode([None, "a"])[0] is None


def test_unigram_scores_equal_the_library():
    """The same pieces under a unigram model: ways may tie, sums may not differ."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(SENTENCEPIECE_MODEL, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = codec.UNIGRAM
    rng = random.Random(1)
    for p in proto.pieces:
        p.score = -rng.uniform(2, 12) - 1.0 / len(p.piece) if p.type == codec.NORMAL else 0.0
    model = codec.Model(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = [t for t in ODD + random_texts(300) if all(c in model.ids for c in t if c not in ' \n\t\r\x01\x02\x7f')]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        total = lambda x: sum(proto.pieces[i].score for i in x)
        assert total(np.frombuffer(ids, "<i4").tolist()) == pytest.approx(total(library.encode(text)), rel=1e-5), repr(text)
        assert model.decode(ids) == text.encode()


def test_table(spark, library):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = codec.encode(df, SENTENCEPIECE_MODEL).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip


def test_edge_rows(spark, docs, library):
    df = docs([(1, None), (None, "x y"), (2, ""), (2, "x y"), (3, "long " * 30_000)]).withColumn("ids", F.lit("own"))
    got = {(r.doc_id, r.n_tokens): r for r in codec.encode(df, SENTENCEPIECE_MODEL).collect()}
    assert got[(1, None)].round_trip is None and got[(2, 0)].ids == []
    assert got[(None, 2)].ids == got[(2, 2)].ids == library.encode("x y")
    wide = codec.add_ids(df, SENTENCEPIECE_MODEL, ids_col="tokens")
    assert wide.columns == [*df.columns, "tokens"]
    back = {(r.doc_id, r.text) for r in codec.decode(wide, SENTENCEPIECE_MODEL, ids_col="tokens").collect()}
    assert back == {(r.doc_id, r.text) for r in df.collect()}
    assert codec.encode(df.limit(0), SENTENCEPIECE_MODEL).count() == 0


def given(model):
    """The words that the Viterbi is given from now on."""
    words, run = [], model.encode_words
    model.encode_words = lambda distinct: words.extend(distinct) or run(distinct)
    return words


def test_full_memory_keeps_words_of_late(library, monkeypatch):
    monkeypatch.setattr(codec, "MEMO_WORDS", 60)
    monkeypatch.setattr(codec, "MEMO_PAIRS", 20)
    with open(SENTENCEPIECE_MODEL, "rb") as file:
        model = codec.Model(file.read())
    words, common = given(model), " ".join(f"c{chr(97 + k)}mmon" for k in range(10))
    for n in range(12):
        text = f"{common} " + " ".join(f"r{chr(97 + n)}{chr(97 + k)}re" for k in range(15))
        assert np.frombuffer(model.encode([text])[0], "<i4").tolist() == library.encode(text)
        assert len(model.memo) + len(getattr(model, "older", ())) <= 60
    assert sum("mmon" in w for w in words) == 10


def test_cuts_wherever_no_piece_reaches(library):
    with open(SENTENCEPIECE_MODEL, "rb") as file:
        model = codec.Model(file.read())
    words = given(model)
    texts = ["so end", "so end.", "so end,", "end.\nSo", "so «end».", "3.14 é. né.e"]
    assert [np.frombuffer(x, "<i4").tolist() for x in model.encode(texts)] == [library.encode(t) for t in texts]
    assert not [w for w in words if "d." in w or "d," in w] and sum("end" in w for w in words) <= 2


def test_neighbouring_unknown_characters_without_byte_pieces():
    proto = sentencepiece_model_pb2.ModelProto()
    with open(SENTENCEPIECE_MODEL, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.byte_fallback = False
    for p in proto.pieces:
        if p.type == codec.BYTE:
            p.type = codec.CONTROL
        if p.piece in "\t\n\v\f;é":
            p.piece = f"<{ord(p.piece)}>"
    blob = proto.SerializeToString()
    model, library = codec.Model(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
    texts = [t for t in ODD + random_texts(800) if "\0" not in t] + ["a\n\tb", "\t\n", "a;\n;b", "é\n", "\n a \n"]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode(text), repr(text)
