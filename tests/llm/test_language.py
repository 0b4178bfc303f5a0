"""Held-out accuracy, agreement of the table lookups with the layers, and edge cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from weft.llm import language_id
from weft.llm.common import table


def test_held_out_accuracy(spark):
    df = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: (r.lang, r.text) for r in df.collect()}
    got = language_id.identify(df).collect()
    assert len(got) == len(truth)
    right = []
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.held_out:
            right.append(r.lang_pred == truth[r.doc_id][0])
    print("held out", len(right), np.mean(right))
    assert np.mean(right) >= 0.95
    again = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df.repartition(3)).collect()}
    assert all(again[r.doc_id][0] == r.lang_pred for r in got)


def test_lookup_equals_layers_and_gradient():
    rng = np.random.default_rng(1)
    net = language_id.Network(["a", "b", "c"])
    x = rng.integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8)
    assert np.allclose(net.predict(x, net.tables()), net.forward(x)[0], atol=1e-5)
    for k in net.params:
        net.params[k] = net.params[k].astype(np.float64)
    y = np.array([0, 1, 2, 1, 0])
    loss = lambda: -np.log(net.forward(x)[0][np.arange(5), y]).mean()
    for name, g in net.gradients(x, y).items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        before = net.params[name][i]
        net.params[name][i] = before + 1e-5
        up = loss()
        net.params[name][i] = before - 1e-5
        down = loss()
        net.params[name][i] = before
        assert abs((up - down) / 2e-5 - g[i]) < 1e-4


def test_edge_rows(spark, docs):
    rows = [(i, ("hello the world of words " if i % 2 else "bonjour le monde des mots ") * 20, ["fr", "en"][i % 2], "s") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "123 !! \n"), (None, "the words of the world hello"), (103, "the words " * 30_000), (103, "é", None, None)]
    df = docs(rows).withColumn("score", F.lit("own"))
    got = {r.doc_id: r for r in language_id.identify(df).filter("doc_id is null or doc_id <= 102").collect()}
    assert {i: got[i].lang_pred for i in (100, 101, 102)} == dict.fromkeys((100, 101, 102), "und")
    assert got[None].lang_pred == "en" and not got[None].held_out
    assert language_id.identify(df.limit(0)).count() == 0
    blank = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(blank).collect()} == {"und"}
