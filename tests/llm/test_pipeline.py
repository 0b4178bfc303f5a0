"""The pipeline's stages against brute-force versions of their decisions."""

import numpy as np
import sentencepiece
from pyspark.sql import functions as F
from test_jaccard import brute as near_brute
from test_native import GAP, brute_em, brute_signals, brute_targets, brute_votes

import corpus_pipeline
from weft.functions.storage import stored
from weft.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents").withColumn("extra", F.lit(1))
    rows = {r.doc_id: r for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality rules", "exact dedup", "near duplicates", "mix sources", "encode"]

    good = stored(steps["quality rules"](spark, docs, SF), "t")
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    posterior = brute_em(np.array([brute_votes(r.text) for r in rows.values()]))
    for (i, r), p in zip(rows.items(), posterior, strict=True):
        n, _, _, _, rep = brute_signals(r.text)
        assert (i in kept) == (n >= 10 and 100 * rep <= 20 * n and p >= 0.5)

    unique = stored(steps["exact dedup"](spark, good, SF), "t")
    best = {}
    for i in sorted(kept):
        best[rows[i].text] = i
    assert unique.columns == docs.columns and sorted(r.doc_id for r in unique.collect()) == sorted(best.values())

    single = stored(steps["near duplicates"](spark, unique, SF), "t")
    want = sorted(i for i, _, c in near_brute([(i, rows[i].text) for i in sorted(best.values())]) if i == c)
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == want

    mixed = stored(steps["mix sources"](spark, single, SF), "t")
    taken = [r.doc_id for r in mixed.collect()]
    assert mixed.columns == docs.columns and set(taken) <= set(want)
    size = {i: len(GAP.findall(rows[i].text)) for i in want}
    totals, got = {}, {}
    for i in want:
        totals[rows[i].source] = totals.get(rows[i].source, 0) + size[i]
    for i in taken:
        got[rows[i].source] = got.get(rows[i].source, 0) + size[i]
    for s, t in brute_targets(totals).items():
        assert abs(got.get(s, 0) - t) <= max(size[i] for i in want if rows[i].source == s) / 2 + 1e-6

    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.SENTENCEPIECE_MODEL)
    encoded = steps["encode"](spark, mixed, SF).collect()
    assert len(encoded) == len(taken)
    assert all(np.array_equal(r.ids, library.encode(r.text)) for r in encoded[:60])


LINE = "some words of one that stand in a row here to be kept as the one line of it all"


def test_odd_documents(spark, docs):
    rows = docs([(1, None), (None, LINE), (2, ""), (3, LINE), (3, LINE), (None, "x"), (3, " ".join(f"other{i} of it" for i in range(40)))])
    odd = rows.withColumns({c: F.lit(f"own {c}") for c in ("ids", "stay_id", "component_id", "label", "key", "vote0", "kept", "copies")})
    for df, want in ((rows, {(3, LINE)}), (odd, {(3, LINE)}), (rows.limit(0), set()), (odd.limit(0), set())):
        out = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stored(stage(spark, out, SF), "t")
            assert out.columns == df.columns
        encoded = stored(corpus_pipeline.STAGES[-1][1](spark, out, SF), "t")
        assert encoded.columns == [*df.columns, "ids_1" if "ids" in df.columns else "ids"]
        got = {(r.doc_id, r.text) for r in encoded.collect()}
        assert want <= got and all(i == 3 for i, _ in got)


def test_decisions_are_taken_row_by_row(spark, docs):
    """Rows of one id with good and bad texts: each has its own verdict in every stage."""
    steps = dict(corpus_pipeline.STAGES)
    good = [" ".join(f"word{(k * 7 + i) % 90} of the" for i in range(30)) for k in range(20)]
    bad = "$%& " * 40
    df = docs([(i // 2 if i < 10 else None, t) for i, t in enumerate(good)] + [(i // 2, bad) for i in range(10)])
    kept = steps["quality rules"](spark, df, SF)
    assert sorted(r.text for r in kept.collect()) == sorted(good)
    near = [good[0], good[0] + " end", good[1], good[2]]
    left = steps["near duplicates"](spark, docs([(None, t) for t in near]), SF).collect()
    assert len(left) == 3 and {good[1], good[2]} <= {r.text for r in left}
