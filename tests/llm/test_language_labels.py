"""Every label is learned: more than two hundred, and those of short texts only."""

from weft.llm import language_id


def test_many_labels(spark, docs):
    rows = [(i, f"label number {i} has these words here", f"l{i:03}") for i in range(230)]
    net = language_id.fit(docs(rows), per_language=2, windows_per_text=1)
    assert net.languages == [f"l{i:03}" for i in range(230)]


def test_short_texts(spark, docs):
    rows = [(i, ["да, мир", "good morning to all of the world"][i % 2], ["ru", "en"][i % 2]) for i in range(80)]
    got = {(r.doc_id % 2, r.lang_pred) for r in language_id.identify(docs(rows)).collect()}
    assert got == {(0, "ru"), (1, "en")}
    short = language_id.fit(docs([(i, ["ja", "no"][i % 2], ["de", "it"][i % 2]) for i in range(20)]))
    assert short is not None and short.languages == ["de", "it"]
