import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """documents from texts, or from (id, text[, lang, source]) rows."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            r = (*r, *(("en", "s1")[len(r) - 2:]))
            full.append((r[0], r[1], r[2], r[3], len(r[1]) if r[1] is not None else None))
        return spark.createDataFrame(full, SCHEMA)

    return make
