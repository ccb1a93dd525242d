import pytest


@pytest.fixture
def docs(spark):
    """A table of documents from texts or (id, text) pairs, with extra columns of clashing names."""

    def make(rows, lang="en"):
        rows = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        data = [(i, t, lang if not isinstance(lang, list) else lang[k], "s", len(t or ""), "x", 1.5, "n") for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, class_id string, score double, node string")

    return make
