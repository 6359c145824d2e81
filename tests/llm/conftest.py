import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with more columns, some named like those of results."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), 1.5, "x", 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, k string, n_words int")

    return make
