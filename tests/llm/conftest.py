import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """(doc_id, text) rows to a DataFrame with the columns of documents and one that clashes with results."""

    def make(rows):
        full = [(i, t, None, "s", len(t or ""), "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score string")

    return make
