import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents-like table of (doc_id, text) with further columns, some of clashing names."""

    def make(rows):
        wide = [(i, t, "en", "s", len(t) if t is not None else None, "x", 7) for i, t in rows]
        return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, spans string, blob int")

    return make
