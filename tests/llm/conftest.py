import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A DataFrame of (doc_id, text) pairs, or of whole rows."""

    def make(rows, **more):
        rows = [r if len(r) == 5 else (*r, "en", "src0", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return make
