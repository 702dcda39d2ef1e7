import pytest


@pytest.fixture(scope="session")
def texts(spark):
    """A documents table from (doc_id, text) pairs; the further columns have clashing names."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "src", 0, "x", 1) for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, row string, score int",
        )

    return make
