import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", 0, 1.0, 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, n long")

    return make
