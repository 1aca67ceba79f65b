import pytest


@pytest.fixture
def frame(spark):
    """Documents of texts, with extra columns whose names clash with those the operators use."""

    def make(texts, ids=None):
        rows = [(i if ids is None else ids[i], t, "k", 1, "h") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, k string, n_words int, h string")

    return make
