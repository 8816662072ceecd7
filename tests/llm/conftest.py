import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, g int, kept string, label string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text), with extra columns whose names clash with inner ones."""

    def f(rows, slices=3):
        return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "x", 7, "k", None) for i, t in rows], SCHEMA).repartition(slices)

    return f
