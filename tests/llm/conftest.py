import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents rows from (doc_id, text) pairs, with an extra column whose name clashes with results."""

    def make(rows):
        full = [(i, t, "en", "src0", None if t is None else len(t), "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score string")

    return make


EDGE = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, "Same text here, twice over."), (7, "Same text here, twice over."),
    (8, "word " * 6000), (9, "é中文 😀 İstanbul ΣΑΣ"), (10, "a" * 5000), (6, "Same text here, twice over."), (None, "no id at all here"),
]


@pytest.fixture(scope="session")
def edge(docs_of):
    return docs_of(EDGE)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
