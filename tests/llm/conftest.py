import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Build a documents table from texts; extra columns have clashing names."""

    def build(texts, ids=None):
        rows = [(i if ids is None else ids[i], t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return build


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


ODD = [None, "", " ", "a", "a  b\t c", "a b c", "a b c", "é" * 3, "x " * 30_000, "\n\n", "日本 語 " * 5]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
