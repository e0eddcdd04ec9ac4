import pytest

from tidings.llm.catalog import prepared

SCHEMA = "text string, doc_id long, lang string, batch int, doc_id_2 long, bucket string, `key` int"

#: Nulls, empty and very long texts, equal rows, ties.
ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "word"),
    (5, "word"),
    (5, "word"),
    (None, "no id at all, and ten words more to be long enough here"),
    (7, "long words " * 30_000),
    (8, "x" * 200_000),
    (9, "é漢字​😀 \x00 end"),
]


@pytest.fixture(scope="session")
def llm(spark):
    return prepared(spark)


@pytest.fixture
def docs(llm):
    """Documents from (doc_id, text) pairs, with further columns whose names could clash."""

    def make(pairs, partitions=3):
        rows = [(t, i, None, 1, None, "b", 2) for i, t in pairs]
        return llm.createDataFrame(rows, SCHEMA).repartition(partitions, "doc_id", "text")

    return make


@pytest.fixture
def odd(docs):
    return docs(ODD)


@pytest.fixture
def empty(docs):
    return docs([])
