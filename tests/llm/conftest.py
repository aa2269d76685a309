import pytest

DOCS = "doc_id long, text string, lang string, kept string, score int, text_hash long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names clash with results'."""

    def make(rows, lang="en"):
        return spark.createDataFrame([(i, t, lang, "x", 1, 2) for i, t in rows], DOCS).repartition(3)

    return make


LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "one"),
    (5, "one"),
    (None, "one"),
    (None, None),
    (6, LONG),
    (7, LONG + " end"),
    (8, "日本語 ÀÉ Σας 🎉 ½ ² <|endoftext|> x"),
    (9, "a\x1cb\x85c\x0bd"),
]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture(scope="session")
def empty(docs_of, spark):
    return spark.createDataFrame([], DOCS)
