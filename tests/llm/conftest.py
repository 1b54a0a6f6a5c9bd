import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, h long, words string, gone int, block string"
#: Nulls, blanks, repeats, and columns that operators use names of.
EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (5, "one two"), (None, "one two three four five"), (6, "a b c d e f"), (6, "other words here now"),
    (7, "long " * 30000), (8, "The MIT License and CC BY terms\nthe mit  license"), (9, "x\n\nx\ny"),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(i, t, None, "s", None, "f", 1, "w", 2, "b") for i, t in EDGES], DOCS)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
