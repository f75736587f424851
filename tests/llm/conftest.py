import pytest

# Rows every operator must take: nulls, empty and very long texts, ties, repeated rows.
LONG = "the old house by the river. " * 4000
ODD_ROWS = [
    (1, None), (2, ""), (3, "one"), (4, LONG), (5, "a b c d e f g"), (5, "a b c d e f g"), (6, "A B C D E F G"),
    (None, "no id"), (None, None), (7, "\n\n \t"), (8, "é漢 x\r\ny"), (9, "tie"), (9, "tie of another text"),
]
CLASHING = ["text_key", "tie", "bucket", "node", "shingle", "k1", "spans", "score", "value", "w", "host", "digest", "label"]


@pytest.fixture
def odd_docs(spark):
    """Odd documents with extra columns whose names the operators use inside."""
    rows = [(i, t, *("x",) * len(CLASHING)) for i, t in ODD_ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in CLASHING)).repartition(3)


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture
def docs(spark):
    def build(*rows):
        return spark.createDataFrame(list(rows), "doc_id bigint, text string").repartition(3)

    return build
