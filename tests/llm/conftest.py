import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, host string, score double, piece int, rank int, fp string, kept string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text, lang, source) with extra columns whose names clash with those of operators."""

    def make(rows):
        full = [(i, t, g, s, None if t is None else len(t), "x", 0.5, 7, 8, "fp", "kept") for i, t, g, s in rows]
        return spark.createDataFrame(full, DOCS)

    return make


#: Nulls in any column, empty, blank and very long texts, ties, repeated rows and ids.
ODD = [
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (3, " \n\t ", "en", None),
    (4, "one", None, None),
    (None, "one two three four five six", "en", "b"),
    (None, None, None, None),
    (5, "one two three four five six", "en", "b"),
    (5, "one two three four five six", "en", "b"),
    (6, "one two three four five six", "en", "b"),
    (6, "another text under the same id", "de", "b"),
    (7, "x" * 30000, "en", "a"),
    (8, "word " * 20000, "en", "a"),
    (9, "Ünïcode 中文 ſ\u00a0K\u2028 end", "fr", "c"),
]


@pytest.fixture(scope="session")
def odd(make_docs):
    return make_docs(ODD)


@pytest.fixture(scope="session")
def empty(make_docs):
    return make_docs([])
