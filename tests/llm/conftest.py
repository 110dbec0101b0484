import pytest

ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n ", "en", None),
    (4, "one", None, "a"),
    (5, "one two", "fr", "a"),
    (6, "the same words stand here once and again in this plain text of some length", "en", "a"),
    (6, "the same words stand here once and again in this plain text of some length", "en", "a"),
    (7, "The same words stand here once and again in this plain text of some length", "en", "b"),
    (None, "a row without an id but with words of its own in it", "en", "b"),
    (8, "x" * 70_000, "en", "a"),
    (9, "wide　space\u2003and 👩‍👩‍👧 é́ \x1c\x1d", "fr", "b"),
    (10, "line\n" * 40, "en", "b"),
    (11, "#$%&|<> <|endoftext|> " * 30, "de", "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names clash with results."""
    rows = [(*r, len(r[1] or ""), 0.5, "x", True, [1], "k") for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, kept boolean, ids array<int>, key string").cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (6, 1, 0), (7, 0, 1), (8, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
