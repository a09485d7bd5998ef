import pytest

ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one two", "en", None, 7), (None, "no id here but a text of some ten words in all", "en", "b", None),
    (5, "same words again and again " * 30, "en", "b", 1), (6, "same words again and again " * 30, "en", "b", 1), (6, "same words again and again " * 30, "en", "b", 1),
    (7, "x" * 30_000, None, "b", 2), (8, "line a\nline b\nline c\n" * 4, "fr", "c", 3), (9, "ünï cödé – ☃ 漢字 " * 40, "de", "c", 3), (10, "word " * 20_000, "en", "c", 9),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns that clash with results."""
    return spark.createDataFrame([(*r, 0.5, 7, "mine") for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, score double, n_words int, size string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
