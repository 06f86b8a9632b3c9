import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, _key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empties, repeats, a long text, ties, and columns whose names clash with the operators' own."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43, 0.1, "x"),
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43, 0.1, "x"),
        (2, None, "fr", "b", None, None, None),
        (3, "", None, None, 0, 1.0, "y"),
        (4, " \t\n ", "de", "b", 4, 1.0, "y"),
        (None, "no id here, mail a@b.co or 10.0.0.1", "es", None, 35, 1.0, "z"),
        (5, "mot " * 20000, "fr", "a", 80000, 2.0, "z"),
        (6, "日本語 ▁ 😀 x", "ja", "c", 10, 2.0, "z"),
        (7, "the quick brown fox jumps over the lazy dog", None, "c", 43, 0.1, "x"),
    ]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
