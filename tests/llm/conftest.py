import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with names that operators use."""
    long_text = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35, 1.0, "x"), (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35, 1.0, "x"),
        (2, None, None, None, None, None, None), (None, "null id text with some words", "en", None, 28, 0.5, None), (3, "", "de", "b", 0, 2.0, "y"),
        (4, long_text, "en", "b", len(long_text), 2.0, "y"), (5, " \t\n ", "en", "a", 4, 0.0, ""), (6, "one two", "en", "a", 7, 0.0, ""),
        (7, "call +1 (415) 555-0199 or me@example.com ÉÀ 中文", "en", "b", 40, 0.0, ""), (8, "alpha beta gamma delta epsilon zeta", "en", "c", 35, 1.0, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, key string")
