import pytest
from pyspark.sql import functions as F

WORDY = "the quick brown fox jumps over the lazy dog while seven wizards quietly examine a box of old letters"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in every column, empty and very long texts, ties, repeated rows, and columns that clash by name."""
    rows = [
        (1, None, "en", "a", 0), (2, "", None, None, None), (3, WORDY, "en", "a", 1), (3, WORDY, "en", "a", 1),
        (None, WORDY, "fr", "b", 2), (4, WORDY + " now", "en", "b", 3), (5, "word " * 60_000, "en", "b", 4),
        (6, "x" * 30_000, "de", "c", 5), (7, "12 34 !!", "de", "c", 6), (8, "  \n\t ", "es", "c", 7),
        (9, "Ünïcode \u00a0 <|endoftext|> \U0001f600 fin\n", "de", "c", 8), (10, WORDY.upper(), "en", "a", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["score", "fp", "row", "path", "label", "n_words", "hits", "words", "key", "component_id", "difference"]
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def small(sf, name):
    import duckdb

    return duckdb.sql(f"select * from '{sf}/{name}.parquet'").fetchdf()


SF = "/root/testdata/sf0.001"
