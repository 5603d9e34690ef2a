import pytest


@pytest.fixture
def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing further columns."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    words = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, words, "en", "a", 1), (2, words, "en", "a", 1), (2, words, "en", "a", 1), (3, words.upper(), "fr", None, 1), (4, None, None, None, None), (5, "", "en", "b", 0),
        (6, " \t\n ", "en", "b", 0), (7, long, "en", "c", 9), (8, "one two", None, "c", 7), (None, words + " tail", "en", "b", 1), (9, "ça 123 ▁ \U0001f600\u0000x", "fr", "é", 3), (10, "12 34 --", "en", "b", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    from pyspark.sql import functions as F

    for c in ("size", "block", "ord", "rank", "id", "kept", "n", "bucket", "score", "words", "key", "pass", "units", "rule", "l"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture
def no_documents(odd_documents):
    return odd_documents.limit(0)
