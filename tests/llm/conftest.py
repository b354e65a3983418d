from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty and very long texts, ties, repeated rows, columns with clashing names."""
    long_text = " ".join(f"w{i % 997} x{i % 1009}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 3), (4, long_text, "en", "b", 9), (4, long_text, "en", "b", 9),
        (5, "Only three words", "de", "a", 1), (6, "Only three words", "de", "a", 1), (7, "Only three words", "de", "a", 1), (None, "no id here but some words", "en", "c", 2),
        (8, "12345 !!! ???", "en", "a", 1), (9, "é ü ñ ß 漢字 🙂 text\x00with odd signs", "fr", "c", 4), (10, long_text + " end", "en", "b", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: "extra" for c in ("n_words", "pii", "accepted", "score", "kept", "words_", "found_", "n_lines", "split_", "copies", "tag")}
    return df.withColumns({c: F.lit(v) for c, v in extra.items()})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
