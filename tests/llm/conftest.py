from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Null columns, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    rows = [
        (1, "", "en", "b"), (2, None, None, None), (3, "one two three four", "en", "a"), (4, "one two three four", "en", "a"),
        (4, "one two three four", "en", "a"), (5, "One  TWO three\tfour", "en", "b"), (6, long, "en", "b"), (7, long + " end", "en", "b"),
        (8, "word", "de", "a"), (9, "word", "de", "Ä"), (10, " \n ", "en", None), (None, "one two three four", "en", "a"), (None, None, None, "c"),
        (11, "é ñ 中文 😀 é", "es", "c"), (12, "word word word word word word", "fr", "c"),
    ]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    from pyspark.sql import functions as F

    for name in ("id", "body", "key", "node", "score", "size", "shard", "slot", "h", "part", "place", "label", "n", "digest", "count"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
