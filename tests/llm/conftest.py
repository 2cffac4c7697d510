import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def benchmark_items(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and further columns under names that operators use inside."""
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, None), (4, ""), (None, "x"), (None, None), (5, "Łódź\n\nŁódź naïve 日本 \U0001f600"), (6, "word " * 30_000), (6, "other text of the same id"), (7, "z" * 50_000), (8, "!?")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(i) for i, c in enumerate(["h", "sha", "keep_id", "fp", "a", "b", "text_hash", "words", "train", "_id", "_text", "n", "ties", "word", "block"])}).withColumn("lang", F.lit("en"))
