"""CSV with a header: the first column, or a named one, names entities; the other cells are typed by what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.operators.store import Store


def cell(x: Column) -> Column:
    """Empty, NIC and NULL are null; PRAWDA and FAŁSZ truth values; then numbers; else text. As the struct (vtype,
    v_text, v_num, v_bool)."""
    t = F.trim(x)
    word = F.upper(t)
    null = t.isNull() | word.isin("", "NIC", "NULL")
    truth = word.isin("PRAWDA", "FAŁSZ")
    number = F.when(t.rlike(r"^[+-]?(\d+|\d*\.\d+|\d+\.)$"), t.try_cast("double"))
    kind = F.when(null, "null").when(truth, "bool").when(number.isNotNull(), "num").otherwise("text")
    return F.struct(kind.alias("vtype"), F.when(null, "NIC").when(truth, word).otherwise(t).alias("v_text"), F.when(kind == "num", number).alias("v_num"), F.when(kind == "bool", word == "PRAWDA").alias("v_bool"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text, whatever a byte order mark at the start."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.removeprefix("﻿") for c in df.columns])


def load(store: Store, path: str, name_column: str | None = None, upsert_on: str | None = None) -> int:
    """Entities from a file. With `upsert_on` rows are merged by that property, else a known name is an error."""
    rows = read(store.spark, path)
    name = name_column or rows.columns[0]
    rows = rows.select(name, *[c for c in rows.columns if c != name])
    if upsert_on is None:
        return store.insert_rows(rows)
    return store.merge_rows(rows, upsert_on)


def save(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers; null cells are empty."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(path)


def to_pandas(df: DataFrame, most: int = 1_000_000):
    """Rows as a pandas table for a notebook. More than `most` are refused, not cut: they belong in a job."""
    out = df.limit(most + 1).toPandas()
    if len(out) > most:
        raise ValueError(f"more than {most} rows")
    return out
