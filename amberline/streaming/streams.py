"""Streams: a journal, windows over event time, dedup within a watermark, and memory with bounded state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from amberline.operators.search import BETA, TRACE_MIN, TRACES


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def journal(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream to Parquet, each row once; what is there is taken and the query ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, path: str, out: str, by: str, files: int) -> None:
    """A journal's many files as few, dealt and sorted by a column."""
    spark.read.parquet(path).repartitionByRange(files, by).sortWithinPartitions(by).write.mode("overwrite").parquet(out)


def _timed(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, late) if late else df


def tumbling(df: DataFrame, ts: str, size: str, by: list[str], aggregates: dict, late: str | None = None) -> DataFrame:
    return _windowed(_timed(df, ts, late), F.window(ts, size), by, aggregates)


def sliding(df: DataFrame, ts: str, size: str, step: str, by: list[str], aggregates: dict, late: str | None = None) -> DataFrame:
    return _windowed(_timed(df, ts, late), F.window(ts, size, step), by, aggregates)


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], aggregates: dict, late: str | None = None) -> DataFrame:
    return _windowed(_timed(df, ts, late), F.session_window(ts, gap), by, aggregates)


def _windowed(df: DataFrame, window, by: list[str], aggregates: dict) -> DataFrame:
    out = df.groupBy(window.alias("_w"), *by).agg(*[c.alias(k) for k, c in aggregates.items()])
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *by, *aggregates)


def deduplicated(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first row of each key within the watermark: what replays is dropped."""
    return _timed(stream, ts, late).dropDuplicatesWithinWatermark(keys)


def fresh(df: DataFrame, ts: str, now, window: int = 300) -> DataFrame:
    """Rows within so many seconds of `now` (a column), before or after: what is older is a replay."""
    return df.where(F.abs(F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(now)) <= window)


def rate_limited(df: DataFrame, key: str, ts: str, most: int, size: str = "60 seconds", step: str = "10 seconds", late: str | None = None) -> DataFrame:
    """Keys and windows in which a key came more than `most` times."""
    return sliding(df, ts, size, step, [key], {"n": F.count("*")}, late).where(F.col("n") > most)


def over_limit(df: DataFrame, key: str, ts: str, most: int, seconds: int) -> DataFrame:
    """df with `limited`: whether a key came more than `most` times within the `seconds` up to a row, that row and those
    of its second included. Exact, unlike windows that step."""
    second = F.unix_timestamp(F.date_trunc("second", F.col(ts).cast("timestamp")))
    w = Window.partitionBy(key).orderBy(second).rangeBetween(-seconds, 0)
    return df.withColumn("limited", F.count("*").over(w) > most)


def memory(stream: DataFrame, beta: float = BETA) -> DataFrame:
    """Rows (key, epoch, r) to rows (key, epoch, M) for each batch of a key, from at most TRACES traces of state."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, epochs, values = state.get if state.exists else (None, [], [])
        traces = list(zip(epochs, values, strict=True))
        for frame in frames:
            for epoch, r in sorted(zip(frame["epoch"].tolist(), frame["r"].tolist(), strict=True)):
                if r >= TRACE_MIN:
                    traces.append((epoch, r))
        traces = sorted(traces)[-TRACES:]
        if not traces:
            return
        first = traces[0][0]
        now = traces[-1][0]
        norm = (1 - math.exp(-beta * (now - first + 1))) / (1 - math.exp(-beta))
        m = sum(r * math.exp(-beta * (now - e)) for e, r in traces) / norm
        state.update((first, [e for e, _ in traces], [float(r) for _, r in traces]))
        yield pd.DataFrame({"key": [key[0]], "epoch": [now], "M": [min(max(m, 0.0), 1.0)]})

    return stream.groupBy("key").applyInPandasWithState(update, "key string, epoch long, M double", "first long, epochs array<long>, r array<double>", "update", GroupStateTimeout.NoTimeout)
