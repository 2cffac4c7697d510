"""What the operators of this subpackage share: folders, tables that cut lineage, and streams of sorted Arrow rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.packaging import ship
from amberline.tables import materialise, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the two columns an operator needs, under fixed names; whatever else `docs` holds cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def filesystem(uri: str):
    """The pyarrow file system of a URI (file, hdfs, s3, gs, ...) and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else ("file://" + os.path.abspath(uri.removeprefix("file:"))))


def publish(uri: str, write) -> None:
    """Call `write(stream)` on a private file beside `uri`, then move it into place: a task that is tried again, or
    twice at once, leaves one whole file. What an earlier try left is deleted first, as not every store replaces."""
    files, path = filesystem(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    temporary = f"{os.path.dirname(path)}/_tmp-{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as stream:
        write(stream)
    if files.get_file_info(path).type.name != "NotFound":
        files.delete_file(path)
    files.move(temporary, path)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a stream that is sorted by `keys` into tables that each hold whole runs of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            column = batch.column(k)
            if batch.num_rows > 1:
                change[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        last = held[-1].slice(held[-1].num_rows - 1) if held else None
        change[0] = last is not None and any(last.column(k)[0] != batch.column(k)[0] for k in keys)
        cuts = np.flatnonzero(change)
        if not len(cuts):
            held.append(batch)
            continue
        done = [*held, batch.slice(0, cuts[-1])] if cuts[-1] else held
        if done:
            yield pa.Table.from_batches(done)
        held = [batch.slice(cuts[-1])]
    if held:
        yield pa.Table.from_batches(held)


class Memo:
    """A dictionary of bounded size for what a worker computes again and again: two generations, the older dropped."""

    def __init__(self, entries: int):
        self.entries, self.young, self.old = entries, {}, {}

    def put(self, key, value) -> None:
        if len(self.young) >= self.entries:
            self.old, self.young = self.young, {}
        self.young[key] = value
