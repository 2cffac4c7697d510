"""Exact dedup by Grace hashing: partition records by the hash of their content until a bucket's distinct contents fit
in memory, then find equal ones in an open-addressing table that compares complete contents.

Each task first collapses the copies in its own input, so that a content that a third of all rows hold crosses the
network once for each task. A bucket that is too large for memory is partitioned again, into spill files in the shared
folder, by other bits of the hash, as often as needed. The classes that have several members are then joined to the
documents by SHA-256, by a join that Spark can split where one class is very large.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberline.llm.common import filesystem, id_and_text, materialise, shared_dir

#: Bytes of distinct content that one table may hold, and the files that a bucket is spilled to.
TABLE_BYTES, FAN_BITS = 32 << 20, 4
_PARTIAL = pa.schema([("h", pa.int64()), ("text", pa.string()), ("keep_id", pa.int64()), ("n", pa.int64()), ("ties", pa.int64())])
_CLASS = pa.schema([("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("ties", pa.int64())])


class ContentTable:
    """Open addressing with linear probing. A record counts as seen only if the whole content is equal."""

    def __init__(self):
        self.slots, self.mask = [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.contents: list[str] = []
        self.keep: list[int | None] = []
        self.n: list[int] = []
        self.ties: list[int] = []
        self.bytes = 0
        # What the last call of `add` found: the content's place, and whether the new record is the one that stays.
        self.touched, self.replaced = -1, False

    def add(self, h: int, content: str, keep: int | None, n: int, ties: int) -> None:
        at = h & self.mask
        while (j := self.slots[at]) >= 0:
            if self.hashes[j] == h and self.contents[j] == content:
                self.n[j] += n
                mine = self.keep[j]
                self.touched, self.replaced = j, mine != keep and (mine is None or keep is not None and keep > mine)
                if mine == keep:
                    self.ties[j] += ties
                elif self.replaced:
                    self.keep[j], self.ties[j] = keep, ties
                return
            at = at + 1 & self.mask
        self.slots[at] = self.touched = len(self.hashes)
        self.replaced = False
        for column, x in ((self.hashes, h), (self.contents, content), (self.keep, keep), (self.n, n), (self.ties, ties)):
            column.append(x)
        self.bytes += len(content.encode("utf-8", "surrogatepass")) + 100
        if 2 * len(self.hashes) > self.mask:
            self._grow()

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for j, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = at + 1 & self.mask
            self.slots[at] = j

    def rows(self) -> Iterator[tuple]:
        return zip(self.hashes, self.contents, self.keep, self.n, self.ties, strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(f.name).to_pylist() for f in _PARTIAL), strict=True)


def _read(files, path: str) -> Iterator[tuple]:
    with files.open_input_stream(path) as stream, pa.ipc.open_stream(stream) as reader:
        yield from _stream(reader)


def _grace(rows: Iterator[tuple], level: int, files, folder: str, table_bytes: int) -> Iterator[tuple]:
    """The classes of one bucket."""
    table = ContentTable()
    for row in rows:
        table.add(*row)
        # Beyond the hash's last bits, records that still share a bucket share their whole hash: those stay together.
        if table.bytes > table_bytes and FAN_BITS * (level + 1) <= 64:
            break
    else:
        for _, content, keep, n, ties in table.rows():
            yield hashlib.sha256(content.encode("utf-8")).digest(), keep, n, ties
        return
    files.create_dir(folder, recursive=True)
    paths = [f"{folder}/{level}-{uuid.uuid4().hex}" for _ in range(1 << FAN_BITS)]
    streams = [files.open_output_stream(p) for p in paths]
    writers = [pa.ipc.new_stream(s, _PARTIAL) for s in streams]
    waiting: list[list[tuple]] = [[] for _ in paths]
    sizes = [0] * len(paths)

    def flush(b: int) -> None:
        for batch in _batches(iter(waiting[b]), _PARTIAL):
            writers[b].write_batch(batch)
        waiting[b], sizes[b] = [], 0

    def put(row: tuple) -> None:
        b = row[0] >> FAN_BITS * level & (1 << FAN_BITS) - 1
        waiting[b].append(row)
        sizes[b] += len(row[1]) + 100
        if sizes[b] > table_bytes >> FAN_BITS + 1:
            flush(b)

    for row in table.rows():
        put(row)
    del table
    for row in rows:
        put(row)
    for b, (writer, stream) in enumerate(zip(writers, streams, strict=True)):
        flush(b)
        writer.close()
        stream.close()
    for path in paths:
        yield from _grace(_read(files, path), level + 1, files, folder, table_bytes)
        files.delete_file(path)


def classes(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """sha, keep_id, group_size and ties of each distinct content of docs (doc_id, text)."""
    spill = shared_dir(docs.sparkSession, "spill")

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        for batch in batches:
            for h, text, doc_id in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                table.add(h, text, doc_id, 1, 1)
                if table.bytes > table_bytes // 4:
                    yield from _batches(table.rows(), _PARTIAL)
                    table = ContentTable()
        yield from _batches(table.rows(), _PARTIAL)

    def deduplicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = filesystem(spill)
        folder = f"{path}/{uuid.uuid4().hex}"
        try:
            yield from _batches(_grace(_stream(batches), 0, files, folder, table_bytes), _CLASS)
        finally:
            if files.get_file_info(folder).type.name == "Directory":
                files.delete_dir(folder)

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    partial = texts.mapInArrow(collapse, "h long, text string, keep_id long, n long, ties long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return partial.repartition(parts, "h").mapInArrow(deduplicate, "sha binary, keep_id long, group_size long, ties long")


def membership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, ties.

    Texts are equal when they are identical; null counts as empty. Of equal texts the row with the largest doc_id stays;
    a null id is smaller than any other. Rows that repeat both the text and the largest id are the same document: all
    say kept, and `ties` says how many they are. An empty table gives no rows.
    """
    docs = id_and_text(docs, id_col, text_col)
    several = materialise(classes(docs, table_bytes).where("group_size > 1"), "classes")
    own = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha"))
    return own.join(several, "sha", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.coalesce("ties", F.lit(1)).cast("long").alias("ties"),
    )


class RowTable:
    """Whole rows by content: of each distinct content the place of the row that stays. Rows are held as they come."""

    def __init__(self, text: int):
        self.text, self.table, self.batches, self.rows, self.bytes = text, ContentTable(), [], 0, 0
        self.place: list[int] = []

    def add(self, batch: pa.RecordBatch) -> None:
        table = self.table
        for i, (h, content, doc_id) in enumerate(zip(batch.column("_h").to_pylist(), batch.column(self.text).to_pylist(), batch.column("_id").to_pylist(), strict=True)):
            table.add(h, content or "", doc_id, 1, 1)
            j = table.touched
            if j == len(self.place):
                self.place.append(self.rows + i)
            elif table.replaced:
                self.place[j] = self.rows + i
        self.batches.append(batch)
        self.rows += batch.num_rows
        self.bytes += batch.nbytes
        if self.rows > 2 * len(self.place) + 1000:  # copies are not held for long
            self.compact()

    def compact(self) -> None:
        kept = self.result()
        self.batches, self.rows, self.bytes = kept.to_batches(), kept.num_rows, kept.nbytes
        self.place = list(range(self.rows))

    def result(self) -> pa.Table:
        return pa.Table.from_batches(self.batches).take(pa.array(self.place, pa.int64()))


def _grace_rows(batches: Iterator[pa.RecordBatch], text: int, level: int, files, folder: str, table_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of one bucket that stay."""
    table = RowTable(text)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            table.add(batch.slice(at, 500))
        if table.bytes > table_bytes and FAN_BITS * (level + 1) <= 64:
            table.compact()
            if table.bytes > table_bytes:
                break
    else:
        if table.rows:
            yield from table.result().to_batches()
        return
    files.create_dir(folder, recursive=True)
    paths = [f"{folder}/{level}-{uuid.uuid4().hex}" for _ in range(1 << FAN_BITS)]
    streams = [files.open_output_stream(p) for p in paths]
    schema = table.batches[0].schema
    writers = [pa.ipc.new_stream(s, schema) for s in streams]
    held, table = table.batches, None
    for batch in chain(held, batches):
        bucket = batch.column("_h").to_numpy() >> FAN_BITS * level & (1 << FAN_BITS) - 1
        for b in np.unique(bucket):
            writers[b].write_batch(batch.filter(pa.array(bucket == b)))
    del held
    for writer, stream in zip(writers, streams, strict=True):
        writer.close()
        stream.close()
    for path in paths:
        with files.open_input_stream(path) as stream, pa.ipc.open_stream(stream) as reader:
            yield from _grace_rows(iter(reader), text, level + 1, files, folder, table_bytes)
        files.delete_file(path)


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of docs, all columns, one of each class of equal texts: that with the largest id, any one of those that
    repeat it. The other columns take no part in the comparison.

    A null text equals an empty one. A null id is smaller than any other, so such a row stays only where no row of its
    class has an id. Very long texts are compared whole; a bucket that is too large for memory is spilled. Columns named
    as the operator's own are told apart by their place. An empty table gives no rows.

    The same Grace hashing as for `membership`, with whole rows: each task drops the copies in its own input, the rest
    is dealt out once, and nothing is joined.
    """
    spill, names = shared_dir(docs.sparkSession, "spill"), docs.columns
    text = names.index(text_col)
    # Further columns stand last, and are told apart by name only if docs has none of that name.
    if {"_h", "_id"} & {c.lower() for c in names}:
        plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
        return survivors(plain, f"c{names.index(id_col)}", f"c{text}", table_bytes).toDF(*names)
    hashed = docs.withColumns({"_h": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "_id": F.col(id_col).cast("long")})

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = RowTable(text)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                table.add(batch.slice(at, 500))
            if table.bytes > table_bytes // 2:
                yield from table.result().to_batches()
                table = RowTable(text)
        if table.rows:
            yield from table.result().to_batches()
        del table
        pa.default_memory_pool().release_unused()

    def deduplicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = filesystem(spill)
        folder = f"{path}/{uuid.uuid4().hex}"
        try:
            for batch in _grace_rows(batches, text, 0, files, folder, table_bytes):
                yield batch.select(range(batch.num_columns - 2))
        finally:
            pa.default_memory_pool().release_unused()
            if files.get_file_info(folder).type.name == "Directory":
                files.delete_dir(folder)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return hashed.mapInArrow(collapse, hashed.schema).repartition(parts, "_h").mapInArrow(deduplicate, docs.schema)
