"""WARC archives with a two-level capture index.

Records are gzip members of their own. The index sorts captures by the URL key with the host reversed and stores them
in compressed blocks; a sparse directory holds the first and last key of every block. A look-up reads the part of the
directory about its keys, searches that, reads blocks by their ranges, searches those, and reads records by their ranges.
`lookup` does so for a whole table of keys: tasks get ranges of them.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.llm.common import filesystem, materialise, publish, shared_dir

#: An archive is closed at this size; captures in a block of the index; captures in one index file at most.
ARCHIVE_BYTES, BLOCK_CAPTURES, INDEX_CAPTURES = 32 << 20, 500, 500_000
#: The date of records whose time is not known, so that equal inputs give equal archives.
DATE = "1970-01-01T00:00:00Z"
_DIRECTORY = "first_key string, last_key string, file string, offset long, length long, captures long"
_CAPTURE = "key string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """A URL in sort order of hosts: `http://www.a.example.org:80/x?q` becomes `org,example,a)/x?q`. The scheme, a
    leading www, default ports, a fragment and the case count for nothing. What is no URL is its own key."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    if not host:
        return url
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    at = f":{port}" if port and port not in (80, 443) else ""
    return f"{host}{at}){(parts.path or '/').lower()}{'?' + parts.query.lower() if parts.query else ''}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None, code: str) -> str:
    """The name of a record: its page and the digest of its payload. So pages that repeat an id, or have none, differ in
    name unless they are equal, and a revisit can name the response that it refers to."""
    return f"<urn:page:{'' if page_id is None else page_id}:{code}>"


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """One WARC record, compressed. A revisit has no payload, but its length and digest."""
    code = digest(payload)
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _urn(page_id, code), "WARC-Date": DATE, "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"), "WARC-Payload-Digest": f"sha1:{code}", "X-Payload-Length": str(len(payload))}
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _urn(first, code)}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (b"" if revisit else payload)
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body))}
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(lines.encode("utf-8") + body + b"\r\n\r\n", 6, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the payload of one record; the payload is checked against its digest."""
    raw = zlib.decompress(data, 31)
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    body = body[: int(fields["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and f"sha1:{digest(payload)}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} has changed")
    return fields, payload


def info() -> bytes:
    """The record that opens an archive."""
    body = b"software: amberline\r\nformat: WARC File Format 1.1\r\n"
    head = {"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:warcinfo>", "WARC-Date": DATE, "Content-Type": "application/warc-fields", "Content-Length": str(len(body))}
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(lines.encode("utf-8") + body + b"\r\n\r\n", 6, mtime=0)


def _page(urn: str) -> int | None:
    n = urn.removeprefix("<urn:page:").removesuffix(">").partition(":")[0]
    return int(n) if n else None


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for each row and return the captures.

    Of rows with equal payloads (null: empty) the one with the smallest id is a response, the others revisit it. A null
    id is larger than any other. Rows that repeat the smallest id are all responses.
    """
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    same = F.sha2("html", 256)
    several = pages.groupBy(same.alias("same")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # As a written table its side of the join is bare, so that Spark can broadcast it if small or split a large group.
    several = materialise(several, "payloads")
    marked = pages.withColumn("same", same).join(several, "same", "left").select("page_id", "url", "html", "first", (F.col("same").isNotNull() & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))).alias("revisit"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        opening = info()
        records: list[bytes] = [opening]
        captures: list[tuple] = []
        offset = len(opening)

        def close() -> pa.RecordBatch:
            publish(f"{folder}/{captures[0][2]}", lambda out: [out.write(r) for r in records])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*captures, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "file", "offset", "length"])

        for batch in batches:
            for page_id, url, html, first, revisit in zip(*(batch.column(c) for c in ("page_id", "url", "html", "first", "revisit")), strict=True):
                data = record(page_id.as_py(), url.as_py(), html.as_py().encode("utf-8"), first.as_py(), revisit.as_py())
                captures.append((url_key(url.as_py()), page_id.as_py(), f"part-{part:06d}-{seq:05d}.warc.gz", offset, len(data)))
                records.append(data)
                offset += len(data)
                if offset >= ARCHIVE_BYTES:
                    yield close()
                    records, captures, offset, seq = [opening], [], len(opening), seq + 1
        if captures:
            yield close()

    marked.mapInArrow(archive, _CAPTURE).write.parquet(f"{folder}/captures.parquet")
    return pages.sparkSession.read.schema(_CAPTURE).parquet(f"{folder}/captures.parquet")


def index(captures: DataFrame, folder: str) -> None:
    """Write the blocks, and the directory (directory.parquet: first and last key, file, offset, length and captures of a
    block), which is in order of the keys, so that readers of a range of it skip the rest.

    The captures are dealt out by ranges of (key, page_id), so a key of a host with very many pages is split as well.
    """
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length")), strict=True)

        stream, seq = rows(), 0
        while True:
            held, directory, offset, taken = [], [], 0, 0
            name = f"part-{part:06d}-{seq:05d}.index"
            while taken < INDEX_CAPTURES and (block := [r for _, r in zip(range(BLOCK_CAPTURES), stream)]):
                data = zlib.compress("\n".join(json.dumps(r) for r in block).encode(), 6)
                directory.append((block[0][0], block[-1][0], name, offset, len(data), len(block)))
                held.append(data)
                offset += len(data)
                taken += len(block)
            if not held:
                return
            publish(f"{folder}/{name}", lambda out, held=held: [out.write(d) for d in held])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*directory, strict=True)], ["first_key", "last_key", "file", "offset", "length", "captures"])
            seq += 1

    ordered = captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    ordered.mapInArrow(blocks, _DIRECTORY).write.parquet(f"{folder}/directory.parquet")


def _block(data: bytes) -> list[list]:
    return [json.loads(line) for line in zlib.decompress(data).decode().split("\n")]


def _ranges(folder: str, wanted: Iterator[tuple]) -> Iterator[tuple[tuple, bytes]]:
    """The bytes of (file, offset, length, ...) rows; rows of one file that follow each other open it once."""
    for name, group in groupby(wanted, key=lambda r: r[0]):
        files, path = filesystem(f"{folder}/{name}")
        with files.open_input_file(path) as f:
            for row in group:
                yield row, f.read_at(row[2], row[1])


def _within(block: list[list], key: str) -> list[list]:
    """The captures of a key in a block, by binary search."""
    return block[bisect.bisect_left(block, key, key=lambda r: r[0]) : bisect.bisect_right(block, key, key=lambda r: r[0])]


class Lookup:
    """Single look-ups: the directory is asked for the blocks about a key; blocks and records are read by their ranges."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder
        self.directory = spark.read.schema(_DIRECTORY).parquet(f"{folder}/directory.parquet")

    def captures(self, url: str) -> list[list]:
        """All captures of a URL."""
        key = url_key(url)
        blocks = self.directory.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).select("file", "offset", "length").collect()
        return [r for _, data in _ranges(self.folder, iter(sorted(tuple(b) for b in blocks))) for r in _within(_block(data), key)]

    def read(self, capture: list) -> tuple[dict[str, str], bytes]:
        ((_, data),) = _ranges(self.folder, iter([tuple(capture[2:5])]))
        return parse(data)


def _directory_range(folder: str, low: str, high: str) -> list[tuple]:
    """(first_key, last_key, file, offset, length) of the blocks that overlap a range of keys, in order."""
    files, path = filesystem(f"{folder}/directory.parquet")
    wanted = (pc.field("first_key") <= high) & (pc.field("last_key") >= low)
    found = dataset.dataset(path, filesystem=files, format="parquet").to_table(columns=["first_key", "last_key", "file", "offset", "length"], filter=wanted)
    return sorted(zip(*(c.to_pylist() for c in found.columns), strict=True))


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """The captures (key, page_id, file, offset, length) of a table of URL keys (column key).

    Tasks get ranges of keys in order, and search the directory's part about them. What they find are blocks; those are
    dealt out again, so that a key with very many captures is read by many tasks. Keys that repeat are asked once.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("key").to_pylist()
            if not asked:
                continue
            directory = _directory_range(folder, asked[0], asked[-1])
            lasts, out = [d[1] for d in directory], []
            for key in asked:
                at = bisect.bisect_left(lasts, key)  # the first block that does not end before it
                while at < len(directory) and directory[at][0] <= key:
                    out.append((key, *directory[at][2:]))
                    at += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "file", "offset", "length"])

    def captures_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, []
        for batch in batches:
            out = []
            for key, *place in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True):
                if place != at:
                    ((_, data),) = _ranges(folder, iter([tuple(place)]))
                    at, block = place, _block(data)
                out += _within(block, key)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "file", "offset", "length"])

    sorted_keys = keys.select("key").distinct().repartitionByRange(parts, "key").sortWithinPartitions("key")
    blocks = sorted_keys.mapInArrow(blocks_of, "key string, file string, offset long, length long")
    return blocks.repartition(parts, "file", "offset").sortWithinPartitions("file", "offset", "key").mapInArrow(captures_of, _CAPTURE)


def records(captures: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of captures, read by their ranges. A response's
    length and digest come from the payload itself, a revisit's from its headers."""

    def read_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            wanted = zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True)
            for _, data in _ranges(folder, wanted):
                fields, payload = parse(data)
                revisit = fields["WARC-Type"] == "revisit"
                size = int(fields["X-Payload-Length"]) if revisit else len(payload)
                out.append((_page(fields["WARC-Record-ID"]), size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], _page(fields["WARC-Refers-To"]) if revisit else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_place = captures.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return by_place.mapInArrow(read_each, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def keys_of(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The URL key of each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string())], ["key"])

    return pages.select(F.col(url_col).cast("string").alias("url")).mapInArrow(each, "key string")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives, in the order of the index: blocks are read by the directory, records by the blocks."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = sorted(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            for _, data in _ranges(folder, iter(wanted)):
                rows = [(r[2], r[3], r[4]) for r in _block(data)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["file", "offset", "length"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    directory = spark.read.schema(_DIRECTORY).parquet(f"{folder}/directory.parquet")
    return records(directory.repartition(parts, "file", "offset").mapInArrow(entries, "file string, offset long, length long"), folder)


def write_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """`write` and `index` to a new shared folder, then look every page's URL up in the index and read its records.

    A null URL has the empty key, as any other that is none. Each record is read once, however many pages share its URL.
    An empty table gives no rows. Columns besides the three take no part, whatever their names.
    """
    folder = shared_dir(pages.sparkSession, "warc")
    index(write(pages, folder, id_col, url_col, payload_col), folder)
    return records(lookup(keys_of(pages, url_col), folder), folder)
