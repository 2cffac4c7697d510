"""SimHash near-duplicates by an inverted index over byte positions, with count filtering.

Fingerprints of 64 bits that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they share at least 5
positional bytes. Single positional bytes would make lists of 1/256 of all fingerprints, so the index keys its lists by
the bytes at four positions at once. The position sets are the 14 sets of four positions whose numbers give zero under
exclusive or; any three positions are disjoint from one of them, so every pair that shares 5 positional bytes meets in
some list. Within a list the shared positional bytes of a pair are tallied: the four of the list, and those of the other
positions. Pairs under 5 are dropped, and the rest are verified by their differing bits.

A crowded list is dealt out once more, by each of its other four positions and the byte there: a pair that reaches the
fifth shared byte meets in one of these, so no link is lost, and the list is shared among up to 1024 tasks' lists. What
is crowded still is cut within its task, by the bits that are left: of four groups of them, one is equal in any two
fingerprints that differ in 3 bits.

Only distinct fingerprints are indexed, and a list gives the links of a spanning forest, not all its pairs: n
fingerprints give fewer than n links, and those connect whatever the list's pairs connect.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberline.llm.common import id_and_text, materialise, runs
from amberline.operators.graph import components

SEED, SHINGLE_WORDS, MOST_BITS = 42, 3, 3
POSITIONS = [p for p in combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]
LEAST_SHARED = 8 - MOST_BITS
#: A list with more fingerprints is dealt out once more; one with more than that within a task is cut there.
CROWDED, IN_MEMORY = 5_000, 1_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_AT_ONCE = 1 << 18


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a whole text; zero for one without words."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return 0
    k = min(shingle_words, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), _AT_ONCE):
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _AT_ONCE], ends[at : at + _AT_ONCE], strict=True)])
        columns = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
        for b in range(8):
            counts[8 * b : 8 * b + 8] += np.bincount(columns[:, b], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text) and fp (the fingerprint as a signed long) of every row.

    Null, empty and word-less texts have fingerprint zero. Rows that repeat are not put together; a null id stays null.
    Very long texts are hashed in pieces of bounded memory. Other columns take no part, whatever their names. An empty
    table gives no rows.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([fingerprint(t.as_py(), shingle_words) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(out, pa.int64())], ["doc_id", "text_hash", "fp"])

    texts = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return texts.mapInArrow(hashed, "doc_id long, text_hash long, fp long")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy()
        columns = fps.view(np.uint8).reshape(-1, 8).astype(np.int64)
        for k, (a, b, c, d) in enumerate(POSITIONS):
            keys = np.int64(k) << 32 | columns[:, a] << 24 | columns[:, b] << 16 | columns[:, c] << 8 | columns[:, d]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps)], ["key", "fp"])


def forest(fps: np.ndarray, most_bits: int = MOST_BITS) -> list[tuple[int, int]]:
    """Links of a spanning forest of one list: distinct fingerprints, linked at most_bits or fewer differing bits."""
    out, left = [], fps
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            differ = left ^ at
            shared = 8 - np.count_nonzero(differ.view(np.uint8).reshape(-1, 8), axis=1)
            near = shared >= 8 - most_bits
            near[near] = np.bitwise_count(differ[near]) <= most_bits
            if near.any():
                found = left[near]
                out += [(int(at), int(x)) for x in found]
                queue += list(found)
                left = left[~near]
    return out


def cut_forest(fps: np.ndarray, most_bits: int = MOST_BITS) -> list[tuple[int, int]]:
    """Links that connect what all links of a list connect, without comparing each with each: the bits in which its
    fingerprints differ are cut into most_bits + 1 groups, one of which is equal in any two that are linked."""
    differ = int(np.bitwise_or.reduce(fps ^ fps[0]))
    free = [b for b in range(64) if differ >> b & 1]
    if len(fps) <= IN_MEMORY or len(free) <= 2 * most_bits:
        return forest(fps, most_bits)
    out: list[tuple[int, int]] = []
    for group in np.array_split(np.array(free, np.uint64), most_bits + 1):
        mask = np.bitwise_or.reduce(np.uint64(1) << group)
        order = np.argsort(fps & mask, kind="stable")
        value = fps[order] & mask
        cuts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1], [True]]))
        for i in np.flatnonzero(np.diff(cuts) > 1):
            out += cut_forest(fps[order[cuts[i] : cuts[i + 1]]], most_bits)
    return out


def _dealt_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of crowded lists under four keys each: the list, another position, and the byte there."""
    for batch in batches:
        keys, fps = batch.column("key").to_numpy(), batch.column("fp")
        columns = fps.to_numpy().view(np.uint8).reshape(-1, 8)
        places = np.array([[p for p in range(8) if p not in s] for s in POSITIONS])[keys >> 32]
        for j in range(4):
            at = places[:, j]
            byte = np.take_along_axis(columns, at[:, None], axis=1)[:, 0].astype(np.int64)
            # Above the lists' own keys: 4 + 3 + 8 bits for list, position and byte, over the 32 of the list's bytes.
            again = np.int64(1) << 48 | (keys >> 32) << 44 | at.astype(np.int64) << 41 | byte << 33
            yield pa.RecordBatch.from_arrays([pa.array(again), pa.array(keys & 0xFFFFFFFF), fps], ["key", "sub", "fp"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in runs(batches, ["key", "sub"]):
        keys, subs, fps = table.column("key").to_numpy(), table.column("sub").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (subs[1:] != subs[:-1]), [True]]))
        several = np.flatnonzero(np.diff(cuts) > 1)
        pairs: list[tuple[int, int]] = []
        for i in several:
            pairs += cut_forest(fps[cuts[i] : cuts[i + 1]])
            if len(pairs) > 50_000:
                yield _pairs(pairs)
                pairs = []
        if pairs:
            yield _pairs(pairs)


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    ab = np.array(pairs, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect what all links of 3 bits or fewer connect."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = distinct.select("fp").mapInArrow(_postings, "key long, fp long")
    sizes = materialise(lists.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("key", F.lit(True).alias("crowded")), "crowded")
    marked = lists.join(sizes, "key", "left")
    plain = marked.where("crowded IS NULL").select("key", F.lit(0).cast("long").alias("sub"), "fp")
    again = marked.where("crowded").select("key", "fp").mapInArrow(_dealt_again, "key long, sub long, fp long")
    dealt = plain.unionByName(again).repartition(parts, "key", "sub").sortWithinPartitions("key", "sub", "fp")
    return dealt.mapInArrow(_links, "a long, b long")


def membership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_hash, fp and component_id (the smallest doc_id of its component) of every row.

    Rows that repeat an id each give a row. A null id is in a component but never names one unless all its ids are null.
    Texts without words have fingerprint zero and link like any other. An empty table gives no rows.
    """
    each = materialise(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    distinct = materialise(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = materialise(rooted.join(least, "root").select("fp", "component_id"), "components")
    return each.join(by_fp, "fp").select("doc_id", "text_hash", "fp", "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay: of each component the document with the smallest id.

    Rows that repeat both that id and its text are the same document and all stay; rows with a null id stay only if no
    row of their component has one.
    """
    gone = membership(docs, id_col, text_col).where(~F.col("component_id").eqNullSafe(F.col("doc_id")))
    gone = materialise(gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")).distinct(), "gone")
    text_hash = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["_id"]) & (text_hash == gone["_text"]), "left_anti")
