"""Line dedup by pairwise alignment.

A block is a run of lines of at least LEAST_WORDS words that two documents both have, one after another. Documents are
found to overlap by the hashes of short runs: for every line, the shortest run of lines from it on, and the shortest
that ends with it, of so many words. Every block is made of such runs, and no block lacks one.

* A rare run, one of at most RARE places, links each of its documents with every earlier one.
* Any other links each of its documents with the earliest: n documents give n - 1 links, so none is too common.

So each run that an earlier document has is looked at in a pair whose earlier document has it. Each linked pair is aligned
as patience diff does it: runs that occur once in both are matched, the longest rising sequence of them stays, and it
grows along the lines beside it as long as those are equal in both. What is left over (passages that moved, or that the
later document repeats) waits in a queue; each such run is put where the earlier document has it and grows likewise.
The blocks of every pair are deleted from the later document.

A pair is a row of the later document's linked runs, beside all lines of the earlier one. A document that very many
others link to is sent to several tasks, each of which has a bounded share of those.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.llm.common import id_and_text, materialise

#: Blocks of fewer words than this stay: a lone heading or licence line is no copied passage.
LEAST_WORDS = 10
#: Runs of at most so many places link all their documents; linked runs that one task takes beside an earlier document.
RARE, SHARE = 4, 20_000
DIGEST = 16
#: Letters of scripts that do not part words; two of them count as a word.
_UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")


def weight(line: str) -> int:
    """The words of a line that is not blank; at least one."""
    words = len(line.split())
    return max(1, words if line.isascii() else words + len(_UNSPACED.findall(line)) // 2)


def shortest_runs(weights: list[int], least: int) -> list[tuple[int, int]]:
    """(start, end) of the shortest run of at least `least` from each line on, and of the shortest that ends with it."""
    total = np.concatenate([[0], np.cumsum(weights)]).astype(np.int64)
    n = len(weights)
    ends = np.searchsorted(total, total[:-1] + least)
    out = {(s, e) for s, e in enumerate(ends.tolist()) if e <= n}
    starts = np.searchsorted(total, total[1:] - least, side="right") - 1
    out |= {(s, e + 1) for e, s in enumerate(starts.tolist()) if s >= 0}
    return sorted(out)


def rising(values: list[int]) -> list[int]:
    """The indices of a longest strictly rising subsequence."""
    tails, last, before = [], [], []
    for i, v in enumerate(values):
        k = bisect.bisect_left(tails, v)
        tails[k : k + 1], last[k : k + 1] = [v], [i]
        before.append(last[k - 1] if k else -1)
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


class Earlier:
    """The earlier document of a pair: its lines' digests, and where its runs are."""

    def __init__(self, digests: bytes, weights: list[int], least: int):
        self.lines = [digests[i : i + DIGEST] for i in range(0, len(digests), DIGEST)]
        self.places: dict[bytes, list[int]] = {}
        for s, e in shortest_runs(weights, least):
            self.places.setdefault(digests[s * DIGEST : e * DIGEST], []).append(s)

    def align(self, runs: list[tuple[int, bytes]]) -> set[int]:
        """The positions of the later document that lie in aligned blocks. runs: the starts and digests of its runs that
        this document has, each once, in order."""
        runs = [(p, content) for p, content in runs if content in self.places]
        later = {p + i // DIGEST: content[i : i + DIGEST] for p, content in runs for i in range(0, len(content), DIGEST)}
        out: dict[int, int] = {}

        def grow(p: int, q: int, content: bytes) -> None:
            size = len(content) // DIGEST
            out.update({p + i: q + i for i in range(size)})
            for i, j, step in ((p + size, q + size, 1), (p - 1, q - 1, -1)):
                while 0 <= j < len(self.lines) and i not in out and later.get(i) == self.lines[j]:
                    out[i] = j
                    i, j = i + step, j + step

        times = Counter(content for _, content in runs)
        once = [(p, self.places[content][0], content) for p, content in runs if times[content] == 1 and len(self.places[content]) == 1]
        for i in rising([q for _, q, _ in once]):
            grow(*once[i])
        for p, content in runs:
            left = next((i for i in range(len(content) // DIGEST) if p + i not in out), None)
            if left is not None:
                # Of its places the next one after what stands before it, else the first.
                places = self.places[content]
                at = bisect.bisect_right(places, out.get(p - 1, -1))
                grow(p, places[at] if at < len(places) else places[0], content)
        return set(out)


def _scan(docs: DataFrame, least: int) -> DataFrame:
    """Of each document the digests and the weights of its lines, and its runs with their keys."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                piece = batch.slice(at, 200)
                digests, weights, runs, keys, sizes = [], [], [], [], [0]
                for text in piece.column("text"):
                    lines = [x for x in text.as_py().split("\n") if x.strip(" ")]
                    own = [xxhash.xxh3_128_digest(x.encode("utf-8")) for x in lines]
                    digests.append(b"".join(own))
                    weights.append([weight(x) for x in lines])
                    found = shortest_runs(weights[-1], least) if lines else []
                    runs += found
                    keys += [own[s] if e - s == 1 else xxhash.xxh3_128_digest(digests[-1][s * DIGEST : e * DIGEST]) for s, e in found]
                    sizes.append(len(runs))
                places = np.array(runs, np.int32).reshape(-1, 2)
                halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                columns = [pa.array(np.ascontiguousarray(c)) for c in (places[:, 0], places[:, 1], halves[:, 0], halves[:, 1])]
                of_doc = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(columns, ["start", "end", "k1", "k2"]))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("text_hash"), pa.array(digests, pa.binary()), pa.array(weights, pa.list_(pa.int32())), of_doc],
                    ["doc_id", "text_hash", "digests", "weights", "runs"],
                )

    return docs.mapInArrow(each, "doc_id long, text_hash long, digests binary, weights array<int>, runs array<struct<start:int,end:int,k1:long,k2:long>>")


def _document(id_col: str = "doc_id", hash_col: str = "text_hash") -> Column:
    return F.struct(F.col(id_col).alias("doc_id"), F.col(hash_col).alias("text_hash"))


def links(scanned: DataFrame) -> DataFrame:
    """e and d, the earlier and the later document, and a run of d that e has: its start and its lines' digests."""
    run = F.col("r")
    lines = F.expr(f"substring(digests, r.start * {DIGEST} + 1, (r.end - r.start) * {DIGEST})")
    runs = scanned.select(_document().alias("d"), "digests", F.explode("runs").alias("r")).select("d", run["start"].alias("start"), run["k1"].alias("k1"), run["k2"].alias("k2"), lines.alias("lines"))
    held = runs.groupBy("k1", "k2").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count("*").alias("n"))
    shared = materialise(held.where(~F.col("first").eqNullSafe(F.col("last"))).drop("last"), "keys")
    found = runs.join(shared, ["k1", "k2"])
    common = found.where((F.col("n") > RARE) & ~F.col("d").eqNullSafe(F.col("first"))).select(F.col("first").alias("e"), "d", "start", "lines")
    # At most RARE places, so the lists are short.
    places = found.where(F.col("n") <= RARE).groupBy("k1", "k2").agg(F.collect_list(F.struct("d", "start", "lines")).alias("places"))
    pairs = F.flatten(F.transform("places", lambda x: F.transform(F.filter("places", lambda y: y["d"] < x["d"]), lambda y: F.struct(y["d"].alias("e"), x["d"].alias("d"), x["start"].alias("start"), x["lines"].alias("lines")))))
    return common.unionByName(places.select(F.explode(pairs).alias("p")).select("p.e", "p.d", "p.start", "p.lines"))


def removed_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text_hash and the sorted positions `removed` for each document of docs (doc_id, text, text_hash) that
    loses lines. Blank lines are never shared; they are passed over, and end no block."""
    scanned = materialise(_scan(docs, least_words), "lines")
    linked = materialise(links(scanned), "links")
    earlier = materialise(linked.groupBy("e").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")), "earlier")
    same = F.col("e.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("e.text_hash") == F.col("text_hash"))
    # Rows that repeat id and text are one document.
    first = earlier.join(scanned.select("doc_id", "text_hash", "digests", "weights"), same).groupBy("e").agg(F.first("shares").alias("shares"), F.first("digests").alias("digests"), F.first("weights").alias("weights"))
    whole = first.select("e", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("start"), F.col("digests").alias("lines"), "weights").withColumn("d", F.lit(None).cast("struct<doc_id:bigint,text_hash:bigint>"))
    share = F.pmod(F.xxhash64("d"), F.col("shares")).cast("int")
    later = linked.join(earlier, linked["e"].eqNullSafe(earlier["e"])).select(linked["e"], share.alias("share"), "start", "lines", F.lit(None).cast("array<int>").alias("weights"), "d")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = whole.unionByName(later).select("share", F.col("e.doc_id").alias("e_id"), F.col("e.text_hash").alias("e_hash"), F.col("d").isNotNull().alias("is_later"), F.col("d.doc_id").alias("doc_id"), F.col("d.text_hash").alias("text_hash"), "start", "lines", "weights")
    order = ["e_id", "e_hash", "share", "is_later", "doc_id", "text_hash", "start"]
    dealt = both.repartition(parts, "e_id", "e_hash", "share").sortWithinPartitions(*order)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earlier, now, runs = None, None, []
        out: list[tuple] = []

        def done() -> None:
            if runs:
                out.append((*now, sorted(earlier.align(runs))))

        def rows() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "removed"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("is_later", "doc_id", "text_hash", "start", "lines", "weights")]
            for is_later, doc_id, text_hash, start, lines, weights in zip(*columns, strict=True):
                if not is_later or (doc_id, text_hash) != now:
                    done()
                    now, runs = (doc_id, text_hash), []
                if is_later:
                    if not runs or runs[-1] != (start, lines):
                        runs.append((start, lines))
                else:
                    earlier = Earlier(lines, weights, least_words)
            if len(out) > 2000:
                yield rows()
                out = []
        done()
        if out:
            yield rows()

    found = dealt.mapInArrow(each, "doc_id long, text_hash long, removed array<int>")
    return found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, words_removed and text (what is left) of every row.

    Lines are parted by line feeds; n_lines counts those that are not blank. A document is later than another if its
    doc_id is larger (a null one is the smallest), or if the ids are equal and the hash of its text is larger. A line is
    deleted if it lies in a block: consecutive lines (blank ones passed over) of together at least `least_words` words
    that an earlier document has consecutively too. A line counts at least one word, and two letters of a script that
    does not part words count as one. Rows that repeat id and text are one document: they do not delete each other's
    lines and each gives the same row. A null text counts as empty. An empty table gives no rows. Time and memory grow in
    proportion to the lines of a text, repeated ones too. Columns besides id and text take no part, whatever their names.
    """
    docs = id_and_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    # The table grows with the documents, so it is never broadcast, however small it is at first.
    gone = materialise(removed_lines(docs, least_words), "removed").hint("merge")
    joined = docs.alias("d").join(gone.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.text_hash") == F.col("r.text_hash")), "left").select("d.doc_id", "text", "removed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for text, removed in zip(batch.column("text"), batch.column("removed"), strict=True):
                gone, left, at, words = set(removed.as_py() or ()), [], 0, 0
                for line in text.as_py().split("\n"):
                    if line.strip(" "):
                        if at in gone:
                            words += len(line.split())
                        else:
                            left.append(line)
                        at += 1
                    else:
                        left.append(line)
                for column, x in zip(columns, (at, len(gone), words, "\n".join(left)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_lines", "n_removed", "words_removed", "text"])

    return joined.mapInArrow(cut, "doc_id long, n_lines long, n_removed long, words_removed long, text string")

