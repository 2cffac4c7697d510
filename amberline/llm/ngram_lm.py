"""LM scoring with an n-gram trie (words and word pairs) in Elias-Fano levels, built from all training documents.

The work is an exchange between blocks of documents and shards of the model, in which a block sends each of its words
and word pairs once, however often it has them. So no word or pair, however common, is a hot key.

1. Blocks. Each task tokenises its documents, stores them as blocks of local word numbers in the shared folder and
   sends the block's distinct words with their counts in training documents.
2. Words. The counts of each word are summed, the word gets a number, and both go back to each block that has it.
3. Pairs. Each block sends its distinct pairs (context, word) with their training counts to the shards; a shard is
   told by the context. A context that makes up much of all tokens is dealt over several shards by its words.
4. Shards. Each sums the counts, keeps the pairs that occur at least min_count times, writes their discounted
   probabilities as a trie, and answers each block from the mapped trie: the code of each pair, and for each context
   what its kept successors have in all, exactly, and by how much their codes miss that.
5. Scores. Each block adds up its documents.

The model is interpolated absolute discounting. With N training tokens of V distinct ones, and c counts:

    p(w)       = (c(w) + 1) / (N + V + 1)
    p(w | u)   = d(u, w) + (1 - sum of d(u, x) over x) * p(w),   d(u, w) = (c(u, w) - DISCOUNT) / c(u) or 0 if not kept

where u is the token before w, or the start of the text. An unknown u gives p(w). The sum of d(u, x) comes from exact
counts, so at least DISCOUNT / c(u) is left for p(w); the decoded d(u, w) are scaled to that sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberline.llm.common import filesystem, id_and_text, materialise, publish, runs, shared_dir
from amberline.llm.elias_fano import Trie, dequantise, quantise

#: The default; with 1 every pair is kept.
MIN_COUNT, DISCOUNT = 2, 0.75
#: A block is closed at this many tokens (a longer document is a block of its own); training tokens that a shard is
#: made for.
BLOCK_TOKENS, SHARD_TOKENS = 2_000_000, 3_000_000
#: Sums of discounted counts are kept as multiples of 1 / PARTS, scales of decoded probabilities as multiples of 1 / FINE.
PARTS, FINE = 4, 1 << 20
START, UNKNOWN = 0, -1
_MIX = 0x9E3779B97F4A7C15


def _shrink(a: np.ndarray) -> bytes:
    """An array of numbers from 0, in the least width that holds them, compressed."""
    width = next(w for w in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << 8 * w)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(a.astype(f"<u{width}").tobytes())


def _grow(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


def _save(uri: str, **arrays: np.ndarray) -> None:
    packed = pa.RecordBatch.from_pydict({k: [_shrink(a)] for k, a in arrays.items()})

    def write(out) -> None:
        with pa.ipc.new_stream(out, packed.schema) as w:
            w.write_batch(packed)

    publish(uri, write)


def _load(uri: str) -> dict[str, np.ndarray]:
    files, path = filesystem(uri)
    with files.open_input_stream(path) as f, pa.ipc.open_stream(f) as r:
        return {k: _grow(v[0]) for k, v in r.read_all().to_pydict().items()}


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z in lower case."""
    return text.encode("utf-8").lower().split() if text else []


def _blocks(docs: DataFrame, folder: str) -> DataFrame:
    """Store the blocks; block, word, at (its local number) and n (its count in training documents) of their words.
    The empty word stands for the end of a text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        numbers, streams, ids, sizes, trains, total = _Numbers({b"": 0}), [], [], [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            block = part << 24 | seq
            stream, size, train = np.concatenate(streams), np.array(sizes, np.int64), np.array(trains, bool)
            null = np.array([i is None for i in ids], np.int64)
            _save(f"{folder}/blocks/{block}", stream=stream, sizes=size, train=train, null=null, ids=np.array([i or 0 for i in ids], np.int64).view(np.uint64))
            count = np.bincount(stream[np.repeat(train, size)], minlength=len(numbers))
            keys = list(numbers)
            for at in range(0, len(keys), 50_000):
                n = len(keys[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array([k.decode("utf-8") for k in keys[at : at + n]]), pa.array(np.arange(at, at + n)), pa.array(count[at : at + n])], ["block", "word", "at", "n"])

        for batch in batches:
            for doc_id, text, train in zip(batch.column("doc_id"), batch.column("text"), batch.column("train"), strict=True):
                local = [numbers[w] for w in words(text.as_py())]
                local.append(0)
                streams.append(np.array(local, np.int64))
                ids.append(doc_id.as_py())
                sizes.append(len(local))
                trains.append(train.as_py())
                total += len(local)
                if total >= BLOCK_TOKENS:
                    yield from close()
                    seq += 1
                    numbers, streams, ids, sizes, trains, total = _Numbers({b"": 0}), [], [], [], [], 0
        if ids:
            yield from close()

    return docs.mapInArrow(each, "block long, word string, at long, n long")


def _order(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order by (context, word)."""
    width = int(word.max()) + 1 if len(word) else 1
    if len(context) and int(context.max()) < (1 << 62) // width:
        return np.argsort(context * width + word)
    return np.lexsort((word, context))


class _Pairs:
    """The distinct pairs of a block whose word and context are known, in order of (context, word)."""

    def __init__(self, folder: str, block: int):
        self.docs, known = _load(f"{folder}/blocks/{block}"), _load(f"{folder}/known/{block}")
        stream = self.docs["stream"]
        top = int(stream.max()) + 1
        number, count = np.full(top, UNKNOWN, np.int64), np.zeros(top, np.int64)
        number[known["at"]], count[known["at"]] = known["id"], known["c"]
        self.word, self.count = number[stream], count[stream]
        ends = np.cumsum(self.docs["sizes"])
        starts = ends - self.docs["sizes"]
        self.starts = starts
        context = np.empty_like(self.word)
        context[1:], context[starts] = self.word[:-1], START
        self.valid = (context >= 0) & (self.word >= 0)
        # The start of a text occurs as often as its end, which has the local number 0.
        context_count = np.empty_like(self.count)
        context_count[1:], context_count[starts] = self.count[:-1], count[0]
        train = np.repeat(self.docs["train"].astype(bool), self.docs["sizes"])[self.valid]
        c, w, cc = context[self.valid], self.word[self.valid], context_count[self.valid]
        order = _order(c, w)
        c, w, cc, train = c[order], w[order], cc[order], train[order]
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
        first = np.flatnonzero(new)
        self.context, self.pair_word, self.context_count = c[first], w[first], cc[first]
        self.n = np.add.reduceat(train.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        # Which distinct pair each valid position is.
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1

    def dealt(self, tokens: int, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """What goes to each shard: its number, the pairs' indices, the contexts, the pairs of each and its own count.

        A context goes to one shard, unless it has more than a quarter of a shard's share of all tokens: then its pairs
        are spread over several by their words, and all of those are asked about it, with or without a pair.
        """
        mix = lambda x: (x.astype(np.uint64) * np.uint64(_MIX)) >> np.uint64(33)
        over = lambda count: np.clip(-(-4 * count * shards // max(tokens, 1)), 1, shards)
        to = (mix(self.context) + mix(self.pair_word + 1) % over(self.context_count).astype(np.uint64)) % np.uint64(shards)
        order = np.argsort(to, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], self.context[1:] != self.context[:-1]])) if len(self.context) else np.zeros(0, np.int64)
        contexts, counts = self.context[first], self.context_count[first]
        times = over(counts)
        which = np.repeat(np.arange(len(contexts)), times)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        asked = (mix(contexts[which]) + nth.astype(np.uint64)) % np.uint64(shards)
        by = np.argsort(asked, kind="stable")
        bounds = np.arange(shards + 1).astype(np.uint64)
        cuts, ask_cuts = np.searchsorted(to[order], bounds), np.searchsorted(asked[by], bounds)
        for s in np.flatnonzero(np.diff(ask_cuts)):
            i, k = order[cuts[s] : cuts[s + 1]], which[by[ask_cuts[s] : ask_cuts[s + 1]]]
            here = self.context[i]
            sizes = np.searchsorted(here, contexts[k], side="right") - np.searchsorted(here, contexts[k])
            yield int(s), i, contexts[k], sizes, counts[k]


def score(docs: DataFrame, modulus: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Learns from the rows whose crc32(doc_id as text) by `modulus` is not `held`; those are held out. Rows with a null id
    teach nothing and are not held out. A null or empty text is scored by its end alone. Each row that repeats an id
    counts and is scored by itself. If there are no training documents every count is 0. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "ngrams")
    docs = id_and_text(docs, id_col, text_col)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    docs = docs.withColumn("train", F.coalesce(fold != held, F.lit(False)))
    words_of = materialise(_blocks(docs, folder), "words")

    n = words_of.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(parts, -(-n // SHARD_TOKENS))
    by_word = words_of.repartition(parts, "word").sortWithinPartitions("word")
    back = materialise(by_word.mapInArrow(_numbered, "block long, part long, data binary, v long"), "back")
    totals = back.groupBy("part").agg(F.max("v").alias("v")).agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.max("part"), F.lit(0))).first()
    v, width = totals[0], totals[1] + 1
    # Shards and blocks are about equal in size, so they are dealt one by one and not by hashes, which would give some
    # tasks several and others none.
    of_block = F.pmod(F.shiftright("block", 24) + 31 * F.col("block").bitwiseAND((1 << 24) - 1), F.lit(parts)).cast("int")
    back = back.select("block", "part", "data").repartitionById(parts, of_block).sortWithinPartitions("block", "part")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["block"]):
            for block, part in _groups(table, "block"):
                # Numbers from 1, nearly without gaps, as the words are dealt out about evenly.
                own = [(_unpack(data), p) for data, p in zip(part.column("data").to_pylist(), part.column("part").to_pylist(), strict=True)]
                at, c = (np.concatenate([x[i] for x, _ in own]) for i in (1, 2))
                _save(f"{folder}/known/{block}", at=at, id=np.concatenate([x[0] * width + p + 1 for x, p in own]), c=c)
                pairs = _Pairs(folder, block)
                # Contexts by their steps, how many pairs each has, their own counts; the pairs' words and counts.
                rows = [(s, block, _pack(np.diff(contexts, prepend=0), sizes, counts, pairs.pair_word[i], pairs.n[i])) for s, i, contexts, sizes, counts in pairs.dealt(n, shards)]
                # The block itself, so that one without any pair is not lost.
                rows.append((-1, block, b""))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "block", "data"])

    sent = back.mapInArrow(send, "shard long, block long, data binary").repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", "block")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["shard"]):
            for shard, part in _groups(table, "shard"):
                blocks, data = part.column("block").to_pylist(), part.column("data").to_pylist()
                if shard < 0:
                    for at in range(0, len(blocks), 10_000):
                        yield _answers([(b, -1, b"") for b in blocks[at : at + 10_000]])
                    continue
                asked = [_unpack(d) for d in data]
                uri = f"{folder}/model/{shard}.trie"
                _train(asked, min_count).save(uri)
                trie = Trie.load(uri)
                for block, (steps, sizes, counts, word, _) in zip(blocks, asked, strict=True):
                    contexts = np.cumsum(steps).astype(np.uint64)
                    code, mass, kept = trie.ask(contexts, sizes, word.astype(np.uint64))
                    # Near 1, as codes are; 1 where no pair is kept.
                    scale = np.divide(kept / (PARTS * np.maximum(counts, 1)), mass, out=np.ones(len(mass)), where=mass > 0)
                    yield _answers([(block, shard, _pack(code.astype(np.int64), kept, np.rint(scale * FINE).astype(np.int64)))])

    answers = sent.mapInArrow(answer, "block long, shard long, data binary").repartitionById(parts, of_block).sortWithinPartitions("block", "shard")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["block"]):
            for block, part in _groups(table, "block"):
                yield _scored(folder, block, dict(zip(part.column("shard").to_pylist(), part.column("data").to_pylist(), strict=True)), n, v, shards)

    out = answers.mapInArrow(add_up, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    return out.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, word, at, n) in order of the word to what each block is told: the words' numbers within this part,
    their places in the block, and their counts in all training documents. Words that no training document has get no
    number; a block that has no others is told so. v: the words numbered so far."""
    part, v = TaskContext.get().partitionId(), 0
    for table in runs(_together(batches, 400_000), ["word"]):
        words, block = table.column("word").combine_chunks(), table.column("block").to_numpy()
        at, n = table.column("at").to_numpy(), table.column("n").to_numpy()
        new = np.ones(len(words), bool)
        new[1:] = pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        c = np.add.reduceat(n, first)
        number = np.where(c > 0, v + np.cumsum(c > 0) - 1, UNKNOWN)
        v += int((c > 0).sum())
        which = np.cumsum(new) - 1
        number, c = number[which], c[which]
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1], [True]]))
        rows = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            k = order[i:j]
            k, name = k[number[k] >= 0], int(block[order[i]])
            rows.append((name, _pack(number[k], at[k], c[k])))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(np.full(len(rows), part, np.int64)), pa.array([r[1] for r in rows], pa.binary()), pa.array(np.full(len(rows), v, np.int64))], ["block", "part", "data", "v"])


def _together(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _groups(table: pa.Table, key: str) -> Iterator[tuple[int, pa.Table]]:
    at = 0
    for k, group in groupby(table.column(key).to_pylist()):
        size = sum(1 for _ in group)
        yield k, table.slice(at, size)
        at += size


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [_shrink(a) for a in arrays]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(_grow(data[at + 8 : at + 8 + size]))
        at += 8 + size
    return out


def _train(asked: list[list[np.ndarray]], min_count: int) -> Trie:
    """The trie of the pairs that occur often enough in all that the blocks sent."""
    context = np.concatenate([np.repeat(np.cumsum(steps), sizes) for steps, sizes, *_ in asked])
    context_count = np.concatenate([np.repeat(counts, sizes) for _, sizes, counts, *_ in asked])
    word, n = np.concatenate([a[3] for a in asked]), np.concatenate([a[4] for a in asked])
    taught = np.flatnonzero(n)
    order = taught[_order(context[taught], word[taught])]
    context, word, n, context_count = context[order], word[order], n[order], context_count[order]
    first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])])) if len(order) else np.zeros(0, np.int64)
    total = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
    kept, total = first[total >= min_count], total[total >= min_count]
    codes = quantise((total - DISCOUNT) / np.maximum(context_count[kept], 1))
    return Trie.of(context[kept].astype(np.uint64), word[kept].astype(np.uint64), codes, np.rint(PARTS * (total - DISCOUNT)).astype(np.int64))


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["block", "shard", "data"])


def _scored(folder: str, block: int, data: dict[int, bytes], n: int, v: int, shards: int) -> pa.RecordBatch:
    pairs = _Pairs(folder, block)
    d = np.zeros(len(pairs.context))
    all_contexts, at = np.unique(pairs.context, return_inverse=True)
    kept, count = np.zeros(len(all_contexts), np.int64), np.ones(len(all_contexts), np.int64)
    for s, i, contexts, sizes, counts in pairs.dealt(n, shards):
        codes, parts, scale = _unpack(data[s])
        d[i] = dequantise(codes) * np.repeat(scale, sizes) / FINE
        k = np.searchsorted(all_contexts, contexts)
        kept[k] += parts
        count[k] = np.maximum(counts, 1)
    left = (PARTS * count - kept) / (PARTS * count)
    gamma = left[at] if len(at) else np.zeros(0)
    plain = (pairs.count + 1) / (n + v + 1)
    p = plain.copy()
    p[pairs.valid] = d[pairs.which] + gamma[pairs.which] * plain[pairs.valid]
    # The contract's base: the denominator is N + 1 * (V + 1).
    base = np.log10((pairs.count + 1) / (n + 1 * (v + 1)))
    add = lambda x: np.add.reduceat(x, pairs.starts)
    ids = pairs.docs["ids"]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64(), mask=pairs.docs["null"].astype(bool)), pa.array(pairs.docs["sizes"]), pa.array(add((pairs.count > 0).astype(np.int64))), pa.array(np.full(len(ids), n, np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))],
        ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )
