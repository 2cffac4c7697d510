"""Token files: documents as ids, each compressed on its own with one shared zstandard dictionary.

The dictionary is trained on serialised id arrays of a bounded sample. A file is

    magic "AMTK1\\0", id width (1 byte), sha256 of the dictionary (32 bytes; zeros: none)
    one zstandard frame for each document: its ids, little-endian, of that width, the end id last
    index: for each document its id (int64), the offset and length of its frame, the ids before it in the file and its
           own number of ids (uint64 each), and one byte that is 1 if the document's id is null
    offset of the index, number of documents (uint64 each)

Documents stand in ascending order of doc_id (null first, equal ids by text) within a file and from file to file. The
index is at a known place, so a reader gets one short document with three range reads and decompresses nothing else.
`manifest.parquet` in the folder lists the files in order, with the number of ids before each.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amberline.llm.common import filesystem, id_and_text, publish, shared_dir

MAGIC = b"AMTK1\0"
HEAD, TAIL = "<6sB32s", "<QQ"
HEAD_BYTES, TAIL_BYTES = struct.calcsize(HEAD), struct.calcsize(TAIL)
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("before", "<u8"), ("ids", "<u8"), ("null", "u1")])
#: The sample that the dictionary is trained on: documents, blocks of each (evenly spread over it) and bytes of a block.
SAMPLE_DOCS, SAMPLE_BLOCKS, BLOCK_BYTES, DICTIONARY_BYTES = 512, 4, 4096, 110_000
#: A file is closed when its frames reach this size.
FILE_BYTES, LEVEL = 32 << 20, 3
#: So much of a text helps to deal out documents of equal ids.
HEAD_CHARS = 32
MEMO_WORDS, MEMO_BYTES = 450_000, 64
_LETTERS, _PRINTABLE = re.compile(r"[a-z]+"), re.compile(r"[!-~]+")
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"


class WordTokenizer:
    """Encodes whole texts with a tokenizer that never joins anything across ASCII white space (it drops white space
    before it looks at words), by encoding each distinct word once.

    A word goes through the tokenizer's own steps: normaliser, pre-tokenizer, model. Texts that hold one of its added
    tokens, which are matched before all that, go through the tokenizer as they are; so do all texts if it has a step
    besides these or added tokens of another kind.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        further = [self.tokenizer.post_processor, self.tokenizer.truncation, self.tokenizer.padding]
        self.by_word = all(x is None for x in further) and not any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added)
        self.normalize = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.tokenizer.pre_tokenizer else lambda x: [(w, (x.index(w), 0)) for w in x.split(" ")]
        self.model = self.tokenizer.model.tokenize
        # Where the normaliser does nothing to lower-case ASCII words, those skip it; where it lower-cases ASCII, so may we.
        probe = "".join(map(chr, [*range(14, 32), *range(33, 65), *range(91, 128)]))
        same = self.normalize(probe) == probe
        self.lowers = same and self.normalize("ABCXYZ") == "abcxyz"
        # Where the pre-tokenizer leaves a word of lower-case ASCII letters whole, such words skip that too.
        self.whole = same and all([p for p, _ in self.split(w)] == [w] for w in [_ALPHABET, _ALPHABET[::-1], *_ALPHABET])
        self.ascii_pieces = self._ascii_split() if same else None
        self.code = self.dtype.char
        # What words give, in two generations; the older is dropped when the younger has MEMO_WORDS.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ascii_split(self):
        """What finds the pieces of printable ASCII words, if the pre-tokenizer is a pattern whose matches are the pieces
        and a map of bytes, which leaves such characters as they are; None if it is anything else."""
        steps = (json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}).get("pretokenizers", [])
        if [x["type"] for x in steps] != ["Split", "ByteLevel"]:
            return None
        split, mapped = steps
        if split["behavior"] != "Removed" or not split["invert"] or mapped["add_prefix_space"] or mapped["use_regex"]:
            return None
        return regex.compile(split["pattern"]["Regex"]).findall

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The serialised ids of each text; null counts as empty."""
        texts = pc.fill_null(texts, "")
        special = np.full(len(texts), not self.by_word)
        for token in self.added:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(~special), texts, "") if special.any() else texts
        if self.lowers:
            plain = pc.if_else(pc.string_is_ascii(plain), pc.ascii_lower(plain), plain)
        split = pc.ascii_split_whitespace(plain)
        words = split.flatten().dictionary_encode()
        values = self._ids(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(values), self.dtype)))
        stream = memoryview(np.ascontiguousarray(lists.take(words.indices).flatten().to_numpy()).tobytes())
        index = words.indices.to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes[index])]) * self.dtype.itemsize
        ends = starts[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        out = [bytes(stream[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        for i in np.flatnonzero(special):
            out[i] = self._serialised(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids)
        return out

    def _serialised(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of what the pre-tokenizer gives. A word of letters alone may be known as such."""
        if not self.whole or not _LETTERS.fullmatch(piece):
            return self._serialised([t.id for t in self.model(piece)])
        ids = self.known.get(piece) or self.older.get(piece)
        if ids is None:
            self.known[piece] = ids = self._serialised([t.id for t in self.model(piece)])
        return ids

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        known, older, new, rest = self.known, self.older, [], []
        for w in words:
            if w not in known:
                ids = older.get(w)
                if ids is not None:
                    known[w] = ids
                else:
                    new.append(w)
                    low = w.lower() if self.lowers and w.isascii() else w
                    if self.whole and _LETTERS.fullmatch(low):
                        known[w] = self._piece(low)
                    elif self.ascii_pieces and _PRINTABLE.fullmatch(low):
                        known[w] = b"".join(map(self._piece, self.ascii_pieces(low)))
                    else:
                        rest.append(w)
        for at in range(0, len(rest), 200):
            part = rest[at : at + 200]
            # Several at once, as a call costs as much as a word; words with white space of other kinds one by one.
            alone = [w for w in part if w.split() != [w]]
            together = [w for w in part if w.split() == [w]]
            for group in [together, *([w] for w in alone)]:
                for w, ids in zip(group, self._several(group), strict=True):
                    known[w] = ids
        out = [known[w] for w in words]
        for w in new:
            if len(w) > MEMO_BYTES:
                del known[w]
        if len(known) > MEMO_WORDS:
            self.older, self.known = known, {}
        return out

    def _several(self, words: list[str]) -> list[bytes]:
        """The ids of words through all steps at once; a space parts them."""
        text = self.normalize(" ".join(words))
        ends = np.cumsum([len(w) + 1 for w in text.split(" ")]) if len(words) > 1 else np.array([len(text) + 1])
        pieces = self.split(text)
        at = np.searchsorted(ends, [start for _, (start, _) in pieces], side="right").tolist()
        ids: list[list[bytes]] = [[] for _ in words]
        for i, (piece, _) in zip(at, pieces, strict=True):
            ids[i].append(self._piece(piece))
        return [b"".join(x) for x in ids]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def train_dictionary(docs: DataFrame, vocabulary: str) -> bytes:
    """A zstandard dictionary from the documents whose hashed ids are smallest: SAMPLE_DOCS documents at most, of each
    SAMPLE_BLOCKS blocks of BLOCK_BYTES at most, spread over the whole document. So at most 8 MB reach the driver."""
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    sample = docs.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").limit(SAMPLE_DOCS).repartition(8)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for batch in batches:
            out = []
            for at in range(batch.num_rows):
                (ids,) = own.encode(batch.column("text").slice(at, 1))
                starts = range(0, len(ids), BLOCK_BYTES)
                step = max(1, -(-len(starts) // SAMPLE_BLOCKS))
                out += [ids[s : s + BLOCK_BYTES] for s in starts[::step]]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["block"])

    samples = sorted(bytes(r.block) for r in sample.mapInArrow(blocks, "block binary").collect())
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, threads=0, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their bytes serve as they are
        return b"".join(samples)[-DICTIONARY_BYTES:]


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write token files, dictionary and manifest to `folder`.

    A null text counts as empty: the document has only the end id. Rows with equal ids are all written, ordered by
    text; null ids come first. An empty table gives a manifest without files.
    """
    spark = docs.sparkSession
    docs = id_and_text(docs, id_col, text_col)
    dictionary = train_dictionary(docs, vocabulary)
    digest = hashlib.sha256(dictionary).digest() if dictionary else bytes(32)
    if dictionary:
        publish(f"{folder}/{digest.hex()}.dictionary", lambda out: out.write(dictionary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = tokenizer(vocabulary), TaskContext.get().partitionId()
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level=LEVEL)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared).compress
        end = np.array([end_id], own.dtype).tobytes()
        frames, index, offset, before, seq = [], [], HEAD_BYTES, 0, 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:05d}.tokens"

            def put(out) -> None:
                out.write(struct.pack(HEAD, MAGIC, own.dtype.itemsize, digest))
                for frame in frames:
                    out.write(frame)
                out.write(np.array(index, INDEX).tobytes())
                out.write(struct.pack(TAIL, offset, len(index)))

            publish(f"{folder}/{name}", put)
            return pa.RecordBatch.from_pydict({"file": [name], "part": [part], "seq": [seq], "docs": [len(index)], "tokens": [before]}, schema=pa.schema([("file", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())]))

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), own.encode(piece.column("text")), strict=True):
                    ids += end
                    frame = compress(ids)
                    n = len(ids) // own.dtype.itemsize
                    index.append((doc_id or 0, offset, len(frame), before, n, doc_id is None))
                    frames.append(frame)
                    offset += len(frame)
                    before += n
                    if offset >= FILE_BYTES:
                        yield close()
                        frames, index, offset, before, seq = [], [], HEAD_BYTES, 0, seq + 1
        if index:
            yield close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The head of the text parts the rows of an id that many documents bear.
    ordered = docs.repartitionByRange(parts, F.col("doc_id"), F.substring("text", 1, HEAD_CHARS)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, "file string, part long, seq long, docs long, tokens long").write.parquet(f"{folder}/written.parquet")
    # One row for each file, so one task can add them up.
    in_order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    spark.read.parquet(f"{folder}/written.parquet").select("file", "docs", "tokens", F.coalesce(F.sum("tokens").over(in_order), F.lit(0)).alias("start")).write.parquet(f"{folder}/manifest.parquet")


class TokenFile:
    """One token file, read by ranges."""

    def __init__(self, uri: str):
        files, path = filesystem(uri)
        self.file = files.open_input_file(path)
        magic, width, digest = struct.unpack(HEAD, self.file.read_at(HEAD_BYTES, 0))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.dtype = np.dtype(f"<u{width}")
        size = self.file.size()
        self.index_at, n = struct.unpack(TAIL, self.file.read_at(TAIL_BYTES, size - TAIL_BYTES))
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, self.index_at), INDEX)
        dictionary = b""
        if digest != bytes(32):
            with files.open_input_stream(f"{os.path.dirname(path)}/{digest.hex()}.dictionary") as f:
                dictionary = f.read()
            if hashlib.sha256(dictionary).digest() != digest:
                raise ValueError(f"the dictionary of {uri} has changed")
        self.decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress

    def ids(self, row: np.void, frame: bytes | memoryview | None = None) -> np.ndarray:
        return np.frombuffer(self.decompress(frame if frame is not None else self.file.read_at(int(row["length"]), int(row["offset"]))), self.dtype)

    def document(self, doc_id: int) -> np.ndarray | None:
        """The ids of one document, by binary search in the index; None if it is not in this file."""
        first = int(self.index["null"].sum())  # null ids stand first
        at = first + int(np.searchsorted(self.index["doc_id"][first:], doc_id))
        return self.ids(self.index[at]) if at < len(self.index) and self.index["doc_id"][at] == doc_id else None

    def documents(self, block: int = 8 << 20) -> Iterator[tuple[np.void, np.ndarray]]:
        """All documents in order, reading about `block` bytes at a time."""
        at = 0
        while at < len(self.index):
            start, end = int(self.index["offset"][at]), at
            while end < len(self.index) and (end == at or int(self.index["offset"][end]) + int(self.index["length"][end]) - start <= block):
                end += 1
            data = memoryview(self.file.read_at(int(self.index["offset"][end - 1]) + int(self.index["length"][end - 1]) - start, start))
            for row in self.index[at:end]:
                o = int(row["offset"]) - start
                yield row, self.ids(row, data[o : o + int(row["length"])])
            at = end


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """What the files hold: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for,
    token_ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows: list[tuple] = []
                weight = 0
                for row, ids in TokenFile(f"{folder}/{name}").documents():
                    wide = ids.astype("<u4")
                    rows.append((None if row["null"] else int(row["doc_id"]), start + int(row["before"]), len(ids), zlib.crc32(wide.tobytes()), wide.view("<i4") if with_ids else None))
                    weight += len(ids) if with_ids else 40
                    if weight > 4_000_000:
                        yield _rows(rows)
                        rows, weight = [], 0
                if rows:
                    yield _rows(rows)

    manifest = spark.read.parquet(f"{folder}/manifest.parquet").select("file", "start")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(parts, "file").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * with_ids)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    ids, starts, counts, crcs, arrays = zip(*rows, strict=True)
    columns = [pa.array(c, pa.int64()) for c in (ids, starts, counts, crcs)]
    if arrays[0] is None:
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])
    ends = np.cumsum([0, *map(len, arrays)])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), pa.int32()))
    return pa.RecordBatch.from_arrays([*columns, lists], ["doc_id", "start", "n_tokens", "ids_crc32", "token_ids"])


def write_and_read(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """`write` to a new shared folder, then `read`."""
    folder = shared_dir(docs.sparkSession, "tokens")
    write(docs, folder, vocabulary, end_id, id_col, text_col)
    return read(docs.sparkSession, folder, with_ids)
