"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can come last in the BPE encoding of that prefix. `Prefixes` stores
these last tokens. Reading them backwards gives the encoding of the whole string and of every prefix. Appending bytes
only adds entries, so appends are exact. After an edit, entries before it stay valid and entries behind it are only
computed until they agree again with the old ones over the length of the longest token.

A token t may follow token s when merging the bytes of s and t by rank gives back s, t. The encoding of a string is the
only split of it into tokens in which all neighbours may follow each other. To tell whether t may follow s without
merging, only the pieces of s that touch its end and the pieces of t that touch its start matter: each exists from the
merge that makes it to the merge that takes it up, and no two that exist at once may merge before that.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from amberline.llm.common import Memo, id_and_text

#: Distinct pieces that a worker remembers, the longest that it does, and the prefixes that pieces share.
MEMO_PIECES, MEMO_BYTES, SHARED_PREFIXES = 120_000, 48, 200_000

#: Pairs of tokens of which it remembers whether one may follow the other.
FOLLOWING_PAIRS = 250_000


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.size_of = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._follows: dict[int, bool] = {}
        # Tokens by their bytes from the last to the first, to walk backwards from a position. A node is a dictionary
        # of nodes; under -1 it has the token that ends there. Tokens that merges never reach stay out.
        self._backwards: dict = {}
        for token, rank in ranks.items():
            if self.merged(token) == [rank]:
                node = self._backwards
                for b in reversed(token):
                    node = node.setdefault(b, {})
                node[-1] = rank
        self._at_end: dict[int, list] = {}
        self._at_start: dict[int, list] = {}

    def merged(self, piece: bytes, until: int = 1) -> list[int]:
        """The encoding by its definition: merge the neighbours of lowest rank, leftmost first, until none merge or
        so many parts are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > until:
            rank, i = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        return self._learn(left << 32 | right)

    def _edge(self, token: int, side: int, kept: dict[int, list]) -> list[tuple[bytes, int, int]]:
        """The parts of a token that touch its end (side 1) or start (side 0), smallest first: bytes, and the ranks of
        the merges that make the part and that take it up."""
        out = kept.get(token)
        if out is None:
            taken, out, at = 1 << 60, [], token
            while len(self.bytes_of[at]) > 1:
                out.append((self.bytes_of[at], at, taken))
                taken, at = at, self.merged(self.bytes_of[at], 2)[side]
            out = kept[token] = [*out, (self.bytes_of[at], -1, taken)][::-1]
        return out

    def _learn(self, pair: int) -> bool:
        if len(self._follows) > FOLLOWING_PAIRS:
            self._follows.clear()
        ends, starts = self._edge(pair >> 32, 1, self._at_end), self._edge(pair & 0xFFFFFFFF, 0, self._at_start)
        i = j = 0
        good = True
        while i < len(ends) and j < len(starts):
            (x, _, x_taken), (y, _, y_taken) = ends[i], starts[j]
            rank = self.ranks.get(x + y, 1 << 60)
            # Of equal ranks the leftmost merges first: the one that takes up x, or else this one before y's.
            if rank < 1 << 60 and rank < x_taken and rank <= y_taken:
                good = False
                break
            # The part that is taken up first makes way for the one that it becomes.
            if x_taken <= y_taken:
                i += 1
            else:
                j += 1
        self._follows[pair] = good
        return good

    def last_token(self, text: bytes | bytearray, end: int, last: list[int]) -> int:
        """The one token that can come last in text[:end], given the last tokens of all shorter prefixes."""
        node, i, known = self._backwards, end, self._follows
        while i > 0:
            i -= 1
            node = node.get(text[i])
            if node is None:
                break
            if -1 in node:
                token = node[-1]
                if i == 0:
                    return token
                follows = known.get(last[i] << 32 | token)
                if follows if follows is not None else self._learn(last[i] << 32 | token):
                    return token
        raise ValueError("the vocabulary lacks a byte")


class Prefixes:
    """The last tokens of all prefixes of one piece. last[i] belongs to the prefix of i bytes; last[0] is unused."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary, self.text, self.last = vocabulary, bytearray(), [-1]
        self.append(text)

    def append(self, more: bytes) -> None:
        self.text += more
        for end in range(len(self.last), len(self.text) + 1):
            self.last.append(self.vocabulary.last_token(self.text, end, self.last))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace text[start:end] by `new`; returns how many prefixes were computed anew."""
        tail, keep = self.last[end + 1 :], self.vocabulary.longest
        self.text[start:end] = new
        del self.last[start + 1 :]
        same, done = 0, 0
        for at in range(start + 1, len(self.text) + 1):
            behind = at - (start + len(new))
            self.last.append(self.vocabulary.last_token(self.text, at, self.last))
            done += 1
            # A last token depends on the bytes of one token and on one earlier last token within its reach.
            same = same + 1 if behind > 0 and tail[behind - 1] == self.last[at] else 0
            if same >= keep and behind >= keep:
                self.last += tail[behind:]
                break
        return done

    def tokens(self, end: int | None = None) -> list[int]:
        at, out = len(self.text) if end is None else end, []
        while at > 0:
            out.append(self.last[at])
            at -= len(self.vocabulary.bytes_of[self.last[at]])
        return out[::-1]

    def count(self) -> int:
        return len(self.tokens())


class SharedPrefixes:
    """The last tokens of the prefixes of many short pieces, as a tree: what two pieces begin with is computed once."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._clear()

    def _clear(self) -> None:
        self._next: dict[int, int] = {}
        self._last = [-1]

    def tokens(self, text: bytes) -> list[int]:
        if len(self._last) > SHARED_PREFIXES:
            self._clear()
        node, last, lasts, following = 0, [-1], self._last, self._next
        for end, b in enumerate(text, 1):
            step = node << 8 | b
            node = following.get(step, 0)
            if not node:
                node = following[step] = len(lasts)
                lasts.append(self.vocabulary.last_token(text, end, last))
            last.append(lasts[node])
        at, out, size = len(text), [], self.vocabulary.size_of
        while at > 0:
            token = last[at]
            out.append(token)
            at -= size[token]
        return out[::-1]


class Encoder:
    """Encodes texts: each match of `pattern` is a piece of its own. A piece that is a token as a whole is that token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary, self.pattern = Vocabulary(ranks), regex.compile(pattern)
        self.memo, self.shared = Memo(MEMO_PIECES), SharedPrefixes(self.vocabulary)

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8")
        whole = self.vocabulary.ranks.get(data)
        if whole is not None:
            out = (whole,)
        elif len(data) <= MEMO_BYTES:
            out = tuple(self.shared.tokens(data))
        else:
            return tuple(Prefixes(self.vocabulary, data).tokens())
        self.memo.put(text, out)
        return out

    def encode(self, text: str) -> list[int]:
        young, piece = self.memo.young, self.piece
        out = []
        for part in self.pattern.findall(text):
            known = young.get(part)
            if known is None:
                known = self.memo.old.get(part)
                if known is None:
                    known = piece(part)
                else:
                    self.memo.put(part, known)
                young = self.memo.young
            out.append(known)
        return list(chain.from_iterable(out))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


class GrowingText:
    """A text that grows at its end and stays encoded. The last three pieces are split anew on each append, as the
    pattern looks at most that far ahead; the prefixes of the first of them that is unchanged or grown are kept."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.pieces = encoder, []

    def append(self, text: str) -> None:
        tail, self.pieces = self.pieces[-3:], self.pieces[:-3]
        for at, part in enumerate(self.encoder.pattern.findall("".join(p for p, _ in tail) + text)):
            old = tail[at] if at < len(tail) else None
            if old and part.startswith(old[0]) and part != old[0]:
                old[1].append(part[len(old[0]) :].encode("utf-8"))
                self.pieces.append((part, old[1]))
            else:
                self.pieces.append(old if old and old[0] == part else (part, Prefixes(self.encoder.vocabulary, part.encode("utf-8"))))

    def tokens(self) -> list[int]:
        whole = self.encoder.vocabulary.ranks
        return [t for text, prefixes in self.pieces for t in ([whole[text.encode()]] if text.encode() in whole else prefixes.tokens())]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if (path, pattern) not in _encoders:
        with open(path, "rb") as f:
            _encoders[path, pattern] = Encoder(load_ranks(f.read()), pattern)
    return _encoders[path, pattern]


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and token_ids of every row; nothing is shuffled.

    A null text counts as empty and has no ids. Rows that repeat, tie or have a null id are encoded like any other.
    `vocabulary` is a rank file that every machine holds.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, pattern)
        for batch in batches:
            ids = [own.encode(t) if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "token_ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(encode, "doc_id long, token_ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of rows (doc_id, token_ids); null ids decode to no bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, pattern)
        for batch in batches:
            out = [own.decode(ids or []) for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "token_ids").mapInArrow(decode, "doc_id long, decoded binary")


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the bytes that decoding
    those ids gives) of every row; nothing is shuffled. Cases as for `encode_texts`."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, pattern)
        decimal = {rank: str(rank) for rank in own.vocabulary.bytes_of}
        sha = hashlib.sha256
        for batch in batches:
            counts, shas, back = [], [], []
            for text in batch.column("text"):
                ids = own.encode(text.as_py() or "")
                counts.append(len(ids))
                shas.append(sha(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                back.append(sha(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
