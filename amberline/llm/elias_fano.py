"""Elias-Fano sequences and a two-level n-gram trie of them, in files that are memory-mapped where the store allows it."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from amberline.llm.common import filesystem, publish

#: Log10 probabilities are kept as multiples of 1 / STEPS; code 0 means "not there", code 1 is probability 1.
STEPS = 400


def quantise(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(p) * STEPS) + 1, 65535).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** (-(code.astype(np.float64) - 1) / STEPS), 0.0)


def _packed(bits: np.ndarray) -> np.ndarray:
    out = np.packbits(bits, bitorder="little")
    return np.concatenate([out, np.zeros(-len(out) % 8 + 8, np.uint8)])


class EliasFano:
    """A sorted sequence of n unsigned numbers in about 2 + log2(universe / n) bits each. The low bits stand packed; the
    high bits are a bit vector with a one for each number and a zero for each value of the high part that is passed."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high.view("<u8"), ones
        self.zeros: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, universe = len(values), int(values[-1]) + 1 if len(values) else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8) if low_bits else np.zeros((n, 0), np.uint8)
        top = (values >> np.uint64(low_bits)).astype(np.int64)
        high = np.zeros(n + (int(top[-1]) if n else 0) + 1, np.uint8)
        high[top + np.arange(n)] = 1
        high = _packed(high)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high.view("<u8")), dtype=np.int64)])
        return cls(n, low_bits, _packed(low.reshape(-1)), high, ones)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high.view(np.uint8), "ones": self.ones}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        # The eight bytes from any byte on; the sequence is padded by as many.
        eight = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))[bit >> 3]
        return eight >> (bit & 7).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """The positions of the k-th ones or zeros of the bit vector."""
        if zeros and self.zeros is None:
            self.zeros = 64 * np.arange(len(self.ones)) - self.ones
        counts = self.zeros if zeros else self.ones
        word = np.searchsorted(counts, k, side="right") - 1
        bits, left = self.high[word] ^ np.uint64(0xFFFFFFFFFFFFFFFF if zeros else 0), k - counts[word]
        out = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            beyond = left >= here
            out += np.where(beyond, width, 0)
            left -= np.where(beyond, here, 0)
            bits = np.where(beyond, bits >> np.uint64(width), bits)
        return 64 * word + out

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return (self._select(i, False) - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The index of each value, -1 where it is not there."""
        values = np.asarray(values, np.uint64)
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        top = (values >> np.uint64(self.low_bits)).astype(np.int64)
        last = 64 * len(self.high) - self.n
        at = np.flatnonzero(top < last)
        top, low = top[at], values[at] & np.uint64((1 << self.low_bits) - 1)
        end = np.minimum(self._select(top, True) - top, self.n)
        start = np.where(top > 0, np.minimum(self._select(np.maximum(top - 1, 0), True) - top + 1, self.n), 0)
        # Binary search among the numbers of equal high part.
        lo, hi = start, end.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        hit = lo < end
        hit[hit] = self._low(lo[hit]) == low[hit]
        out[at[hit]] = lo[hit]
        return out


class Trie:
    """Contexts (level 1), monotone pointers to their successors, and the successors (level 2), with a quantised
    probability each. A successor is stored relative to its context: plus the last number of the context before it, so
    that the whole level rises. A context can have a whole number of its own."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray, own: np.ndarray):
        self.contexts, self.pointers, self.successors, self.codes, self.own = contexts, pointers, successors, codes, own
        self.sums: np.ndarray | None = None

    @classmethod
    def of(cls, context: np.ndarray, word: np.ndarray, codes: np.ndarray, weight: np.ndarray | None = None) -> Trie:
        """context and word: sorted, distinct pairs. A context's own number is the sum of its pairs' weights, else 0."""
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        ends = np.concatenate([first[1:], [len(context)]]) if len(first) else first
        base = np.concatenate([[0], np.cumsum(word[ends - 1] + np.uint64(1))[:-1]]).astype(np.uint64) if len(first) else np.zeros(0, np.uint64)
        relative = word + np.repeat(base, ends - first)
        own = np.add.reduceat(weight, first) if weight is not None and len(first) else np.zeros(len(first), np.int64)
        own = own.astype("<u4" if not len(own) or int(own.max()) < 1 << 32 else "<u8")
        return cls(EliasFano.of(context[first]), EliasFano.of(np.concatenate([first, [len(context)]])), EliasFano.of(relative), codes, own)

    def ask(self, contexts: np.ndarray, sizes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The codes of words, in order of their contexts, of which each has so many (0 where a pair is not there), and for
        each context the sum of the probabilities of its successors here and its own number. A context is looked for
        once."""
        codes, mass, own = np.zeros(len(word), np.uint16), np.zeros(len(contexts)), np.zeros(len(contexts), np.int64)
        k = self.contexts.find(contexts)
        known = k >= 0
        if not known.any():
            return codes, mass, own
        k, sizes_known = k[known], sizes[known]
        start, end = self.pointers.access(k).astype(np.int64), self.pointers.access(k + 1).astype(np.int64)
        if self.sums is None:
            # Each for itself: differences of running sums would lose small ones.
            self.sums = np.add.reduceat(dequantise(np.asarray(self.codes)), self.pointers.access(np.arange(self.contexts.n)).astype(np.int64))
        mass[known], own[known] = self.sums[k], self.own[k]
        at = np.flatnonzero(np.repeat(known, sizes))
        base = np.where(start > 0, self.successors.access(np.maximum(start - 1, 0)) + np.uint64(1), np.uint64(0))
        i = self.successors.find(word[at] + np.repeat(base, sizes_known))
        good = (i >= np.repeat(start, sizes_known)) & (i < np.repeat(end, sizes_known))
        codes[at[good]] = self.codes[i[good]]
        return codes, mass, own

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of each pair; 0 where it is not there."""
        return self.ask(context, np.ones(len(context), np.int64), word)[0]

    def mass(self, context: np.ndarray) -> np.ndarray:
        """The sum of the probabilities of each context's successors here."""
        return self.ask(context, np.zeros(len(context), np.int64), np.zeros(0, np.uint64))[1]

    def save(self, uri: str) -> None:
        parts, head, at = [], {}, 0
        for name in ("contexts", "pointers", "successors"):
            level = getattr(self, name)
            head[name] = {"n": level.n, "low_bits": level.low_bits}
            parts += [(f"{name}.{k}", a) for k, a in level.arrays().items()]
        parts += [("codes", self.codes), ("own", self.own)]
        for name, a in parts:
            head[name] = {**head.get(name, {}), "at": at, "size": a.nbytes, "dtype": a.dtype.str}
            at += a.nbytes + -a.nbytes % 8
        text = json.dumps(head).encode()
        text += b" " * (-(len(text) + 8) % 8)

        def write(out) -> None:
            out.write(len(text).to_bytes(8, "little") + text)
            for _, a in parts:
                out.write(a.tobytes() + bytes(-a.nbytes % 8))

        publish(uri, write)

    @classmethod
    def load(cls, uri: str) -> Trie:
        """Mapped into memory from a local or mounted folder; from another store the file is read."""
        files, path = filesystem(uri)
        if files.type_name == "local":
            buffer = pa.memory_map(path).read_buffer()
        else:
            with files.open_input_file(path) as f:
                buffer = f.read_buffer()
        size = int.from_bytes(buffer[:8].to_pybytes(), "little")
        head = json.loads(buffer[8 : 8 + size].to_pybytes())

        def array(name: str) -> np.ndarray:
            h = head[name]
            return np.frombuffer(buffer, np.dtype(h["dtype"]), h["size"] // np.dtype(h["dtype"]).itemsize, 8 + size + h["at"])

        levels = [EliasFano(head[n]["n"], head[n]["low_bits"], array(f"{n}.low"), array(f"{n}.high"), array(f"{n}.ones")) for n in ("contexts", "pointers", "successors")]
        return cls(*levels, array("codes"), array("own"))
