"""Holographic vectors: binding by circular convolution, in Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 2048
#: Rows whose vectors are held at once.
CHUNK = 256


def name_vector(name: str, dimension: int = DIMENSION) -> np.ndarray:
    """A unit vector that depends on the name alone."""
    seed = int.from_bytes(hashlib.sha256(name.encode("utf-8")).digest()[:8], "big")
    v = np.random.default_rng(seed).standard_normal(dimension)
    return v / np.linalg.norm(v)


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in s]) if len(s) else np.zeros((0, 1))


def vector_of(name: Column, dimension: int = DIMENSION) -> Column:
    @F.pandas_udf("array<double>")
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: name_vector("" if x is None else x, dimension).tolist())

    return of(name)


def bind(a: Column, b: Column) -> Column:
    """Circular convolution."""

    @F.pandas_udf("array<double>")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        p, q = _matrix(x), _matrix(y)
        return pd.Series(list(np.fft.irfft(np.fft.rfft(p, axis=1) * np.fft.rfft(q, axis=1), n=p.shape[1], axis=1)))

    return of(a, b)


def unbind(c: Column, a: Column) -> Column:
    """Circular correlation: about what was bound to a in c."""

    @F.pandas_udf("array<double>")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        p, q = _matrix(x), _matrix(y)
        return pd.Series(list(np.fft.irfft(np.fft.rfft(p, axis=1) * np.conj(np.fft.rfft(q, axis=1)), n=p.shape[1], axis=1)))

    return of(c, a)


def recovery(name: Column, role: Column, dimension: int = DIMENSION) -> Column:
    """How similar (cosine) a name's vector is to what unbinding gives back of its binding with the role's vector.

    The vectors stay in the worker, CHUNK rows at a time; equal pairs of a batch are worked out once.
    """

    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = pd.DataFrame({"a": a.fillna("").to_numpy(object), "b": b.fillna("").to_numpy(object)})
        which, distinct = pairs.groupby(["a", "b"], sort=False).ngroup().to_numpy(), pairs.drop_duplicates()
        out = np.empty(len(distinct))
        for i in range(0, len(distinct), CHUNK):
            few = distinct.iloc[i : i + CHUNK]
            of_role = {r: name_vector(r, dimension) for r in set(few["b"])}
            p, q = np.stack([name_vector(x, dimension) for x in few["a"]]), np.stack([of_role[r] for r in few["b"]])
            fq = np.fft.rfft(q, axis=1)
            bound = np.fft.irfft(np.fft.rfft(p, axis=1) * fq, n=dimension, axis=1)
            back = np.fft.irfft(np.fft.rfft(bound, axis=1) * np.conj(fq), n=dimension, axis=1)
            out[i : i + CHUNK] = (p * back).sum(axis=1) / (np.linalg.norm(p, axis=1) * np.linalg.norm(back, axis=1))
        return pd.Series(out[which])

    return of(name, role)


def bundle(*vectors: Column) -> Column:
    out = vectors[0]
    for v in vectors[1:]:
        out = F.zip_with(out, v, lambda x, y: x + y)
    return out


def encode_sequence(items: list[Column], dimension: int = DIMENSION) -> Column:
    """One vector for a sequence: the sum of its items, each bound to the vector of its position."""
    return bundle(*[bind(vector_of(x, dimension), vector_of(F.lit(f"position {i}"), dimension)) for i, x in enumerate(items)])


def decode_position(sequence: Column, position: int, candidates: list[str], dimension: int = DIMENSION) -> Column:
    """The candidate that is most similar to what stands at the position; ties go to the one that is listed first."""
    known = np.stack([name_vector(c, dimension) for c in candidates])

    @F.pandas_udf("string")
    def closest(x: pd.Series) -> pd.Series:
        return pd.Series([candidates[i] for i in (_matrix(x) @ known.T).argmax(axis=1)], dtype=object)

    return closest(unbind(sequence, vector_of(F.lit(f"position {position}"), dimension)))
