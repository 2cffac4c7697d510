"""Two-valued predicates: every leaf is true or false, never null, so that NOT means the complement."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.functions.scalars import canonical


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def eq(x: Column, y) -> Column:
    """Equal; null equals null."""
    return x.eqNullSafe(y)


def ne(x: Column, y) -> Column:
    """The complement of eq: a null differs from any value."""
    return ~x.eqNullSafe(y)


def same_text(x: Column, y: Column, kinds: tuple[str, str] = ("string", "string")) -> Column:
    """Equal as canonical text, whatever the types: the text "8" equals the number 8, null equals null."""
    return canonical(x, kinds[0]).eqNullSafe(canonical(y, kinds[1]))


def lt(x: Column, y) -> Column:
    return _false(x < y)


def le(x: Column, y) -> Column:
    return _false(x <= y)


def gt(x: Column, y) -> Column:
    return _false(x > y)


def ge(x: Column, y) -> Column:
    return _false(x >= y)


def between(x: Column, low, high) -> Column:
    """Inclusive; false for null."""
    return _false(x.between(low, high))


def contains(x: Column, part: str) -> Column:
    """Substring without regard to case; false for null."""
    return _false(F.contains(F.lower(x.cast("string")), F.lower(F.lit(part))))


def like(x: Column, pattern: str) -> Column:
    """LIKE without regard to case; false for null."""
    return _false(x.cast("string").ilike(pattern))


def not_like(x: Column, pattern: str) -> Column:
    """True for null."""
    return ~like(x, pattern)


def regexp(x: Column, pattern: str) -> Column:
    """A search with regard to case; false for null, and for a pattern that is none."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return _false(x.cast("string").rlike(pattern))


def not_regexp(x: Column, pattern: str) -> Column:
    return ~regexp(x, pattern)


def is_null(x: Column) -> Column:
    return x.isNull()


def is_not_null(x: Column) -> Column:
    return x.isNotNull()


def isin(x: Column, values: list) -> Column:
    """In a list of literals; a null in the list matches null."""
    known = [v for v in values if v is not None]
    found = _false(x.isin(known)) if known else F.lit(False)
    return found | x.isNull() if len(known) < len(values) else found


def negate(p: Column) -> Column:
    return ~_false(p)


def in_query(df: DataFrame, column: str, query: DataFrame) -> DataFrame:
    """Rows whose value is in the first column of `query`; null is found among nulls."""
    keys = query.select(F.col(query.columns[0]).alias("_key")).distinct()
    return df.join(keys, df[column].eqNullSafe(keys["_key"]), "left_semi")


def not_in_query(df: DataFrame, column: str, query: DataFrame) -> DataFrame:
    """The complement of in_query."""
    keys = query.select(F.col(query.columns[0]).alias("_key")).distinct()
    return df.join(keys, df[column].eqNullSafe(keys["_key"]), "left_anti")


def exists(df: DataFrame, query: DataFrame, on: tuple[str, str] | None = None) -> DataFrame:
    """Correlated by (column of df, column of query): rows with a match. Uncorrelated: all rows if query has any."""
    if on:
        keys = query.select(F.col(on[1]).alias("_key")).distinct()
        return df.join(keys, df[on[0]] == keys["_key"], "left_semi")
    return df.join(F.broadcast(query.limit(1).select(F.lit(1).alias("_one"))), F.lit(True), "left_semi")


def not_exists(df: DataFrame, query: DataFrame, on: tuple[str, str] | None = None) -> DataFrame:
    if on:
        keys = query.select(F.col(on[1]).alias("_key")).distinct()
        return df.join(keys, df[on[0]] == keys["_key"], "left_anti")
    return df.join(F.broadcast(query.limit(1).select(F.lit(1).alias("_one"))), F.lit(True), "left_anti")


def quantified(df: DataFrame, column: str, op: str, kind: str, query: DataFrame) -> DataFrame:
    """Rows with `column op ALL|ANY (query)`. Nulls of the query count for nothing; ALL of none is true, ANY false; a
    null value is true for != alone. One row of minimum, maximum and count stands for the whole query."""
    x, y = df[column], F.col(query.columns[0])
    every = kind.upper() == "ALL"
    if op == "=" and not every:
        return in_query(df.where(x.isNotNull()), column, query.where(y.isNotNull()))
    if op == "!=" and every:
        return not_in_query(df, column, query.where(y.isNotNull()))
    bounds = query.agg(F.min(y).alias("_low"), F.max(y).alias("_high"), F.count(y).alias("_n"))
    low, high, n = F.col("_low"), F.col("_high"), F.col("_n")
    test = {
        (">", True): x > high, (">", False): x > low, (">=", True): x >= high, (">=", False): x >= low,
        ("<", True): x < low, ("<", False): x < high, ("<=", True): x <= low, ("<=", False): x <= high,
        ("=", True): (low == high) & (x == low), ("!=", False): x.isNull() | (x != low) | (x != high),
    }[op, every]
    keep = ((n == 0) | _false(test)) if every else ((n > 0) & _false(test))
    return df.join(F.broadcast(bounds), F.lit(True)).where(keep).select(*[df[c] for c in df.columns])
