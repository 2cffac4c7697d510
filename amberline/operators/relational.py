"""Joins, aggregates, windows, set operations and sorting with the engine's rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amberline.functions.scalars import sort_keys

# --- joins ---------------------------------------------------------------------------------------------------------


def join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner", alias: str = "Prawa", not_itself: tuple[str, str] | None = None) -> DataFrame:
    """Equal keys. The columns of the right side come as `alias.column`. With one pair of keys null never matches; with
    several, null matches null. `not_itself` names the two sides' name columns where a row may not match itself."""
    r = right.select(*[F.col(c).alias(f"{alias}.{c}") for c in right.columns])
    same = Column.eqNullSafe if len(on) > 1 else Column.__eq__
    condition = reduce(Column.__and__, [same(left[a], r[f"`{alias}.{b}`"]) for a, b in on])
    if not_itself:
        condition &= left[not_itself[0]] != r[f"`{alias}.{not_itself[1]}`"]
    return left.join(r, condition, how)


def related(df: DataFrame, rels: DataFrame, relation: str, target: str, name: str = "name") -> DataFrame:
    """Rows that have the relation to the target."""
    keys = rels.where((F.col("relation") == relation) & (F.col("target") == target)).select(F.col("source").alias("_source"))
    return df.join(keys, df[name] == keys["_source"], "left_semi")


def with_scalar(df: DataFrame, query: DataFrame, alias: str) -> DataFrame:
    """df with the first cell of a query as a column; null if it has no row. A query of several rows gives that of its
    first one, so it should be ordered."""
    one = query.select(F.col(query.columns[0]).alias(alias)).limit(1)
    return df.join(F.broadcast(one), F.lit(True), "left")


def with_correlated(df: DataFrame, query: DataFrame, on: tuple[str, str], value: Column, alias: str) -> DataFrame:
    """df with an aggregate over the rows of a query whose key equals the row's own; null where there are none."""
    found = query.groupBy(F.col(on[1]).alias("_key")).agg(value.alias(alias))
    return df.join(found, df[on[0]] == found["_key"], "left").drop("_key")


# --- aggregates ----------------------------------------------------------------------------------------------------


def aggregate(function: str, x: Column, window=None) -> Column:
    """SUM and AVG of nothing are 0, MIN and MAX of nothing null; COUNT passes over nulls. Over a window, if one is given."""
    at = (lambda c: c.over(window)) if window is not None else (lambda c: c)
    return {
        "sum": lambda: F.coalesce(at(F.sum(x)), F.lit(0)), "avg": lambda: F.coalesce(at(F.avg(x)), F.lit(0.0)), "min": lambda: at(F.min(x)), "max": lambda: at(F.max(x)),
        "count": lambda: at(F.count(x)), "count_distinct": lambda: at(F.count_distinct(x)),
    }[function.lower()]()


def label(*columns: str) -> Column:
    """The label of a group: values joined by " | ", null as NIC."""
    return F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("NIC")) for c in columns])


def grouped(df: DataFrame, by: list[str], aggregates: dict[str, Column], having: Column | None = None) -> DataFrame:
    out = df.groupBy(*by).agg(*[c.alias(k) for k, c in aggregates.items()])
    return out.where(having) if having is not None else out


# --- windows -------------------------------------------------------------------------------------------------------

FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


def over(partition: list[str], order: list[Column] = (), rows: tuple[int, int] | None = None, values: tuple[int, int] | None = None):
    """A window. Ordered without a frame it runs over the rows up to the current one, peers not included."""
    w = Window.partitionBy(*partition)
    if not order:
        return w
    w = w.orderBy(*order)
    if values:
        return w.rangeBetween(*values)
    return w.rowsBetween(*(rows or (FIRST, 0)))


def over_frame(function: str, x: Column, partition: list[str], order: list[Column], start: int, end: int) -> Column:
    """SUM, AVG, MIN, MAX or COUNT over the rows from `start` to `end` off the current one. Bounds beyond the partition
    stand for its first or last row, so no frame is empty; bounds in turned order are swapped."""
    w = Window.partitionBy(*partition).orderBy(*order)
    place, n = F.row_number().over(w), F.count("*").over(Window.partitionBy(*partition))
    low, high = min(start, end), max(start, end)
    whole = w.rowsBetween(FIRST, LAST)
    outside = lambda value: aggregate_one(function, value)
    plain = aggregate(function, x, w.rowsBetween(low, high))
    return F.when(place + high < 1, outside(F.first(x).over(whole))).when(place + low > n, outside(F.last(x).over(whole))).otherwise(plain)


def aggregate_one(function: str, x: Column) -> Column:
    """The aggregate of a single value."""
    return {"sum": F.coalesce(x, F.lit(0)), "avg": F.coalesce(x, F.lit(0.0)), "min": x, "max": x, "count": F.when(x.isNull(), 0).otherwise(1)}[function.lower()]


def ntile(n: int, partition: list[str], order: list[Column]) -> Column:
    """Bucket floor((i - 1) * n / rows) + 1 of the i-th row."""
    rows = F.count("*").over(Window.partitionBy(*partition))
    return (F.floor((F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1) * n / rows) + 1).cast("bigint")


def ranked(kind: str, partition: list[str], order: list[Column]) -> Column:
    return {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[kind]().over(Window.partitionBy(*partition).orderBy(*order)).cast("bigint")


# --- set operations ------------------------------------------------------------------------------------------------


def _same_columns(a: DataFrame, b: DataFrame) -> None:
    if a.columns != b.columns:
        raise ValueError(f"the columns differ: {a.columns} and {b.columns}")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both."""
    _same_columns(a, b)
    return a.union(b).distinct()


def _matched(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    _same_columns(a, b)
    keys = b.distinct().select(*[F.col(c).alias(f"_{c}") for c in b.columns])
    return a.join(keys, reduce(Column.__and__, [a[c].eqNullSafe(keys[f"_{c}"]) for c in a.columns]), how)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b has; rows that repeat in a stay."""
    return _matched(a, b, "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b lacks; rows that repeat in a stay."""
    return _matched(a, b, "left_anti")


# --- sorting -------------------------------------------------------------------------------------------------------


def ordered(df: DataFrame, by: list[str], descending: bool = False, limit: int | None = None, offset: int = 0, name: str | None = None) -> DataFrame:
    """One direction for all keys, nulls first ascending and last descending. Dynamic values (structs with a vtype) go
    null, numbers, truth values, text. Keys that no column has count for nothing. `name` is the column that settles ties;
    without a key rows are in its order."""
    kinds, keys = {f.name: f.dataType for f in df.schema.fields}, []
    for c in by:
        if c not in kinds:
            continue
        if "vtype" in getattr(kinds[c], "names", ()):
            keys += sort_keys(F.col(c), descending)
        else:
            keys.append(F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first())
    keys += [F.col(name).asc()] if name else []
    out = df.orderBy(*keys) if keys else df
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out
