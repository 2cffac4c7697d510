"""Scalar expressions with the engine's rules for nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(x: Column, y: Column) -> Column:
    """True division; by zero it is null."""
    return F.try_divide(x.cast("double"), y.cast("double"))


def case(branches: list[tuple[Column, object]], otherwise) -> Column:
    out = None
    for condition, value in branches:
        condition = F.coalesce(condition, F.lit(False))
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def to_integer(x: Column) -> Column:
    """Through a double, cut towards zero; what is no number raises."""
    return x.cast("double").cast("bigint")


CASTS = {
    "int": to_integer, "float": lambda x: x.cast("double"), "text": lambda x: x.cast("string"), "bool": lambda x: x.cast("boolean"),
}


def cast(x: Column, kind: str) -> Column:
    return CASTS[kind.lower()](x)


def trim(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def ltrim(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+", "")


def rtrim(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+$", "")


def length(x: Column) -> Column:
    """In code points; of null it is 0."""
    return F.coalesce(F.char_length(x), F.lit(0)).cast("bigint")


def substring(x: Column, start: int, size: int | None = None) -> Column:
    """From 1; a start below that counts as 1."""
    return F.substring(x, max(start, 1), size if size is not None else 1 << 30)


def concat(*parts: Column) -> Column:
    """Null parts count as empty."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def json_value(x: Column, path: str = "$") -> Column:
    """The value at $.a.b or $.a[0] as text; null if it is not there."""
    return F.get_json_object(x, path if path.startswith("$") else f"$.{path}")


def canonical_json(x: Column) -> Column:
    """JSON text with its keys in order and without spaces; null for what is no JSON."""
    return F.to_json(F.try_parse_json(x))


def canonical(x: Column, kind: str) -> Column:
    """The text that stands for a value where values of any type are compared. Whole doubles have no fraction."""
    text = F.when(x, "PRAWDA").otherwise("FAŁSZ") if kind == "boolean" else x.cast("string")
    if kind in ("double", "float"):
        text = F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(text)
    return F.when(x.isNull(), "NIC").otherwise(text)


def parsed(text: Column) -> Column:
    """A literal as a struct (vtype, v_text, v_num, v_bool, v_json): null and truth words, JSON in brackets, numbers, or
    text without its quotes."""
    t = F.trim(text)
    word = F.upper(t)
    true, false, null = word.isin("PRAWDA", "TRUE"), word.isin("FAŁSZ", "FALSE"), t.isNull() | word.isin("NIC", "NULL")
    json = t.rlike(r"^[\[{]") & F.try_parse_json(t).isNotNull()
    number = F.when(t.rlike(r"^[+-]?(\d+|\d*\.\d+|\d+\.)([eE][+-]?\d+)?$"), t.try_cast("double"))
    plain = F.regexp_replace(t, r"""^(["'])(.*)\1$""", "$2")
    kind = F.when(null, "null").when(true | false, "bool").when(json, "json").when(number.isNotNull(), "num").otherwise("text")
    shown = F.when(null, "NIC").when(true, "PRAWDA").when(false, "FAŁSZ").when(number.isNotNull() | json, t).otherwise(plain)
    return F.struct(kind.alias("vtype"), shown.alias("v_text"), F.when(kind == "num", number).alias("v_num"), F.when(kind == "bool", true).alias("v_bool"), F.when(kind == "json", t).alias("v_json"))


def sort_keys(value: Column, descending: bool = False) -> list[Column]:
    """Order of dynamic values: null, numbers, truth values, text; descending turns all of it."""
    rank = F.when(value["vtype"].isNull() | (value["vtype"] == "null"), 0).when(value["vtype"] == "num", 1).when(value["vtype"] == "bool", 2).otherwise(3)
    keys = [rank, value["v_num"], value["v_bool"], value["v_text"]]
    return [k.desc() if descending else k.asc() for k in keys]
