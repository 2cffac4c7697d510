"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Of every WINDOW neighbouring k-grams of a text the one with the smallest hash is a fingerprint. Two texts that share a
span of K + WINDOW - 1 = 13 words choose the same k-gram in it, so every shared window of 13 words shows as a shared
fingerprint. Hits are then extended: of the document's windows around a fingerprint that the benchmark shares, those
whose words equal a benchmark window's, word for word, count.

Items of fewer than 13 words are one window of their own length; for each such length all grams of that length are
fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.llm.common import materialise

SPAN, K = 13, 6
WINDOW = SPAN - K + 1
#: A fingerprint is a long: the hash above, the position below, modulo this many bits.
POSITION_BITS = 20
_DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often `use` mentions it, inside lambdas too."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The words of a text: A-Z in lower case, runs of digits, letters and all that is not ASCII. Null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _DELIMITERS), "")


def _each(n: Column, of: Callable[[Column], Column], kind: str) -> Column:
    """of(0), ..., of(n - 1); none if n is not positive."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), of)).otherwise(F.array().cast(f"array<{kind}>"))


def _grams(hashes: Column, k: int) -> Column:
    """A long for each k-gram: its hash and, in the low bits, its position."""
    place = (1 << POSITION_BITS) - 1

    def one(i: Column) -> Column:
        h = F.xxhash64(*[F.get(hashes, i + j) for j in range(k)], F.lit(k))
        return h.bitwiseAND(F.lit(~place)).bitwiseOR(i.bitwiseAND(F.lit(place)).cast("long"))

    return _each(F.size(hashes) - (k - 1), one, "bigint")


def _winnowed(hashes: Column) -> Column:
    """The fingerprints of a text of at least SPAN words."""
    smallest = lambda g: _each(F.size(g) - (WINDOW - 1), lambda i: F.least(*[F.get(g, i + j) for j in range(WINDOW)]), "bigint")
    return F.array_distinct(let(_grams(hashes, K), smallest))


def fingerprints(tokens: Column, lengths: list[int]) -> Column:
    """(length, fp) structs for windows of the given lengths; SPAN stands for winnowing."""

    def with_length(longs: Column, n: int) -> Column:
        return F.transform(longs, lambda g: F.struct(F.lit(n).alias("length"), g.alias("fp")))

    def of(hashes: Column) -> Column:
        parts = [with_length(_winnowed(hashes) if n == SPAN else _grams(hashes, n), n) for n in lengths]
        return F.concat(*parts) if parts else F.array().cast("array<struct<length:int,fp:bigint>>")

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), of)


def _hash(fp: Column) -> Column:
    return F.shiftright(fp, POSITION_BITS)


def _windows(tokens: Column, n: Column, starts: Callable[[Column], Column]) -> Column:
    """The start and the words, space-joined, of windows of n words."""
    return F.transform(starts(n), lambda s: F.struct(s.alias("start"), n.alias("length"), F.array_join(F.slice(tokens, s + 1, n), " ").alias("window")))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs.

    A word is hit if an occurrence of a benchmark window covers it; a document is contaminated if words are hit and at
    least one in twenty is. Null texts have no words. Rows that repeat an id are judged one by one. Items without words
    have no window; a null item_id is not listed. Of an empty benchmark nothing is hit.
    """
    return _report(docs, benchmark, id_col, text_col, item_col, item_text_col).drop("text_hash")


def _report(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    items = materialise(benchmark.select(F.col(item_col).cast("string").alias("item_id"), words(F.col(item_text_col)).alias("words")).where(F.size("words") > 0), "items")
    length = F.least(F.lit(SPAN), F.size("words"))
    # At most 13 numbers, whatever the benchmark's size.
    lengths = sorted(r[0] for r in items.select(length.cast("int").alias("n")).distinct().collect())
    own = reduce(DataFrame.unionByName, [items.where(length == n).select(F.explode(fingerprints(F.col("words"), [n])).alias("f")) for n in lengths]) if lengths else items.select(F.explode(fingerprints(F.col("words"), [])).alias("f"))
    keys = materialise(own.select("f.length", _hash(F.col("f.fp")).alias("h")).distinct(), "keys")
    cut = items.select("item_id", F.explode(_windows(F.col("words"), length, lambda n: F.sequence(F.lit(0), F.size("words") - n))).alias("w"))
    windows = materialise(cut.select("item_id", "w.window").distinct(), "windows")

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    scan = docs.select("doc_id", "text_hash", let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), fingerprints(w, lengths).alias("fps"))).alias("s"))
    scanned = materialise(scan.select("doc_id", "text_hash", "s.n_words", "s.fps"), "scanned")

    place = (1 << POSITION_BITS) - 1
    found = scanned.select("doc_id", "text_hash", F.explode("fps").alias("f")).select("doc_id", "text_hash", "f.length", _hash(F.col("f.fp")).alias("h"), F.col("f.fp").bitwiseAND(F.lit(place)).cast("int").alias("at"))
    found = found.join(keys, ["length", "h"], "left_semi").groupBy("doc_id", "text_hash", "length").agg(F.collect_set("at").alias("at"))
    candidates = materialise(found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("length", "at")).alias("hits")), "candidates")

    def around(tokens: Column, hits: Column) -> Column:
        """The windows of one length about its hits, each once. In a text of over 2**20 words a position stands for all
        that equal it modulo that."""
        n, last = hits["length"], F.size(tokens) - hits["length"]
        reach = F.when(n == SPAN, F.lit(WINDOW - 1)).otherwise(F.lit(0))
        near = lambda p: F.when((p - reach <= last), F.sequence(F.greatest(p - reach, F.lit(0)), F.least(p, last))).otherwise(F.array().cast("array<int>"))
        each = lambda at: F.flatten(F.transform(F.sequence(at, F.greatest(F.size(tokens), at), F.lit(place + 1)), near))
        # Distinct as plain numbers, which are hashed; structs would be compared pair by pair.
        return _windows(tokens, n, lambda _: F.array_distinct(F.flatten(F.transform(hits["at"], each))))

    same = docs.alias("d").join(candidates.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.text_hash") == F.col("c.text_hash")))
    # Rows that repeat id and text are looked at once.
    pairs = same.select("d.doc_id", "d.text_hash", "text", "hits")
    near = pairs.select("doc_id", "text_hash", F.explode(let(words(F.col("text")), lambda w: F.flatten(F.transform("hits", lambda h: around(w, h))))).alias("w"))
    near = near.select("doc_id", "text_hash", "w.start", "w.length", "w.window")
    matched = materialise(near.join(windows.select("window").distinct(), "window", "left_semi").distinct(), "matched")

    span = F.array_sort(F.collect_list(F.struct(F.col("start"), (F.col("start") + F.col("length")).alias("end"))))
    covered = F.aggregate(span, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["end"]))).alias("n"), F.greatest(a["end"], x["end"]).alias("end")))
    hit = matched.groupBy("doc_id", "text_hash").agg(covered["n"].cast("long").alias("n_hit"))
    by_item = matched.select("doc_id", "text_hash", "window").distinct().join(windows, "window").where(F.col("item_id").isNotNull()).select("doc_id", "text_hash", "item_id").distinct()
    listed = by_item.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    listed = listed.select("doc_id", "text_hash", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    told = materialise(hit.join(listed, hit["doc_id"].eqNullSafe(listed["doc_id"]) & (hit["text_hash"] == listed["text_hash"]), "left").select(hit["doc_id"], hit["text_hash"], "n_hit", "n_items", "items_sha256"), "told")

    s, t = scanned.alias("s"), told.alias("t")
    out = s.join(t, F.col("s.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("s.text_hash") == F.col("t.text_hash")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("s.doc_id", "s.text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are not contaminated.

    The cases are those of `report`: null, empty and word-less texts stay, as nothing of them can be hit; rows that
    repeat an id are judged by their own texts, those that repeat both share one judgement; a null id is judged like any
    other; an empty benchmark removes nothing and an empty table gives no rows. Time grows in proportion to a text's
    length, however much of it is hit. Further columns are carried along, whatever they are called, except `_bad_id` and
    `_bad_text`, which are renamed for the join.
    """
    if {"_bad_id", "_bad_text"} & {c.lower() for c in docs.columns}:
        names = docs.columns
        plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
        return clean(plain, benchmark, f"c{names.index(id_col)}", f"c{names.index(text_col)}", item_col, item_text_col).toDF(*names)
    bad = _report(docs, benchmark, id_col, text_col, item_col, item_text_col).where("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_text")).distinct()
    bad = materialise(bad, "contaminated")
    text_hash = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(bad["_bad_id"]) & (text_hash == bad["_bad_text"]), "left_anti")
