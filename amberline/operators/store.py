"""A store of entities with typed properties, relations, history and temperature.

A statement appends rows: what it sets, and marks for what it ends, under its number `seq`. Nothing is rewritten; a
reader takes the last row of each key, and history is the rows before that. A transaction keeps the list of folders that
were there, and a rollback returns to it. `compact` writes what is still valid as one folder, parted by a hash of the
entity's name, so that reading one entity opens a few files.

    bubbles(ns, name, seq, op)                  op: set, gone (ends the entity, its properties and history up to seq)
    props(ns, name, key, vtype, v_text, v_num, v_bool, v_json, atom_id, ts, T, seq, sub, op)
                                                op: set, heat (the same value at another temperature), remove, gone (ends
                                                the key and its history), ARCHIVE and DELETED (old values alone)
    rels(ns, source, relation, target, seq, op) op: set, gone

What readers see, by `table`:

    bubbles(ns, name)
    props(ns, name, key, vtype, v_text, v_num, v_bool, v_json, atom_id, ts, T)
    rels(ns, source, relation, target)
    history(ns, name, key, status, v_text, ts, seq)
"""

from __future__ import annotations

import contextlib
import io
import json
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amberline.functions.scalars import parsed
from amberline.operators.search import R_MIN, resonating
from amberline.operators.thermal import HEAT_READ, T_HOT, T_INIT, clamped, state
from amberline.tables import materialise, shared_dir

VALUE = ["vtype", "v_text", "v_num", "v_bool", "v_json"]
SCHEMAS = {
    "bubbles": "ns string, name string",
    "props": "ns string, name string, key string, vtype string, v_text string, v_num double, v_bool boolean, v_json string, atom_id string, ts long, T double",
    "rels": "ns string, source string, relation string, target string",
    "history": "ns string, name string, key string, status string, v_text string, ts long, seq long",
}
#: What is appended, and the parts of a compacted folder.
LOGS = {
    "bubbles": "ns string, name string, seq long, op string, bucket int",
    "props": SCHEMAS["props"] + ", seq long, sub long, op string, bucket int",
    "rels": SCHEMAS["rels"] + ", seq long, op string, bucket int",
}
OWNER = {"bubbles": "name", "props": "name", "rels": "source"}
BUCKETS = 16
DEFAULT = "DEFAULT"
#: Words for null, which name no entity.
NULLS = ("NIC", "NULL", "")


def columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def bucket(ns: Column, name: Column) -> Column:
    return F.pmod(F.xxhash64(ns, name), F.lit(BUCKETS)).cast("int")


def large(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the store. Spark would judge it by its compressed files, in which names take a few
    bits each, and build what it broadcasts in the driver's memory, where they take a hundred times that."""
    return side.hint("merge")


def dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt out by a hash of all they hold, so that what is written next has a file, and reading it a task, for
    each core; a table that comes as one file would stay in one. Adaptive execution puts small parts together."""
    return rows.repartition(*[F.col(c) for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind])


def first_free(wanted: DataFrame, used: DataFrame) -> DataFrame:
    """stem and n for each stem of `wanted`: the smallest number from 1 that `used` (stem, n) lacks. Wanted stems use 0
    too; a number that all smaller ones come before is then its place."""
    both = wanted.select("stem", F.lit(0).alias("n")).unionByName(used.select("stem", "n").where("n >= 1"))
    placed = both.withColumn("_place", F.dense_rank().over(Window.partitionBy("stem").orderBy("n")) - 1)
    return placed.where("n = _place").groupBy("stem").agg((F.max("n") + 1).alias("n"))


class StoreError(ValueError):
    pass


def typed(value) -> tuple:
    """A Python value as (vtype, v_text, v_num, v_bool, v_json)."""
    if value is None:
        return "null", "NIC", None, None, None
    if isinstance(value, bool):
        return "bool", "PRAWDA" if value else "FAŁSZ", None, value, None
    if isinstance(value, (int, float)):
        return "num", str(value), float(value), None, None
    if isinstance(value, (dict, list)):
        text = json.dumps(value, sort_keys=True, ensure_ascii=False)
        return "json", text, None, None, text
    return "text", str(value), None, None, None


class Store:
    def __init__(self, spark: SparkSession):
        self.spark, self.ns = spark, DEFAULT
        self.folders: dict[str, tuple[str, ...]] = {k: () for k in LOGS}
        self.bases: dict[str, str | None] = dict.fromkeys(LOGS)
        #: Tables in which something was ended since they were compacted; others need no look at ends.
        self.ended: frozenset[str] = frozenset()
        #: Tables in which a key may have several rows; in others each row is the last of its key.
        self.repeated: frozenset[str] = frozenset()
        self.views: dict[str, Callable[[Store], DataFrame]] = {}
        self.indexes: set[str] = set()
        self.rules: list[tuple[str, str, Callable | None]] = []
        self.namespaces, self._saved, self._seq = {DEFAULT}, [], 0
        self.context: str | None = None

    # --- state ---

    def _append(self, table: str, rows: DataFrame) -> None:
        path, schema = shared_dir(self.spark, table), columns(LOGS[table])
        rows = rows.withColumn("bucket", bucket(F.col("ns"), F.col(OWNER[table])))
        rows.select(*schema).write.option("compression", "zstd").parquet(path)
        self.folders[table] = (*self.folders[table], path)

    def _log(self, table: str, name: str | None = None) -> DataFrame:
        """What was appended; of one entity, if it is named."""
        parts = []
        if self.bases[table]:
            parts.append(self.spark.read.schema(LOGS[table]).parquet(self.bases[table]).select(*columns(LOGS[table])))
        if self.folders[table]:
            parts.append(self.spark.read.schema(LOGS[table]).parquet(*self.folders[table]))
        out = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], LOGS[table])
        if name is not None:
            out = out.where((F.col("bucket") == bucket(F.lit(self.ns), F.lit(name))) & (F.col("ns") == self.ns) & (F.col(OWNER[table]) == name))
        return out

    def _living(self, name: str | None = None) -> DataFrame:
        """Rows of props that no end of their entity or key came after."""
        log = rows = self._log("props", name)
        if "bubbles" in self.ended:
            ends = self._log("bubbles", name).where("op = 'gone'").groupBy("ns", "name").agg(F.max("seq").alias("_end"))
            rows = rows.join(large(ends), ["ns", "name"], "left").where("_end IS NULL OR seq > _end").drop("_end")
        if "props" in self.ended:
            keys = log.where("op = 'gone'").groupBy("ns", "name", "key").agg(F.max("seq").alias("_last"))
            rows = rows.join(large(keys), ["ns", "name", "key"], "left").where("_last IS NULL OR seq > _last").drop("_last")
        return rows.drop("bucket")

    def table(self, name: str, of: str | None = None) -> DataFrame:
        """bubbles, props, rels or history as they are now; of one entity (a relation's source), if it is named."""
        if name == "history":
            order = Window.partitionBy("ns", "name", "key").orderBy("seq", "sub")
            rows = self._living(of).where("op <> 'heat'").withColumn("_next", F.lead("op").over(order)).withColumn("_n", F.row_number().over(order).cast("long"))
            own = F.col("op").isin("ARCHIVE", "DELETED")
            status = F.when(own, F.col("op")).when(F.col("_next") == "remove", "DELETED").otherwise("ARCHIVE")
            old = rows.where((F.col("op") != "remove") & (own | F.col("_next").isNotNull()))
            return old.select("ns", "name", "key", status.alias("status"), "v_text", "ts", F.col("_n").alias("seq"))
        names = columns(SCHEMAS[name])
        if name not in self.repeated:
            return (self._living(of) if name == "props" else self._log(name, of)).select(*names)
        if name == "props":
            rest = [c for c in names if c not in ("ns", "name", "key")]
            last = self._living(of).groupBy("ns", "name", "key").agg(F.max_by(F.struct("op", *rest), F.struct("seq", "sub")).alias("r"))
            return last.where("r.op IN ('set', 'heat')").select("ns", "name", "key", *[F.col(f"r.{c}").alias(c) for c in rest])
        return self._log(name, of).groupBy(*names).agg(F.max_by("op", F.struct("seq", "op")).alias("op")).where("op = 'set'").drop("op")

    def _own(self, name: str, of: str | None = None) -> DataFrame:
        return self.table(name, of).where(F.col("ns") == self.ns)

    def compact(self) -> None:
        """One folder for each table with what is valid, old values included."""
        now = {t: self.table(t).withColumns({"seq": F.lit(0).cast("long"), "op": F.lit("set")}) for t in ("bubbles", "rels")} | {"props": self._living()}
        for t, rows in now.items():
            path = shared_dir(self.spark, t)
            parted = rows.withColumn("bucket", bucket(F.col("ns"), F.col(OWNER[t]))).repartition("bucket", OWNER[t])
            parted.select(*columns(LOGS[t])).write.option("compression", "zstd").partitionBy("bucket").parquet(path)
            now[t] = path
        for t, path in now.items():
            empty = self.spark.read.schema(LOGS[t]).parquet(path).isEmpty()
            self.bases[t], self.folders[t] = None if empty else path, ()
        self.ended = frozenset()
        self.repeated &= {"props"}  # with old values

    def load_tables(self, tables: dict[str, DataFrame]) -> None:
        """Take over bubbles, props, rels and history as `table` gives them."""
        self.repeated |= set(LOGS)
        self._seq += 1
        now = F.lit(self._seq).cast("long")
        for t in ("bubbles", "rels"):
            self._append(t, tables[t].withColumns({"seq": now, "op": F.lit("set")}))
        # Old values first, in their order, then the current ones.
        old = tables["history"].select("ns", "name", "key", F.col("status").alias("op"), "v_text", "ts", F.col("seq").alias("sub"))
        self._append("props", tables["props"].withColumns({"seq": now, "sub": F.lit(1 << 62), "op": F.lit("set")}).unionByName(old.withColumn("seq", now), allowMissingColumns=True))
        self._seq += 1
        self.namespaces |= {r.ns for r in tables["bubbles"].select("ns").distinct().collect()}

    def _state(self) -> tuple:
        return self.ns, dict(self.folders), dict(self.bases), self.ended, self.repeated, dict(self.views), set(self.indexes), list(self.rules), set(self.namespaces)

    def begin(self) -> None:
        self._saved.append(self._state())

    def commit(self) -> None:
        self._saved.pop()

    def rollback(self) -> None:
        self.ns, self.folders, self.bases, self.ended, self.repeated, self.views, self.indexes, self.rules, self.namespaces = self._saved.pop()

    def transaction(self, *steps: Callable[[Store], object]) -> list:
        """All steps or none."""
        self.begin()
        try:
            out = [step(self) for step in steps]
        except Exception:
            self.rollback()
            raise
        self.commit()
        return out

    # --- namespaces, views, indexes ---

    def create_namespace(self, ns: str) -> None:
        self.namespaces.add(ns)

    def use(self, ns: str) -> None:
        if ns not in self.namespaces:
            raise StoreError(f"no namespace {ns}")
        self.ns = ns

    def create_view(self, name: str, query: Callable[[Store], DataFrame]) -> None:
        """A view is a query that is run anew on each read."""
        self.views[name] = query

    def drop_view(self, name: str) -> None:
        del self.views[name]

    def view(self, name: str) -> DataFrame:
        return self.views[name](self)

    def create_index(self, key: str) -> int:
        """Pins the key; returns how many entities have a value for it."""
        self.indexes.add(key)
        return self._own("props").where((F.col("key") == key) & (F.col("vtype") != "null")).count()

    def drop_index(self, key: str) -> None:
        self.indexes.discard(key)

    # --- constraints ---

    def require_unique(self, key: str) -> None:
        self.rules.append(("unique", key, None))

    def require_not_null(self, key: str) -> None:
        self.rules.append(("not null", key, None))

    def require(self, key: str, check: Callable[[Column], Column]) -> None:
        """`check` gets the struct of the new value."""
        self.rules.append(("check", key, check))

    def drop_rule(self, kind: str, key: str) -> None:
        self.rules = [r for r in self.rules if r[:2] != (kind, key)]

    def _checked(self, new: DataFrame) -> DataFrame:
        """Values that are about to be written (name, key, value columns), checked as a whole before anything changes."""
        for kind, key, check in self.rules:
            own = new.where(F.col("key") == key)
            if kind == "not null":
                bad = own.where(F.col("vtype") == "null")
            elif kind == "check":
                bad = own.where(~F.coalesce(check(F.struct(*VALUE)), F.lit(False)))
            else:
                others = self._own("props").where(F.col("key") == key).join(large(own.select("name")), "name", "left_anti")
                both = own.select("name", "vtype", "v_text").unionByName(others.select("name", "vtype", "v_text"))
                bad = both.where(F.col("vtype") != "null").groupBy("v_text").count().where("count > 1")
            if not bad.isEmpty():
                raise StoreError(f"{kind} {key}")
        return new

    def violations(self, kind: str, key: str, check: Callable[[Column], Column] | None = None) -> DataFrame:
        """Values in the store that a rule would refuse; rules look at new values only."""
        own = self._own("props").where(F.col("key") == key)
        if kind == "check":
            return own.where(~F.coalesce(check(F.struct(*VALUE)), F.lit(False))).select("name")
        if kind == "unique":
            return own.where(F.col("vtype") != "null").groupBy("v_text").agg(F.count("*").alias("rows")).where("rows > 1")
        return own.where(F.col("vtype") == "null").select("name")

    # --- writing ---

    def _values(self, rows: list[tuple]) -> DataFrame:
        data = [(name, key, *typed(value)) for name, key, value in rows]
        return self.spark.createDataFrame(data, "name string, key string, vtype string, v_text string, v_num double, v_bool boolean, v_json string")

    def _write(self, new: DataFrame, order: list[str] = (), fresh: bool = False) -> int:
        """Set properties (name, key and value columns); what they replace is history. Of several values for one key
        in one statement the last by `order` holds. `fresh` says that the entities are new and no key comes twice."""
        new = self._checked(materialise(new, "new")) if self.rules else new
        self.repeated |= set() if fresh else {"props"}
        now = int(time.time() * 1000)
        self._seq += 1
        sub = F.row_number().over(Window.partitionBy("name", "key").orderBy(*order)) if order else F.lit(0)
        self._append("props", new.select(F.lit(self.ns).alias("ns"), "name", "key", *VALUE, F.expr("uuid()").alias("atom_id"), F.lit(now).alias("ts"), F.lit(T_INIT).alias("T"), F.lit(self._seq).cast("long").alias("seq"), sub.cast("long").alias("sub"), F.lit("set").alias("op")))
        return self.spark.read.schema(LOGS["props"]).parquet(self.folders["props"][-1]).count()

    def _end(self, table: str, rows: DataFrame) -> None:
        """Append ends of what `rows` names."""
        self._seq += 1
        marks = {"seq": F.lit(self._seq).cast("long"), "op": F.lit("gone")} | ({"sub": F.lit(0).cast("long")} if table == "props" else {})
        have = set(rows.columns)
        missing = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in LOGS[table].split(", ") if c.split()[0] not in have | {"bucket"}}
        self._append(table, rows.withColumns(missing | marks))
        self.ended |= {table}
        self.repeated |= {table}

    def create(self, *names: str) -> None:
        self.create_all(self.spark.createDataFrame([(n,) for n in names], "name string"))

    def create_all(self, names: DataFrame) -> None:
        both = names.select("name", F.lit(True).alias("new")).unionByName(self._own("bubbles").select("name", F.lit(False).alias("new")))
        if not both.groupBy("name").agg(F.count("*").alias("rows"), F.max("new").alias("new")).where("new AND rows > 1").isEmpty():
            raise StoreError("an entity of that name exists")
        self._seq += 1
        self._append("bubbles", names.select(F.lit(self.ns).alias("ns"), "name", F.lit(self._seq).cast("long").alias("seq"), F.lit("set").alias("op")))

    def insert(self, name: str, **properties) -> None:
        self._known(name)
        self._write(self._values([(name, k, v) for k, v in properties.items()]))

    def insert_rows(self, rows: DataFrame) -> int:
        """The first column names new entities (null ones and words for null are passed over), the others are properties;
        nulls are none."""
        first, *others = rows.columns
        named = F.col(first).isNotNull() & ~F.upper(F.trim(F.col(first).cast("string"))).isin(*NULLS)
        rows = materialise(dealt(rows.where(named)), "rows")
        self.create_all(rows.select(F.col(first).cast("string").alias("name")))
        if others:
            self._write(self._unpivot(rows, first, others), fresh=True)
        return rows.count()

    def set_rows(self, rows: DataFrame, order: list[str] = ()) -> int:
        """Properties of entities that the first column names; names that are not known are created. Rows that repeat a
        name are versions, in the order of the columns `order`, which are no properties."""
        first, *others = rows.columns
        rows = materialise(dealt(rows), "rows")
        names = rows.select(F.col(first).cast("string").alias("name")).distinct()
        known = self._own("bubbles").select(F.col("name").alias("_known"))
        self.create_all(names.join(large(known), F.col("name").eqNullSafe(F.col("_known")), "left_anti"))
        return self._write(self._unpivot(rows, first, [c for c in others if c not in order], list(order)), list(order))

    def merge_rows(self, rows: DataFrame, on: str) -> int:
        """Rows that share their value of `on` with entities here set the properties of the first of those, by name;
        others create an entity under their first column's name."""
        name = rows.columns[0]
        known = self._own("props").where((F.col("key") == on) & (F.col("vtype") != "null")).groupBy(F.col("v_text").alias("_k")).agg(F.min("name").alias("_name"))
        joined = rows.join(large(known), rows[on].cast("string") == known["_k"], "left")
        return self.set_rows(joined.select(F.coalesce("_name", F.col(name).cast("string")).alias("_entity"), *[c for c in rows.columns if c != name]))

    @staticmethod
    def _unpivot(rows: DataFrame, name: str, columns: list[str], others: list[str] = ()) -> DataFrame:
        kinds = dict(rows.dtypes)

        def value(c: str) -> Column:
            x, kind = F.col(c), kinds[c]
            if kind == "string":
                return parsed(x)
            num = kind not in ("boolean",) and not kind.startswith(("array", "map", "struct", "variant"))
            if num:
                return F.struct(F.lit("num").alias("vtype"), x.cast("string").alias("v_text"), x.cast("double").alias("v_num"), F.lit(None).cast("boolean").alias("v_bool"), F.lit(None).cast("string").alias("v_json"))
            if kind == "boolean":
                return F.struct(F.lit("bool").alias("vtype"), F.when(x, "PRAWDA").otherwise("FAŁSZ").alias("v_text"), F.lit(None).cast("double").alias("v_num"), x.alias("v_bool"), F.lit(None).cast("string").alias("v_json"))
            text = F.to_json(x)
            return F.struct(F.lit("json").alias("vtype"), text.alias("v_text"), F.lit(None).cast("double").alias("v_num"), F.lit(None).cast("boolean").alias("v_bool"), text.alias("v_json"))

        each = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).isNull().alias("none"), value(c).alias("v")) for c in columns])).alias("p")
        return rows.select(F.col(name).cast("string").alias("name"), *others, each).where(~F.col("p.none") & (F.col("p.v.vtype") != "null")).select("name", *others, "p.key", *[F.col(f"p.v.{c}").alias(c) for c in VALUE])

    def update(self, where: DataFrame | str, key: str, value) -> int:
        """Set a property of one entity or of a table of names. "+n" and "-n" add to a number that is there."""
        one = where if isinstance(where, str) else None
        if one is not None:
            self._known(one)
            where = self.spark.createDataFrame([(one,)], "name string")
        names = where.select(F.col(where.columns[0]).alias("name")).distinct()
        vtype, text, num, truth, js = typed(value)
        literals = {"vtype": F.lit(vtype), "v_text": F.lit(text), "v_num": F.lit(num).cast("double"), "v_bool": F.lit(truth).cast("boolean"), "v_json": F.lit(js).cast("string")}
        step = None
        if isinstance(value, str) and value[:1] in "+-" and value[1:].replace(".", "", 1).isdigit():
            step = float(value)
        old = self._own("props", one).where(F.col("key") == key).select("name", *[F.col(c).alias(f"_{c}") for c in VALUE])
        both = names.join(large(old), "name", "left")
        if step is None:
            new = both.select("name", F.lit(key).alias("key"), *[literals[c].alias(c) for c in VALUE])
        else:
            adds, total = F.coalesce(F.col("_vtype") == "num", F.lit(False)), F.col("_v_num") + step
            shown = F.when(total == F.floor(total), F.floor(total).cast("string")).otherwise(total.cast("string"))
            plus = {"vtype": F.lit("num"), "v_text": shown, "v_num": total, "v_bool": F.lit(None).cast("boolean"), "v_json": F.lit(None).cast("string")}
            plain = dict(zip(VALUE, [F.lit(x) for x in ("num", str(step), step, None, None)], strict=True))
            new = both.select("name", F.lit(key).alias("key"), *[F.when(adds, plus[c]).otherwise(plain[c]).alias(c) for c in VALUE])
        return self._write(new)

    def merge(self, name: str, **properties) -> str:
        created = not self._has(name)
        if created:
            self.create(name)
        self.insert(name, **properties)
        return "created" if created else "updated"

    def merge_on(self, key: str, value, **properties) -> str:
        """Update the first entity, by name, that has the value; else create one named after it, with the first number
        that is free."""
        text = typed(value)[1]
        found = self._own("props").where((F.col("key") == key) & (F.col("v_text") == text)).agg(F.min("name").alias("name")).first()["name"]
        if found:
            self.insert(found, **properties)
            return found
        number = F.when(F.col("name") == text, 1).otherwise(F.regexp_extract("name", rf"^\Q{text}\E_(\d+)$", 1).try_cast("int"))
        used = self._own("bubbles").select(F.lit(text).alias("stem"), number.alias("n")).where("n IS NOT NULL")
        n = first_free(self.spark.createDataFrame([(text,)], "stem string"), used).first()["n"]
        name = text if n == 1 else f"{text}_{n}"
        self.create(name)
        self.insert(name, **{key: value, **properties})
        return name

    def clone(self, names: DataFrame, suffix: str = "_kopia") -> DataFrame:
        """Copies of entities with their properties and outgoing relations, under names with a suffix and, from the second
        copy on, the first number that is free."""
        names = names.select(F.col(names.columns[0]).alias("name")).where("name IS NOT NULL").distinct()
        own = self._own("bubbles").select(F.col("name").alias("taken")).where(F.col("taken").contains(suffix))
        stem = F.regexp_extract("taken", rf"^(.*){suffix}(_(\d+))?$", 1)
        number = F.when(F.col("taken").endswith(suffix), 1).otherwise(F.regexp_extract("taken", rf"{suffix}_(\d+)$", 1).try_cast("int"))
        used = own.select(stem.alias("stem"), number.alias("n")).where("stem <> '' AND n IS NOT NULL")
        free = first_free(names.select(F.col("name").alias("stem")), used)
        new = free.select(F.col("stem").alias("name"), F.concat("stem", F.lit(suffix), F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise("")).alias("copy"))
        new = materialise(new, "copies")
        props = self._own("props").join(large(new), "name").select(F.col("copy").alias("name"), "key", *VALUE)
        related = bool(self.bases["rels"] or self.folders["rels"])
        if related:
            rels = materialise(self._own("rels").join(large(new), F.col("source") == F.col("name")).select(F.col("copy").alias("source"), "relation", "target"), "relations")
        self.create_all(new.select(F.col("copy").alias("name")))
        self._write(props, fresh=True)
        if related:
            self.connect_all(rels)
        return new.select(F.col("copy").alias("name"))

    def remove(self, name: str, key: str) -> None:
        """The value goes to history."""
        self._known(name)
        self._seq += 1
        now = self._own("props", name).where(F.col("key") == key)
        self._append("props", now.withColumns({"seq": F.lit(self._seq).cast("long"), "sub": F.lit(0).cast("long"), "op": F.lit("remove")}))
        self.repeated |= {"props"}

    def delete(self, where: DataFrame | str) -> int:
        """Entities with their properties, their history and the relations from and to them."""
        if isinstance(where, str):
            self._known(where)
            where = self.spark.createDataFrame([(where,)], "name string")
        names = where.select(F.lit(self.ns).alias("ns"), F.col(where.columns[0]).alias("name")).distinct()
        names = materialise(names.join(large(self.table("bubbles")), ["ns", "name"], "left_semi"), "gone")
        source, target = large(names.withColumnRenamed("name", "source")), large(names.withColumnRenamed("name", "target"))
        rels = self.table("rels")
        self._end("rels", rels.join(source, ["ns", "source"], "left_semi").unionByName(rels.join(target, ["ns", "target"], "left_semi")).distinct())
        self._end("bubbles", names)
        return names.count()

    def rename(self, old: str, new: str) -> None:
        self._known(old)
        if self._has(new):
            raise StoreError(f"{new} exists")
        change = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c)).alias(c)
        rels = materialise(self._own("rels").where((F.col("source") == old) | (F.col("target") == old)), "relations")
        rows = materialise(self._living(old).where(F.col("ns") == self.ns), "rows")
        self._end("rels", rels)
        self._end("bubbles", self.spark.createDataFrame([(self.ns, old)], "ns string, name string"))
        self.create(new)
        self.connect_all(rels.select(change("source"), "relation", change("target")))
        self._again(rows.withColumn("name", F.lit(new)))

    def rename_property(self, name: str, old: str, new: str) -> None:
        self._known(name)
        if not self._own("props", name).where(F.col("key") == new).isEmpty():
            raise StoreError(f"{new} exists")
        rows = materialise(self._living(name).where((F.col("ns") == self.ns) & (F.col("key") == old)), "rows")
        self._end("props", self.spark.createDataFrame([(self.ns, name, old)], "ns string, name string, key string"))
        self._again(rows.withColumn("key", F.lit(new)))

    def _again(self, rows: DataFrame) -> None:
        """Append rows of props once more, in their order."""
        self._seq += 1
        order = F.row_number().over(Window.partitionBy("ns", "name", "key").orderBy("seq", "sub"))
        self._append("props", rows.withColumn("sub", order.cast("long")).withColumn("seq", F.lit(self._seq).cast("long")))
        self.repeated |= {"props"}

    def connect(self, source: str, target: str, relation: str) -> None:
        self._known(source)
        self._known(target)
        self.connect_all(self.spark.createDataFrame([(source, relation, target)], "source string, relation string, target string"))

    def connect_all(self, edges: DataFrame) -> None:
        self._seq += 1
        self._append("rels", edges.select(F.lit(self.ns).alias("ns"), "source", "relation", "target", F.lit(self._seq).cast("long").alias("seq"), F.lit("set").alias("op")))
        self.repeated |= {"rels"}

    def disconnect(self, source: str, target: str, relation: str) -> None:
        self._end("rels", self.spark.createDataFrame([(self.ns, source, relation, target)], SCHEMAS["rels"]))

    def excite(self, gains: DataFrame) -> None:
        """Add energy (name, energy) to the temperature of every atom of an entity."""
        self._seq += 1
        joined = self._own("props").join(large(gains), "name").withColumn("T", clamped(F.col("T") + F.coalesce("energy", F.lit(0.0))))
        self._append("props", joined.withColumns({"seq": F.lit(self._seq).cast("long"), "sub": F.lit(0).cast("long"), "op": F.lit("heat")}))
        self.repeated |= {"props"}

    # --- reading ---

    def _has(self, name: str) -> bool:
        return not self._own("bubbles", name).isEmpty()

    def _known(self, name: str) -> None:
        if not self._has(name):
            raise StoreError(f"no entity {name}")

    def names(self) -> DataFrame:
        return self._own("bubbles").select("name")

    def relations(self) -> DataFrame:
        return self._own("rels").select("source", "relation", "target")

    def wide(self, **keys: str) -> DataFrame:
        """One row for each entity: name, TEMPERATURA, and the given properties as columns of a kind (text, num, bool,
        json). Missing properties are null."""
        props = self._own("props").where("name IS NOT NULL").withColumn("_there", F.lit(False))
        both = props.unionByName(self.names().withColumn("_there", F.lit(True)), allowMissingColumns=True)
        columns = [F.max(F.when((F.col("key") == k) & (F.col("vtype") != "null"), F.col(f"v_{kind}"))).alias(k) for k, kind in keys.items()]
        by_name = both.groupBy("name").agg(F.max("_there").alias("_there"), *columns, F.max("T").alias("TEMPERATURA"))
        return by_name.where("_there").drop("_there")

    def shown(self, name: str) -> DataFrame:
        """kind (property or relation), item and value of one entity. Looking heats its atoms."""
        self._known(name)
        props = self._own("props", name).select(F.lit("property").alias("kind"), F.col("key").alias("item"), F.col("v_text").alias("value"))
        out = props.unionByName(self._own("rels", name).select(F.lit("relation").alias("kind"), F.col("relation").alias("item"), F.col("target").alias("value")))
        self.excite(self.spark.createDataFrame([(name, HEAT_READ)], "name string, energy double"))
        return out

    def show(self, name: str) -> dict:
        rows = self.shown(name).orderBy("item", "value").collect()  # those of one entity
        return {"name": name, "properties": {r["item"]: r["value"] for r in rows if r["kind"] == "property"}, "relations": [(r["item"], r["value"]) for r in rows if r["kind"] == "relation"]}

    def project(self, name: str, **keys: str) -> DataFrame:
        """`wide` of one entity."""
        self._known(name)
        return self.wide(**keys).where(F.col("name") == name)

    def hot(self, least: float = T_HOT) -> DataFrame:
        """Atoms at least so hot, hottest first."""
        return self._own("props").where(F.col("T") >= least).select("name", "key", "atom_id", "v_text", "T").orderBy(F.col("T").desc(), "name", "key")

    def set_context(self, name: str | None) -> None:
        """The entity whose text stands for a query that names none."""
        if name is not None:
            self._known(name)
        self.context = name

    def texts(self) -> DataFrame:
        """name, E (name and values as one text, by key) and T (of the hottest atom) of every entity with properties."""
        words = F.array_sort(F.collect_list(F.struct("key", "v_text")))["v_text"]
        found = self._own("props").groupBy("name").agg(F.concat_ws(" ", F.col("name"), words).alias("E"), F.max("T").alias("T"))
        return found

    def resonating(self, query: str | None = None, t_min: float = 0.0, r_min: float = R_MIN, limit: int | None = 10) -> DataFrame:
        """name, T and R of entities that resonate with a text, or with the context's, which is left out itself."""
        atoms = self.texts()
        if query is None:
            if self.context is None:
                raise StoreError("no query and no context")
            probe = F.broadcast(atoms.where(F.col("name") == self.context).select(F.col("E").alias("_q")))
            return resonating(atoms.where(F.col("name") != self.context).join(probe, F.lit(True)), F.col("_q"), t_min, r_min, limit).select("name", "T", "R")
        return resonating(atoms, query, t_min, r_min, limit).select("name", "T", "R")

    def history(self, name: str, key: str) -> DataFrame:
        """Old values and the current one, oldest first."""
        return self.versions(key, name).orderBy("seq").select("status", "v_text", "ts")

    def versions(self, key: str, name: str | None = None) -> DataFrame:
        """name, status (ARCHIVE, DELETED or CURRENT), v_text, ts and seq of all values that a property had, of one entity
        or of all."""
        old = self._own("history", name).where(F.col("key") == key).select("name", "status", "v_text", "ts", "seq")
        now = self._own("props", name).where(F.col("key") == key).select("name", F.lit("CURRENT").alias("status"), "v_text", "ts", F.lit(1 << 62).alias("seq"))
        return old.unionByName(now)

    @staticmethod
    def _samples(rows: DataFrame, kind: str, item: Column, value: str) -> DataFrame:
        """kind, item, rows and the three smallest different values: no group is gathered, each is ranked with a limit."""
        rows = rows.select(item.alias("item"), F.col(value).alias("v"))
        rank = F.row_number().over(Window.partitionBy("item").orderBy("v"))
        few = rows.where("v IS NOT NULL").distinct().withColumn("_n", rank).where("_n <= 3").groupBy("item").agg(F.array_sort(F.collect_list("v")).alias("samples"))
        counted = rows.groupBy("item").agg(F.count("*").alias("rows"))
        return counted.join(large(few), "item", "left").select(F.lit(kind).alias("kind"), "item", "rows", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))

    def describe(self) -> DataFrame:
        """kind, item, rows and samples (three at most) of what the store holds."""
        props = self._samples(self._own("props"), "property", F.col("key"), "v_text")
        rels = self._samples(self._own("rels"), "relation", F.col("relation"), "target")
        names = self._samples(self.table("bubbles"), "namespace", F.col("ns"), "name")
        other = [("view", v) for v in self.views] + [("index", i) for i in self.indexes] + [(kind, key) for kind, key, _ in self.rules]
        rest = self.spark.createDataFrame([(k, i, None, []) for k, i in other], "kind string, item string, rows long, samples array<string>")
        return reduce(DataFrame.unionByName, [names, props, rels, rest])

    def explain(self, key: str, op: str, value) -> dict:
        """What kind of condition it is, about how many entities it would give, and Spark's own plan of it."""
        props = self._own("props").where(F.col("key") == key)
        found = props.where(F.col("v_text") == typed(value)[1]) if op == "=" else self.names()
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            found.explain()
        node = {"node": "index_lookup", "key": key, "pinned": key in self.indexes} if op == "=" else {"node": "full_scan", "key": key, "op": op}
        return node | {"rows": found.count(), "plan": plan.getvalue()}

    def collect_orphans(self) -> int:
        """Drop properties of entities that are gone; returns how many."""
        gone = materialise(self.table("props").join(large(self.table("bubbles")), ["ns", "name"], "left_anti").select("ns", "name", "key"), "orphans")
        self._end("props", gone)
        return gone.count()

    def states(self) -> DataFrame:
        return self._own("props").groupBy(state(F.col("T")).alias("state")).agg(F.count("*").alias("atoms"))
