"""Small goldens: the store, predicates, graph, temperature, search, merging, sources and streams."""

import contextlib
import io
import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from amberline.functions import predicates as P
from amberline.functions import scalars as X
from amberline.operators import graph, merge, relational, search, thermal, vectors
from amberline.operators.store import Store, StoreError, first_free
from amberline.sources import csv, media, world
from amberline.streaming import streams


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


@pytest.fixture(scope="module")
def servers(spark):
    return frame(spark, [("A", 2048, "Serwer"), ("B", 512, "Plik"), ("C", 128, "Serwer"), ("D", None, None)], "name string, RAM long, Typ string")


def test_predicates_are_two_valued(servers):
    names = lambda p: sorted(values(servers.where(p), "name"))
    ram, typ = F.col("RAM"), F.col("Typ")
    assert names(P.ne(typ, F.lit("Serwer"))) == ["B", "D"]
    assert names(P.negate(P.gt(ram, 200))) == ["C", "D"]
    assert names(P.eq(typ, F.lit(None))) == ["D"]
    assert names(P.between(ram, 128, 512)) == ["B", "C"]
    assert names(P.like(typ, "ser%")) == ["A", "C"] and names(P.not_like(typ, "ser%")) == ["B", "D"]
    assert names(P.regexp(typ, "(")) == [] and len(names(P.not_regexp(typ, "("))) == 4
    assert names(P.isin(typ, ["Plik", None])) == ["B", "D"]
    assert names(P.contains(typ, "LIK")) == ["B"]


@pytest.mark.parametrize(("op", "kind", "want"), [(">", "ALL", ["A"]), (">", "ANY", ["A", "B"]), ("!=", "ALL", ["A", "D"]), ("=", "ANY", ["B", "C"]), ("!=", "ANY", ["A", "B", "C", "D"])])
def test_quantified(spark, servers, op, kind, want):
    sub = frame(spark, [(512,), (128,), (None,)], "x long")
    assert sorted(values(P.quantified(servers, "RAM", op, kind, sub), "name")) == want
    none = sub.where("false")
    assert P.quantified(servers, "RAM", op, kind, none).count() == (4 if kind == "ALL" else 0)


def test_scalars(spark):
    df = frame(spark, [("  Jan \t", "AbCdE", "42", 0.0)], "n string, k string, q string, z double")
    r = df.select(X.trim(F.col("n")), X.substring(F.col("k"), 2, 3), X.to_integer(F.col("q")), X.divide(F.lit(1), F.col("z")), X.length(F.lit(None).cast("string")), X.concat(F.col("k"), F.lit(None), F.lit(7))).first()
    assert tuple(r) == ("Jan", "bCd", 42, None, 0, "AbCdE7")
    kinds = frame(spark, [("PRAWDA",), ("nic",), ("1.5",), ('{"a": 1}',), ("'x'",), ("{bad",), ("12",)], "t string").select(X.parsed(F.col("t")).alias("v")).select("v.vtype", "v.v_text")
    assert [tuple(r) for r in kinds.collect()] == [("bool", "PRAWDA"), ("null", "NIC"), ("num", "1.5"), ("json", '{"a": 1}'), ("text", "x"), ("text", "{bad"), ("num", "12")]
    j = frame(spark, [('{"hp": 100, "skills": ["fire", "ice"]}',)], "s string")
    assert tuple(j.select(X.json_value(F.col("s"), "hp"), X.json_value(F.col("s"), "$.skills[0]"), X.json_value(F.col("s"), "$.no")).first()) == ("100", "fire", None)


def test_windows_and_sets(spark):
    df = frame(spark, [(i,) for i in range(6)], "i long").withColumn("g", F.lit(1))
    assert values(df.select("i", relational.ntile(4, ["g"], [F.col("i")]).alias("b")).orderBy("i"), "b") == [1, 1, 2, 3, 3, 4]
    a, b = frame(spark, [("x",), ("x",), (None,)], "k string"), frame(spark, [("x",), (None,)], "k string")
    assert relational.intersect(a, b).count() == 3 and relational.difference(a, b).count() == 0 and relational.union(a, b).count() == 2
    with pytest.raises(ValueError):
        relational.union(a, b.toDF("other"))


def test_joins(spark):
    left, right = frame(spark, [(1, None), (2, "a")], "i long, k string"), frame(spark, [(3, None), (4, "a")], "i long, k string")
    assert relational.join(left, right, [("k", "k")]).count() == 1
    assert relational.join(left, right, [("k", "k"), ("k", "k")]).count() == 2
    assert relational.join(left, right, [("k", "k")], "left").count() == 2


def test_store(spark):
    s = Store(spark)
    s.create("A", "B", "C")
    s.insert("A", RAM=100, Typ="S")
    s.insert("B", RAM=200, Typ="S")
    s.insert("C", RAM=50, Typ="P", Stats={"hp": 3})
    with pytest.raises(StoreError):
        s.create("A")
    wide = s.wide(RAM="num", Typ="text")
    assert values(wide.groupBy("Typ").agg(F.sum("RAM").alias("x")).where("x > 150"), "Typ", "x") == [("S", 300.0)]
    s.connect("A", "B", "link")
    assert values(graph.find_by_relation(s.relations(), "link", "B"), "name") == ["A"]
    assert sorted(values(s.clone(s.names().where("name IN ('A', 'B')")), "name")) == ["A_kopia", "B_kopia"]
    assert values(s.clone(s.names().where("name = 'A'")), "name") == ["A_kopia_2"]
    assert sorted(values(s.relations(), "source")) == ["A", "A_kopia", "A_kopia_2"]
    s.update("A", "RAM", "+5")
    assert values(s.history("A", "RAM"), "status", "v_text") == [("ARCHIVE", "100"), ("CURRENT", "105")]
    assert s.merge("N", RAM=1) == "created" and s.merge("N", RAM=2) == "updated"
    assert s.merge_on("Typ", "P", RAM=51) == "C" and s.merge_on("Typ", "Q", RAM=1) == "Q" and s.merge_on("Sku", "Q", RAM=1) == "Q_2"
    s.rename("B", "BB")
    assert "BB" in values(s.relations(), "target")
    s.rename_property("BB", "RAM", "MEM")
    assert s.show("BB")["properties"] == {"MEM": "200", "Typ": "S"}
    s.remove("BB", "MEM")
    assert values(s.history("BB", "MEM"), "status") == ["DELETED"]
    assert s.delete("BB") == 1 and "BB" not in values(s.relations(), "target")
    assert s.explain("Typ", "=", "S")["node"] == "index_lookup" and s.create_index("Typ") > 0
    s.connect("A", "C", "near")
    kinds = {(r.kind, r.item) for r in s.describe().collect()}
    assert {("property", "RAM"), ("relation", "near"), ("namespace", "DEFAULT"), ("index", "Typ")} <= kinds


def test_store_rules_and_transactions(spark):
    s = Store(spark)
    s.create("T", "U")
    s.insert("T", RAM=1024, Sku="X1")
    s.require_unique("Sku")
    s.require_not_null("Sku")
    s.require("RAM", lambda v: v["v_num"] >= 0)
    for bad in ({"Sku": "X1"}, {"Sku": None}, {"RAM": -1}):
        with pytest.raises(StoreError):
            s.insert("U", **bad)
    with pytest.raises(StoreError):
        s.transaction(lambda t: t.insert("T", RAM=1), lambda t: t.create("Y"), lambda t: t.create("Y"))
    assert s.show("T")["properties"]["RAM"] == "1024" and "Y" not in values(s.names(), "name")
    s.drop_rule("unique", "Sku")
    s.insert("U", Sku="X1")
    assert values(s.violations("unique", "Sku"), "v_text") == ["X1"]
    s.create_namespace("other")
    s.use("other")
    assert s.names().count() == 0
    s.use("DEFAULT")
    s.create_view("v", lambda x: x.names())
    assert s.view("v").count() == 2


def test_csv_and_world(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/a.csv", "w", encoding="utf-8-sig") as f:
        f.write("BĄBEL,Typ,RAM\nS1,Serwer,32\nS2,Serwer,\nS3,FAŁSZ,6.5\n")
    s = Store(spark)
    assert csv.load(s, f"{folder}/a.csv") == 3
    assert sorted(values(s.wide(RAM="num"), "name", "RAM"), key=str) == [("S1", 32.0), ("S2", None), ("S3", 6.5)]
    with open(f"{folder}/b.csv", "w") as f:
        f.write("name,RAM,Typ\nnew,64,Plik\nx,33,Serwer\n")
    csv.load(s, f"{folder}/b.csv", upsert_on="Typ")
    assert s.show("S1")["properties"]["RAM"] == "33" and s.show("new")["properties"]["Typ"] == "Plik"
    s.connect("S1", "S2", "road")
    world.save(s, f"{folder}/w")
    again = world.load(spark, f"{folder}/w")
    assert again.names().count() == 4 and again.show("S1")["relations"] == [("road", "S2")]
    assert set(values(world.unfold(spark, f"{folder}/w", "S1", 1), "name")) == {"S1", "S2"}
    assert "v_text" not in world.manifest(spark, f"{folder}/w").columns
    csv.save(s.wide(RAM="num").select("name", "RAM"), f"{folder}/out")
    assert csv.read(spark, f"{folder}/out").count() == 4


def test_media(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    data = bytes(range(256)) * 10
    with open(f"{folder}/x.bin", "wb") as f:
        f.write(data)
    blobs = media.read(spark, folder)
    cut = media.segments(blobs, 1000)
    assert cut.count() == 3 and bytes(media.assembled(cut).first()["bytes"]) == data
    assert bytes(blobs.select(media.part(F.col("bytes"), 5, 3).alias("p")).first()["p"]) == data[5:8]


def test_graph(spark):
    rels = frame(spark, [("a", "r", "b"), ("b", "r", "c"), ("c", "s", "d"), ("x", "r", "y")], "source string, relation string, target string")
    nodes = frame(spark, [(n,) for n in "abcdxyz"], "name string")
    assert dict(values(graph.within(rels, nodes, ["b", "?"], 1), "name", "hops")) == {"b": 0, "a": 1, "c": 1}
    assert dict(values(graph.regions(nodes, rels), "name", "region")) == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "z": "z"}
    assert dict(values(graph.activation(rels, "a", 5.0), "name", "energy")) == {"a": 5.0, "b": 2.5, "c": 1.25}
    assert dict(values(graph.activation(rels, "b", 9.0, "r"), "name", "energy")) == {"b": 9.0, "c": 4.5}
    assert sorted(values(graph.reachable(rels, frame(spark, [("b",)], "n string")), "name")) == ["b", "c", "d"]
    atoms = frame(spark, [("a", "1"), ("x", "1"), ("b", "2"), ("c", "2")], "name string, atom_id string")
    assert values(graph.atom_regions(atoms, graph.regions(nodes, rels)), "atom_id", "region") == [("2", "a")]


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1080)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(values(graph.components(frame(spark, edges, "a long, b long")), "node", "root"))
    assert all(got.get(x, x) == find(x) for x in root)


def test_thermal(spark):
    atoms = frame(spark, [("orphan", 50.0), ("rooted", 0.5), ("hot", 100.0)], "atom_id string, T double")
    after = thermal.tick(atoms, 39, frame(spark, [("rooted",)], "atom_id string"))
    assert sorted(values(after, "atom_id", "retained")) == [("hot", False), ("rooted", True)]
    frames = frame(spark, [(1, "a", 10.0), (3, "a", 80.0), (2, "b", 1.0)], "tick int, atom_id string, T double")
    assert sorted(values(thermal.as_of(frames, 2), "atom_id", "T")) == [("a", 10.0), ("b", 1.0)]
    chain = thermal.chained(frames)
    assert thermal.broken_links(chain, frames).count() == 0
    assert sorted(values(thermal.broken_links(chain, frames.where("tick <> 2")), "tick")) == [2, 3]


def test_search(spark):
    peers = frame(spark, [("far", "noise", 8.0), ("twin", "graph query engine", 1.0), ("mid", "graph query", 2.5)], "name string, label string, energy double")
    assert values(search.ranked_peers(peers, "graph query engine", 1.0), "name")[0] == "twin"
    df = frame(spark, [("", "x"), ("Abc", "abc"), ("10", "11"), ("night", "nacht")], "a string, b string")
    sims = values(df.select(search.surface_similarity(F.col("a"), F.col("b")).alias("s")), "s")
    assert sims[0] == 0.0 and sims[1] == 1.0 and abs(sims[2] - 0.9 * (1 - 1 / 11)) < 1e-9 and 0 < sims[3] < 1
    atoms = frame(spark, [("G", "Gandalf the NPC"), ("A", "Aldric")], "name string, E string")
    assert values(search.resonance_search(atoms, "npc gandalf"), "name") == ["G"]
    v = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1])], "vec_id long, embedding array<double>").withColumn("label", F.lit(0))
    assert values(search.nearest(v, [1.0, 0.0], 2), "vec_id") == [1, 3]
    assert dict(values(search.field_coverage(v), "id", "leader")) == {1: 1, 2: 2, 3: 1}


def test_vectors(spark):
    one = frame(spark, [("a", "b")], "a string, b string").select(vectors.vector_of(F.col("a"), 512).alias("a"), vectors.vector_of(F.col("b"), 512).alias("b"))
    r = one.select(search.cosine(F.col("a"), vectors.unbind(vectors.bind(F.col("a"), F.col("b")), F.col("b"))).alias("s"), search.cosine(F.col("a"), F.col("b")).alias("t")).first()
    assert r.s > 0.6 and abs(r.t) < 0.2


def test_sequences(spark):
    names = ["a", "b", "c"]
    df = frame(spark, [tuple(names)], "x string, y string, z string").select(vectors.encode_sequence([F.col("x"), F.col("y"), F.col("z")], 1024).alias("s"))
    got = df.select(*[vectors.decode_position(F.col("s"), i, [*names, "d"], 1024).alias(f"p{i}") for i in range(3)]).first()
    assert list(got) == names


def test_replays_limits_and_heat(spark):
    rows = frame(spark, [("u", "2024-01-01 00:00:0%d" % i) for i in range(6)] + [("v", "2024-01-01 00:20:00")], "id string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert streams.fresh(rows, "ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).count() == 6
    assert set(values(streams.rate_limited(rows, "id", "ts", 5), "id")) == {"u"}
    r = frame(spark, [(99.0,)], "t double").select(thermal.touched(F.col("t")).alias("a"), thermal.cooled(F.col("t"), 100).alias("b"), thermal.touched(F.lit(1.0), True).alias("c")).first()
    assert tuple(r) == (100.0, 0.0, 6.0)


def test_backups(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    s = Store(spark)
    s.create("A")
    s.insert("A", RAM=1)
    world.backup(s, folder, "one")
    assert world.snapshots(spark, folder) == ["one"] and world.restore(spark, folder, "one").show("A")["properties"] == {"RAM": "1"}


def test_merge(spark):
    schema = "atom_id string, S string, E string, T double"
    local = frame(spark, [("a", "s", "old", 50.0), ("b", "s", "mine", 10.0)], schema)
    remote = frame(spark, [("a", "s", "new", 99.0), ("c", "s", "x", 80.0), ("z", "s", "cold", 0.001)], schema)
    assert sorted(values(merge.merge_atoms(local, remote), "atom_id", "E", "origin")) == [("a", "new", "remote"), ("b", "mine", "local"), ("c", "x", "remote")]
    names = "name string, key string, atom_id string, T double"
    kept = merge.merge_bindings(frame(spark, [("n", "k", "1", 5.0)], names), frame(spark, [("n", "k", "2", 5.0005), ("n", "j", "3", 1.0)], names))
    assert sorted(values(kept, "key", "atom_id")) == [("j", "3"), ("k", "1")]
    w = "world string, modified_at long"
    assert dict(values(merge.sync_direction(frame(spark, [("a", 1), ("b", 5), ("c", 2)], w), frame(spark, [("a", 2), ("c", 2), ("d", 1)], w)), "world", "action")) == {"a": "pull", "b": "push", "c": "none", "d": "pull"}


def test_streams(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = frame(spark, [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (2, "2024-01-01 00:00:10")], "id long, t string").withColumn("ts", F.col("t").cast("timestamp"))
    rows.write.parquet(f"{folder}/in")
    stream = streams.source(spark, f"{folder}/in", rows.schema)
    streams.journal(streams.deduplicated(stream, ["id"], "ts", "10 minutes"), f"{folder}/out", f"{folder}/state").awaitTermination()
    assert sorted(values(spark.read.parquet(f"{folder}/out"), "id")) == [1, 2]
    streams.compact(spark, f"{folder}/out", f"{folder}/small", "id", 1)
    assert spark.read.parquet(f"{folder}/small").count() == 2
    traces = frame(spark, [("k", 1, 0.5), ("k", 3, 0.9), ("k", 4, 0.01)], "key string, epoch long, r double")
    traces.write.parquet(f"{folder}/traces")
    query = streams.memory(streams.source(spark, f"{folder}/traces", traces.schema)).writeStream.format("memory").queryName("m").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/m").start()
    query.awaitTermination()
    want = search.memory(traces, 3).first()["M"]
    assert abs(spark.table("m").first()["M"] - want) < 1e-9


def test_compaction_and_transactions_of_the_log(spark):
    s = Store(spark)
    s.create("A", "B", "C")
    s.insert("A", RAM=1, Typ="x")
    s.insert("A", RAM=2)
    s.insert("B", RAM=5)
    s.connect("A", "B", "link")
    s.remove("A", "Typ")
    s.delete("C")
    s.begin()
    s.compact()
    s.update("A", "RAM", 9)
    s.rename("A", "Z")
    assert s.show("Z")["properties"] == {"RAM": "9"} and values(s.history("Z", "RAM"), "status", "v_text") == [("ARCHIVE", "1"), ("ARCHIVE", "2"), ("CURRENT", "9")]
    s.rollback()
    s.compact()
    assert values(s.history("A", "RAM"), "status", "v_text") == [("ARCHIVE", "1"), ("CURRENT", "2")] and values(s.history("A", "Typ"), "status") == ["DELETED"]
    assert sorted(values(s.names(), "name")) == ["A", "B"] and s.show("A")["relations"] == [("link", "B")]
    s.create("C")
    assert s.show("C")["properties"] == {} and s.hot(100).count() == 0 and values(s.project("A", RAM="num"), "RAM") == [2.0]
    before = values(s.wide().where("name = 'A'"), "TEMPERATURA")[0]
    s.show("A")
    assert values(s.wide().where("name = 'A'"), "TEMPERATURA")[0] == min(before + 10, 100)
    s.connect("A", "B", "link")
    s.disconnect("A", "B", "link")
    assert s.relations().count() == 0


def test_first_free_names(spark):
    s = Store(spark)
    s.create("A", "A_kopia_2", "Q", "Q_3")
    assert [values(s.clone(s.names().where("name = 'A'")), "name")[0] for _ in range(2)] == ["A_kopia", "A_kopia_3"]
    assert s.merge_on("Sku", "Q", x=1) == "Q_2" and s.merge_on("Sku", "Q", x=2) == "Q_2" and s.merge_on("Other", "Q", x=1) == "Q_4"
    rows = frame(spark, [("NIC", 1), (" null ", 2), (None, 3), ("R", 4)], "n string, v int")
    assert s.insert_rows(rows) == 1 and s.show("R")["properties"] == {"v": "4"}


def test_frames_snapshots_and_media_lists(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    atoms = frame(spark, [("a", 80.0), ("b", 1.0)], "atom_id string, T double")
    for at in (1, 2, 2):
        thermal.append_snapshot(atoms, at, f"{folder}/frames")
    frames = spark.read.parquet(f"{folder}/frames")
    assert frames.count() == 4 and values(thermal.search_frames(frames, in_state="HOT"), "tick", "atom_id") == [(1, "a"), (2, "a")]
    kinds = thermal.frame_kinds(frame(spark, [(t, a, 1.0) for t in range(40) for a in ("ab" if t < 20 else "abc")], "tick int, atom_id string, T double"))
    assert [r.tick for r in kinds.orderBy("tick").collect() if r.key] == [0, 17, 20, 37]
    with open(f"{folder}/x.bin", "wb") as f:
        f.write(b"x" * 5)
    blobs = media.read(spark, f"{folder}/x.bin")
    assert media.listing(blobs).columns == ["id", "path", "size"] and values(media.stat(blobs, blobs.first()["id"]), "size", "segments") == [(5, 1)]
    assert len(csv.to_pandas(atoms)) == 2
    with pytest.raises(ValueError):
        csv.to_pandas(atoms, 1)


def test_coverage_of_copies_and_odd_vectors(spark, monkeypatch):
    """Against a plain loop, over several blocks and tiles; copies and near copies make no pairs."""
    monkeypatch.setattr(search, "BLOCK", 300)
    monkeypatch.setattr(search, "TILE", 128)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1000, 6)) / 3
    x[100:400] = x[50] + rng.standard_normal((300, 6)) / 100
    x[400:600] = x[70]
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(1000), x, strict=True)]
    odd = [(-1, None), (-2, [1.0, None]), (-3, [float("nan")] * 6), (-4, [float("inf")] * 6), (-5, [float("inf")] * 6), (-6, []), (-7, []), (2000, [0.0, 1.0]), (2001, [0.0, 1.1])]
    df = frame(spark, rows + odd, "vec_id long, embedding array<double>")
    leaders, want = [], {-1: -1, -2: -2, -3: -3, -4: -4, -5: -5, -6: -7, -7: -7, 2000: 2000, 2001: 2000}
    for i, v in sorted(rows):
        lead = next((j for j, y in leaders if math.exp(-math.dist(v, y)) >= 0.6), i)
        leaders += [(i, v)] if lead == i else []
        want[i] = lead
    got = search.field_coverage(df).collect()
    assert len(got) == len(want) and {r.id: r.leader for r in got} == want
    assert search.field_coverage(df.where("false")).count() == 0


def test_what_grows_with_the_store_is_not_broadcast(spark):
    """Names compress to next to nothing in files, but not in the driver's memory."""
    def plan(df):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain()
        return out.getvalue()

    store = Store(spark)
    store.insert_rows(spark.range(50).select(F.concat(F.lit("e"), "id").alias("name"), F.col("id").alias("k")))
    # Nothing was ended, so no ends are joined.
    assert "Join" not in plan(store.table("props"))
    store.begin()
    store.delete(store.wide(k="num").where("k >= 40").select("name"))
    assert store.names().count() == 40 and store.wide(k="num").where("k IS NOT NULL").count() == 40
    assert "Broadcast" not in plan(store.wide(k="num")) and "Join" in plan(store.table("props"))
    assert store.clone(store.wide(k="num").where("k >= 30").select("name")).count() == 10
    store.compact()
    assert "Join" not in plan(store.table("props")) and store.wide(k="num").where("k IS NOT NULL").count() == 50
    store.rollback()
    assert store.names().count() == 50 and "Join" not in plan(store.table("props"))


def test_new_entities_are_read_as_they_were_written(spark):
    """The last row of a key is looked for only once a key can have several; a table of one file is dealt out."""
    def plan(df):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain()
        return out.getvalue()

    def single(store, table):
        return "Aggregate" not in plan(store.table(table))

    def content(store):
        return sorted(values(store.wide(k="num"), "name", "k"))

    conf = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(conf, "1b")
    try:
        store = Store(spark)
        store.insert_rows(spark.range(20).select(F.concat(F.lit("e"), "id").alias("name"), F.col("id").alias("k")).coalesce(1))
        assert all(len(spark.read.parquet(store.folders[t][0]).inputFiles()) > 1 for t in ("bubbles", "props"))
    finally:
        spark.conf.unset(conf)
    store.clone(store.wide(k="num").where("k >= 15").select("name"))
    store.clone(store.wide(k="num").where("k >= 18 AND name NOT LIKE '%kopia'").select("name"))
    want = sorted([(f"e{i}", float(i)) for i in range(20)] + [(f"e{i}_kopia", float(i)) for i in range(15, 20)] + [(f"e{i}_kopia_2", float(i)) for i in (18, 19)])
    assert content(store) == want and single(store, "props") and single(store, "bubbles") and "Join" not in plan(store.wide(k="num"))
    # Ended and made again: what was there before is not seen.
    store.begin()
    store.delete(store.names().where("name IN ('e1', 'e2')"))
    store.insert_rows(frame(spark, [("e1", 100)], "name string, k int"))
    assert content(store) == sorted([("e1", 100.0)] + [x for x in want if x[0] not in ("e1", "e2")]) and not single(store, "bubbles")
    store.compact()
    assert single(store, "props") and single(store, "bubbles") and store.names().count() == 26
    store.rollback()
    assert content(store) == want and single(store, "bubbles")
    # Set once more, heated, renamed, removed or taken over: the last row holds.
    for step in (
        lambda s: s.update("e3", "k", 3), lambda s: s.insert("e3", k=3), lambda s: s.excite(frame(spark, [("e3", 1.0)], "name string, energy double")), lambda s: s.set_rows(frame(spark, [("e3", 3)], "name string, k int")),
        lambda s: (s.rename("e3", "x"), s.rename("x", "e3")), lambda s: (s.rename_property("e3", "k", "j"), s.rename_property("e3", "j", "k")), lambda s: (s.remove("e3", "k"), s.insert("e3", k=3)),
        lambda s: s.load_tables({t: s.table(t) for t in ("bubbles", "props", "rels", "history")}),
    ):
        store.begin()
        step(store)
        assert content(store) == want and not single(store, "props")
        store.compact()
        assert content(store) == want and not single(store, "props") and single(store, "bubbles")
        store.rollback()
        assert single(store, "props")


def test_first_free_numbers(spark):
    """Gaps, repeated numbers, zero, and stems that are used but not wanted."""
    used = frame(spark, [("a", 1), ("a", 2), ("a", 4), ("b", 2), ("d", 0), ("d", 1), ("d", 1), ("d", 2), ("e", 0), ("e", 1)], "stem string, n int")
    got = first_free(frame(spark, [(x,) for x in "abcd"], "stem string"), used)
    assert sorted(values(got, "stem", "n")) == [("a", 3), ("b", 1), ("c", 1), ("d", 3)] and "Join" not in got._jdf.queryExecution().toString()
    store = Store(spark)
    for _ in range(2):  # as before, rows without a name make one nameless entity
        store.set_rows(frame(spark, [(None, 1), ("a", 1)], "name string, k int"))
    assert sorted(values(store.names(), "name"), key=str) == [None, "a"] and values(store.clone(store.names()), "name") == ["a_kopia"]


def test_similarity_of_few_probes(spark):
    """As surface_similarity; many short rows of one file are dealt out, and probes are worked out before the join."""
    names = ["large ring", "Large  RING ", "hot bolt", "", None, "10", "10.5", "a"]
    rows = frame(spark, [(i, x) for i, x in enumerate(names)], "id long, x string").coalesce(1)
    probes = frame(spark, [(x,) for x in names], "q string").withColumn("p", F.col("q"))
    got = search.with_surface_similarity(rows, probes, "x", "q")
    assert got.rdd.getNumPartitions() > 1
    want = rows.join(frame(spark, [(x,) for x in names], "p string"), F.lit(True)).withColumn("s", search.surface_similarity(F.col("x"), F.col("p")))
    key = lambda df: sorted(((r.id, r.p, r.s) for r in df.collect()), key=str)
    assert key(got) == key(want)


def test_recovery(spark):
    """As binding and unbinding in columns, also over batches with equal names and over several chunks."""
    rows = frame(spark, [(f"n{i % 300}" if i % 7 else None, "r" if i % 2 else "s") for i in range(650)], "a string, r string").coalesce(1)
    got = rows.select("a", "r", F.round(vectors.recovery(F.col("a"), F.col("r"), 64), 6).alias("s"))
    v = rows.distinct().select("a", "r", vectors.vector_of(F.col("a"), 64).alias("x"), vectors.vector_of(F.col("r"), 64).alias("y"))
    want = v.select("a", "r", F.round(search.cosine(F.col("x"), vectors.unbind(vectors.bind(F.col("x"), F.col("y")), F.col("y"))), 6).alias("s"))
    want = {(r.a, r.r): r.s for r in want.collect()}
    assert got.count() == 650 and all(abs(r.s - want[r.a, r.r]) < 2e-6 for r in got.collect())
