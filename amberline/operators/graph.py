"""Graph operators on an edge table (source, relation, target). Loops run on the driver; each round is a join whose
result is written, so that lineage stays short and lost executors cost one round."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberline.tables import discard, materialise


def neighbours(rels: DataFrame, name: str) -> DataFrame:
    """Distinct neighbours over edges of either direction."""
    out = rels.where(F.col("source") == name).select(F.col("target").alias("name"))
    return out.unionByName(rels.where(F.col("target") == name).select(F.col("source").alias("name"))).distinct()


def find_by_relation(rels: DataFrame, relation: str, target: str) -> DataFrame:
    return rels.where((F.col("relation") == relation) & (F.col("target") == target)).select(F.col("source").alias("name")).distinct()


def hops(rels: DataFrame, seeds: DataFrame, radius: int | None, directed: bool = False) -> DataFrame:
    """name and hops (shortest distance from any seed, seeds 0) within the radius; None: however far."""
    steps = rels.select(F.col("source").alias("a"), F.col("target").alias("b"))
    steps = steps if directed else steps.unionByName(steps.select(F.col("b").alias("a"), F.col("a").alias("b")))
    steps = materialise(steps.where("a <> b").distinct(), "steps")
    seen = materialise(seeds.select(F.col(seeds.columns[0]).alias("name")).distinct().withColumn("hops", F.lit(0)), "hops")
    at = 0
    while radius is None or at < radius:
        frontier = seen.where(F.col("hops") == at).select(F.col("name").alias("a"))
        new = steps.join(frontier, "a").select(F.col("b").alias("name")).distinct().join(seen, "name", "left_anti")
        new = materialise(new.withColumn("hops", F.lit(at + 1)), "hops")
        if new.isEmpty():
            break
        seen, at = seen.unionByName(new), at + 1
    return seen


def within(rels: DataFrame, nodes: DataFrame, seeds: list[str], radius: int) -> DataFrame:
    """Undirected search from the seeds that exist; the seeds are part of the result."""
    known = nodes.select(F.col(nodes.columns[0]).alias("name")).where(F.col("name").isin(seeds))
    return hops(rels, known, radius)


def reachable(rels: DataFrame, roots: DataFrame) -> DataFrame:
    """What the roots reach along edges, roots included."""
    return hops(rels, roots, None, directed=True).select("name")


def activation(rels: DataFrame, start: str, energy: float, relation: str | None = None) -> DataFrame:
    """name and energy: half of it is left after each hop outwards, and what is under 1 does not arrive."""
    if energy < 1:
        return rels.select(F.col("source").alias("name"), F.lit(0.0).alias("energy")).limit(0)
    edges = rels.where(F.col("relation") == relation) if relation else rels
    seed = rels.sparkSession.createDataFrame([(start,)], "name string")
    reach = hops(edges, seed, int(math.floor(math.log2(energy))), directed=True)
    return reach.select("name", (F.lit(float(energy)) * F.pow(F.lit(0.5), F.col("hops"))).alias("energy"))


# --- connected components ------------------------------------------------------------------------------------------


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them. Edges have a > b here."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for each node of edges (a, b) that is not a root itself.

    Alternates large and small stars, whose rounds grow with the logarithm of a component's size, until nothing changes.
    Each round is written and read again. Edges may repeat or point both ways; loops count for nothing; no edges give no
    rows.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _are_stars(edges):
        last, edges = edges, materialise(_small_star(_large_star(edges)), "edges")
        discard(last)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge and leads to one that has none. Ends at the first that does not."""
    several = edges.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("n")).where("m <> n").select("a")
    between = edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi")
    return several.unionByName(between).isEmpty()


def regions(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """name and region: the smallest name of its component. Edges to unknown nodes count for nothing."""
    names = nodes.select(F.col(nodes.columns[0]).alias("name")).distinct()
    known = rels.join(names.select(F.col("name").alias("source")), "source", "left_semi").join(names.select(F.col("name").alias("target")), "target", "left_semi")
    roots = components(known.select(F.col("source").alias("a"), F.col("target").alias("b")))
    return names.join(roots, names["name"] == roots["node"], "left").select("name", F.coalesce("root", "name").alias("region"))


def atom_regions(bindings: DataFrame, region_of: DataFrame) -> DataFrame:
    """atom_id and region of the atoms that are bound in exactly one region. bindings: name, atom_id."""
    pairs = bindings.join(region_of, "name").groupBy("atom_id").agg(F.min("region").alias("region"), F.max("region").alias("_last"))
    return pairs.where(F.col("region") == F.col("_last")).select("atom_id", "region")
