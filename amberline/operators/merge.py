"""Merging replicas: the hotter one wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How much hotter wins, and below which temperature a remote atom counts for nothing.
BIAS, T_IGNORED = 0.001, 0.01


def _digest(side: str):
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit("")).alias(c) for c in ("atom_id", "S", "E", "T")])), 256)


def merge_atoms(local: DataFrame, remote: DataFrame) -> DataFrame:
    """atom_id, S, E, T of both, with `origin`. The hotter of two wins if it is so by more than BIAS; within that, the
    larger digest of its content; remote atoms under T_IGNORED are passed over."""
    columns = ["atom_id", "S", "E", "T"]
    pairs = local.select(columns).alias("l").join(remote.where(F.col("T") >= T_IGNORED).select(columns).alias("r"), F.col("l.atom_id") == F.col("r.atom_id"), "full")
    close = F.abs(F.col("r.T") - F.col("l.T")) <= BIAS
    wins = F.col("l.atom_id").isNull() | (F.col("r.T") > F.col("l.T") + BIAS) | (close & (_digest("r") > _digest("l")))
    wins = F.coalesce(F.col("r.atom_id").isNotNull() & wins, F.lit(False))
    return pairs.select(*[F.when(wins, F.col(f"r.{c}")).otherwise(F.col(f"l.{c}")).alias(c) for c in columns], F.when(wins, "remote").otherwise("local").alias("origin"))


def merge_bindings(local: DataFrame, remote: DataFrame) -> DataFrame:
    """name, key, atom_id, T of both: of two bindings of one key the remote wins only if its atom is hotter."""
    l, r = local.select("name", "key", "atom_id", "T").alias("l"), remote.select("name", "key", "atom_id", "T").alias("r")
    pairs = l.join(r, (F.col("l.name") == F.col("r.name")) & (F.col("l.key") == F.col("r.key")), "full")
    wins = F.col("l.name").isNull() | F.coalesce(F.col("r.T") > F.col("l.T") + BIAS, F.lit(False))
    return pairs.select(*[F.when(wins, F.col(f"r.{c}")).otherwise(F.col(f"l.{c}")).alias(c) for c in ("name", "key", "atom_id", "T")])


def missing(local: DataFrame, remote: DataFrame, on: list[str]) -> DataFrame:
    """What the remote has and the local lacks."""
    return remote.join(local.select(*on).distinct(), on, "left_anti")


def sync_direction(local: DataFrame, remote: DataFrame) -> DataFrame:
    """world and action (pull, push or none) of tables (world, modified_at): the newer one is copied."""
    pairs = local.alias("l").join(remote.alias("r"), "world", "full")
    a, b = F.col("l.modified_at"), F.col("r.modified_at")
    return pairs.select("world", F.when(a.isNull() | (b > a), "pull").when(b.isNull() | (a > b), "push").otherwise("none").alias("action"))


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of both; values of `changes` that are not null replace those of `base`. Columns are those of base."""
    pairs = base.alias("b").join(changes.alias("c"), F.col(f"b.{key}") == F.col(f"c.{key}"), "full")
    have = set(changes.columns)
    return pairs.select(*[(F.coalesce(F.col(f"c.{c}"), F.col(f"b.{c}")) if c in have else F.col(f"b.{c}")).alias(c) for c in base.columns])
