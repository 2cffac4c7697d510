"""Worlds: a store as Parquet, partitioned by region, with hot payloads apart from cold ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.operators.graph import regions, within
from amberline.operators.store import SCHEMAS, Store, columns
from amberline.operators.thermal import T_HOT


def save(store: Store, path: str) -> None:
    """`path` gets one folder a table; properties by region (the component of their entity) and heat."""
    for name in ("bubbles", "rels", "history"):
        store.table(name).write.mode("overwrite").parquet(f"{path}/{name}")
    own = store.names()
    region = regions(own, store.relations()).withColumn("ns", F.lit(store.ns))
    props = store.table("props").join(region, ["ns", "name"], "left").withColumn("region", F.coalesce("region", "name")).withColumn("hot", F.col("T") >= T_HOT)
    props.write.mode("overwrite").partitionBy("region", "hot").parquet(f"{path}/props")


def load(spark: SparkSession, path: str) -> Store:
    store = Store(spark)
    store.load_tables({name: spark.read.parquet(f"{path}/{name}").select(*columns(schema)) for name, schema in SCHEMAS.items()})
    return store


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """What is known without payloads: the columns of values are not read."""
    return spark.read.parquet(f"{path}/props").select("ns", "name", "key", "atom_id", "T", "region", "hot")


def unfold(spark: SparkSession, path: str, seed: str, radius: int = 2, ns: str = "DEFAULT") -> DataFrame:
    """The properties of entities within so many hops; only their regions' files are read."""
    rels = spark.read.parquet(f"{path}/rels").where(F.col("ns") == ns)
    bubbles = spark.read.parquet(f"{path}/bubbles").where(F.col("ns") == ns).select("name")
    near = within(rels, bubbles, [seed], radius).select("name")
    props = spark.read.parquet(f"{path}/props").where(F.col("ns") == ns)
    return props.join(near, "name", "left_semi").drop("region", "hot")


def backup(store: Store, folder: str, label: str) -> str:
    path = f"{folder}/{label}"
    save(store, path)
    return path


def snapshots(spark: SparkSession, folder: str) -> list[str]:
    """The labels of a folder's backups."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    return sorted(i.base_name for i in files.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.Directory)


def restore(spark: SparkSession, folder: str, label: str) -> Store:
    return load(spark, f"{folder}/{label}")
