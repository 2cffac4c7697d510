"""Temperature: decay, states, collection by reachability, and the time series of ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
T_INIT, DECAY, T_HOT, T_WARM, T_COLD, T_MAX = 50.0, 0.92, 70.0, 30.0, 2.0, 100.0
HEAT_READ, HEAT_WRITE, KEYFRAME_EVERY = 10.0, 5.0, 16


def clamped(t: Column) -> Column:
    return F.least(F.greatest(t, F.lit(0.0)), F.lit(T_MAX))


def decayed(t: Column, ticks) -> Column:
    return clamped(t * F.pow(F.lit(DECAY), ticks if isinstance(ticks, Column) else F.lit(ticks)))


def heated(t: Column, by=HEAT_READ) -> Column:
    return clamped(t + by)


def cooled(t: Column, by: float) -> Column:
    return clamped(t - by)


def touched(t: Column, writing: bool = False) -> Column:
    """After a read or a write."""
    return heated(t, HEAT_WRITE if writing else HEAT_READ)


def killed() -> Column:
    return F.lit(0.0)


def state(t: Column) -> Column:
    return F.when(t >= T_HOT, "HOT").when(t >= T_WARM, "WARM").when(t >= T_COLD, "COLD").otherwise("TOMB")


def tick(atoms: DataFrame, n: int, reachable: DataFrame | None = None, resonant: DataFrame | None = None) -> DataFrame:
    """Atoms (atom_id, T, ...) after n ticks, with state and `retained`. One that is under T_COLD goes, unless it is
    reachable or resonant (tables with atom_id), which retains it."""
    after = atoms.withColumn("T", decayed(F.col("T"), n)).withColumn("state", state(F.col("T")))
    keep = None
    for table in (reachable, resonant):
        if table is not None:
            ids = table.select("atom_id").distinct()
            keep = ids if keep is None else keep.union(ids).distinct()
    if keep is None:
        return after.where(F.col("T") >= T_COLD).withColumn("retained", F.lit(False))
    marked = after.join(keep.withColumn("_kept", F.lit(True)), "atom_id", "left")
    alive = F.col("T") >= T_COLD
    return marked.where(alive | F.col("_kept").isNotNull()).withColumn("retained", ~alive).drop("_kept")


def orphans(atoms: DataFrame, bindings: DataFrame) -> DataFrame:
    """Atoms that nothing binds."""
    return atoms.join(bindings.select("atom_id").distinct(), "atom_id", "left_anti")


def stats(atoms: DataFrame) -> DataFrame:
    t = F.col("T")
    return atoms.agg(F.count("*").alias("atoms"), F.count_if(t >= T_HOT).alias("hot"), F.count_if((t >= T_WARM) & (t < T_HOT)).alias("warm"), F.count_if((t >= T_COLD) & (t < T_WARM)).alias("cold"), F.count_if(t < T_COLD).alias("tomb"))


def census(atoms: DataFrame, retained: DataFrame | None = None) -> DataFrame:
    """One row: atoms alive and dead (under T_COLD), and how many of the dead a table of atom_id retains."""
    dead = F.col("T") < T_COLD
    if retained is None:
        kept = F.lit(0).cast("long")
    else:
        atoms = atoms.join(retained.select("atom_id").distinct().withColumn("_kept", F.lit(True)), "atom_id", "left")
        kept = F.count_if(dead & F.col("_kept").isNotNull())
    return atoms.agg(F.count_if(~dead).alias("alive"), F.count_if(dead).alias("dead"), kept.alias("retained"))


# --- frames: (tick, atom_id, T, ...) -------------------------------------------------------------------------------


def as_of(frames: DataFrame, at: int | Column) -> DataFrame:
    """Each atom's row at the latest tick up to `at` (a number or a column) at which it was recorded."""
    rest = [c for c in frames.columns if c != "atom_id"]
    last = frames.where(F.col("tick") <= at).groupBy("atom_id").agg(F.max_by(F.struct(*rest), "tick").alias("r"))
    return last.select("atom_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def timeline(frames: DataFrame, atom_id) -> DataFrame:
    return frames.where(F.col("atom_id") == atom_id).orderBy("tick")


def envelopes(frames: DataFrame) -> DataFrame:
    return frames.groupBy("tick").agg(F.min("T").alias("T_min"), F.max("T").alias("T_max"), F.count("*").alias("atoms"))


def ticks_in_range(frames: DataFrame, low: float, high: float) -> DataFrame:
    """Ticks whose temperatures from least to greatest overlap the range."""
    return envelopes(frames).where((F.col("T_max") >= low) & (F.col("T_min") <= high))


def state_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("tick", state(F.col("T")).alias("state")).agg(F.count("*").alias("atoms"))


def deltas(frames: DataFrame) -> DataFrame:
    """Change of each atom since its last frame; `key` marks its first and every KEYFRAME_EVERY-th frame."""
    w = Window.partitionBy("atom_id").orderBy("tick")
    n = F.row_number().over(w) - 1
    return frames.withColumn("key", n % KEYFRAME_EVERY == 0).withColumn("dT", F.col("T") - F.lag("T").over(w))


def frame_kinds(frames: DataFrame) -> DataFrame:
    """tick and key: whether a tick's frame is written whole. That is so for the first, after KEYFRAME_EVERY frames of
    changes, and wherever the set of atoms is another than in the frame before. One row for each tick is put in order."""
    ids = frames.groupBy("tick").agg(F.count("*").alias("n"), F.sum(F.xxhash64("atom_id").cast("decimal(38,0)")).alias("set"))
    order = Window.orderBy("tick")
    same = F.lag("n").over(order).eqNullSafe(F.col("n")) & F.lag("set").over(order).eqNullSafe(F.col("set"))
    runs = ids.withColumn("_run", F.sum(F.when(same, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("_run").orderBy("tick")) - 1
    return runs.select("tick", (place % (KEYFRAME_EVERY + 1) == 0).alias("key"))


def snapshot(atoms: DataFrame, at: int) -> DataFrame:
    """The frame of a tick: tick, atom_id, T and state of every atom."""
    return atoms.select(F.lit(at).alias("tick"), "atom_id", "T", state(F.col("T")).alias("state"))


def append_snapshot(atoms: DataFrame, at: int, path: str) -> None:
    """Append a tick's frame to a folder of frames, parted by tick; a tick that is written again replaces itself."""
    snapshot(atoms, at).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tick").parquet(path)


def search_frames(frames: DataFrame, low: float = 0.0, high: float = T_MAX, in_state: str | None = None, limit: int | None = 100) -> DataFrame:
    """Rows of frames within a range of temperature and in a state, hottest first, then by tick and atom."""
    found = frames.where(F.col("T").between(low, high))
    found = found.where(state(F.col("T")) == in_state) if in_state else found
    found = found.orderBy(F.col("T").desc(), "tick", "atom_id")
    return found.limit(limit) if limit is not None else found


def chained(frames: DataFrame) -> DataFrame:
    """One row for each tick with the digest of its frame and of the one before: `previous`. The digest of a frame does
    not depend on the order of its rows; the ticks are few next to the rows and are linked in one order."""
    row = F.xxhash64("atom_id", F.round("T", 9)).cast("decimal(38,0)")
    frame = frames.groupBy("tick").agg(F.sha2(F.concat_ws(":", F.col("tick").cast("string"), F.count("*").cast("string"), F.sum(row).cast("string")), 256).alias("digest"))
    return frame.withColumn("previous", F.lag("digest").over(Window.orderBy("tick")))


def broken_links(chain: DataFrame, frames: DataFrame) -> DataFrame:
    """Ticks whose stored digests do not follow from the frames."""
    fresh = chained(frames)
    joined = chain.alias("a").join(fresh.alias("b"), "tick", "full")
    return joined.where(~(F.col("a.digest").eqNullSafe(F.col("b.digest")) & F.col("a.previous").eqNullSafe(F.col("b.previous")))).select("tick")
