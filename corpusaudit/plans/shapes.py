"""Plan building blocks used by several operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; a temporary one only where none is set and Spark is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share. Its maker deletes what is written there."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so that lost executors cost no restart."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def compact(df: DataFrame, rows_per_task: int = 100_000) -> DataFrame:
    """A checkpoint read in as few tasks as its rows need, so that rounds over small tables don't leave files for every shuffle partition."""
    fixed = checkpoint(df)
    return fixed.coalesce(fixed.count() // rows_per_task + 1)


def swept(df: DataFrame) -> DataFrame:
    """``df``, after the driver's garbage is collected. A job of many rounds leaves plans, metrics and broadcasts behind; a heap that is never swept grows to all it may take, whatever is in use.

    Spark then also drops the shuffles, broadcasts and checkpoints that nobody refers to any more.
    """
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def dealt(df: DataFrame, key: str, rows_per_task: int = 25_000) -> DataFrame:
    """Rows dealt by their key over as many tasks as there are rows for, one per core at least: a small file of many short rows is read in one or two, however costly a row is."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, df.count() // rows_per_task + 1)
    return df.repartition(tasks, key)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, number: str | None = None) -> DataFrame:
    """First ``k`` rows per key.

    The filter sits directly on the row number, so Spark trims every map partition to ``k`` rows
    per key before the shuffle; a hot key therefore never reaches one task whole.
    """
    n = number or "_position"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(n, F.row_number().over(w)).filter(F.col(n) <= k)
    return out if number else out.drop(n)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    return top_k(df, keys, order, 1)


NO_ORDER = "several different rows of one key: name the column that gives their order"


def in_turn(patch: DataFrame, keys: list[str], cols: list[str], order: str | None = None, first: bool = False, skip=None) -> DataFrame:
    """One row per key from patches applied in turn: per column the last value that is not null, or the first.

    ``order`` is the column that gives the turn; of equal turns the greater value counts as later. Rows have no order of their own, so without
    ``order`` a key may not have different patches: the query fails on them. ``skip`` marks further values as absent.
    """
    absent = (lambda c: c.isNull()) if skip is None else skip
    if order is None:
        return _single(patch, keys, cols)
    pick = F.min_by if first else F.max_by
    return patch.groupBy(*keys).agg(*[pick(F.col(c), F.when(~absent(F.col(c)), F.struct(order, c))).alias(c) for c in cols])


def last_rows(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The last row of every key in the turn that ``order`` gives, by its other values on ties; without ``order`` a key may not have different rows."""
    if order is None:
        return _single(rows, keys, [c for c in rows.columns if c not in keys]).select(*rows.columns)
    return latest(rows, keys, [F.desc(order), F.xxhash64(*rows.columns)])


def _single(rows: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    whole = F.struct(*cols)
    met = rows.groupBy(*keys).agg(F.min(whole).alias("_low"), F.max(whole).alias("_high"))
    one = F.when(F.col("_low").eqNullSafe(F.col("_high")), F.col("_low")).otherwise(F.raise_error(F.lit(NO_ORDER)).cast(met.schema["_low"].dataType))
    return met.select(*keys, one.alias("_one")).select(*keys, *[F.col("_one")[c].alias(c) for c in cols])


def with_row_number(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Number all rows 1..n in the given order without collecting them into one task.

    Rows are range-partitioned and sorted, the layout is fixed by a checkpoint, and the
    partition sizes (one row per partition) give each partition its offset.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = checkpoint(ordered.withColumn("_slot", F.monotonically_increasing_id()))
    part = F.shiftright("_slot", 33)
    sizes = fixed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    # One row per partition of the sort: bounded by the number of shuffle partitions.
    numbered = fixed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    inside = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(name, (F.col("_offset") + inside + 1).cast("long")).drop("_slot", "_part", "_offset")


def number_in_groups(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Number the rows of every group 1, 2, ... in the given order without gathering a group in one task.

    Rows are range-partitioned by (keys, order) and fixed by a checkpoint, so a large group spans many tasks. A partition continues at most one
    group of earlier partitions: one row per partition holds what came before, whatever the number of groups.
    """
    fixed = checkpoint(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()))
    placed = fixed.withColumn("_piece", F.shiftright("_at", 33))
    inside = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_piece", *keys).orderBy("_at")))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*keys, "_piece").agg(F.count("*").alias("_rows"))
    offsets = sizes.withColumn("_before", F.sum("_rows").over(before)).filter("_before IS NOT NULL").select(
        F.col("_piece").alias("_in"), "_before", *[F.col(k).alias(f"_key_{k}") for k in keys])
    same = F.col("_piece") == F.col("_in")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return inside.join(F.broadcast(offsets), same, "left").select(*df.columns, (F.col("_n") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))


def pick_rows(few: DataFrame, wide: DataFrame, on: str | list[str], shown: dict[str, Column] | None = None, most: int = 1_000_000) -> DataFrame:
    """Rows of ``wide`` whose key is in ``few``, joined to it, without shuffling the long columns of ``wide`` for it.

    ``few`` is fixed and counted first: up to ``most`` rows (keys and short columns) are broadcast. Beyond, the rows meet in a shuffle, in which Spark's
    runtime Bloom filter drops the others before they are written. ``shown`` are the columns wanted of ``wide``: computed for the picked rows only where
    those are broadcast to it, and else before the shuffle, so that what they are computed from stays where it is.
    """
    fixed, keys = checkpoint(few), [on] if isinstance(on, str) else on
    small = fixed.count() <= most
    side = F.broadcast(fixed) if small else fixed
    if shown is None:
        return wide.join(side, on)
    values = [v.alias(k) for k, v in shown.items()]
    if not small:
        return wide.select(*keys, *values).join(side, on)
    return wide.join(side, on).select(*keys, *[c for c in fixed.columns if c not in keys], *values)


def with_group_size(df: DataFrame, keys: str | list[str], name: str) -> DataFrame:
    """Attach the size of each row's group by a pre-aggregated count, never by a window over the group."""
    on = [keys] if isinstance(keys, str) else keys
    sizes = df.groupBy(*on).agg(F.count("*").alias(name))
    return df.join(sizes, on)


def align(df: DataFrame, schema) -> DataFrame:
    """Columns of ``schema`` in order, missing ones as typed nulls."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema.fields])
