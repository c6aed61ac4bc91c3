"""Joins, rankings and cuts that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from keyspan.functions.expressions import null_safe


# Keys treated as hot at once. Lists of them, with a row or a few for each, are short enough to be broadcast. A key that
# has no place among so many larger ones holds at most a 10,000th of all rows and is left to the ordinary path.
HOT_KEYS = 10_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    It is the folder the session names in ``spark.checkpoint.dir``, else a subfolder of the warehouse, which
    all nodes of a cluster see as well.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int, total: int | None = None) -> DataFrame | None:
    """The largest keys with more than ``hot_rows`` rows, checkpointed; None if there are none.

    A table that has no more rows in all (``total``, counted if unknown, which reads no column) has no hot key. Else
    rows are counted by key with a combine before the shuffle, so a hot key costs no more than any other here.
    """
    if (df.count() if total is None else total) <= hot_rows:
        return None
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows)
    hot = checkpointed(sizes.orderBy(F.col("_rows").desc(), *keys).limit(HOT_KEYS).select(*keys))
    return None if hot.isEmpty() else hot


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of hot keys) for a list of hot keys of bounded length."""
    listed = F.broadcast(hot.select(*[F.col(key).alias("_hot_" + key) for key in keys]))
    condition = null_safe(keys, "_hot_")
    return df.join(listed, condition, "left_anti"), df.join(listed, condition, "left_semi")


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """Left join a one-row-per-key table; NULL keys match NULL keys.

    ``small`` says that the caller has checked the table's size; otherwise Spark picks the join.
    """
    other = table.withColumnsRenamed({key: "_key_" + key for key in keys})
    joined = df.join(F.broadcast(other) if small else other, null_safe(keys, "_key_"), "left")
    return joined.drop(*["_key_" + key for key in keys])


def attach_uneven(df: DataFrame, table: DataFrame, keys: Sequence[str], size: str, top: int) -> DataFrame:
    """Left join a one-row-per-key table with too many keys to broadcast, whatever the skew.

    The ``top`` largest keys (column ``size`` counts their rows) are broadcast, and the rows of the
    others are shuffled. A key outside the top ``top`` holds at most 1/``top`` of all rows, so no
    shuffle partition can be swamped by one key. The table is used several times, so it is checkpointed
    instead of being computed again for each use.
    """
    table = checkpointed(table)
    largest = table.orderBy(F.col(size).desc(), *keys).limit(top)
    light, heavy = split_hot(df, keys, largest.select(*keys))
    light_table, _ = split_hot(table, keys, largest.select(*keys))
    return attach(heavy, largest, keys, small=True).unionByName(attach(light, light_table, keys, small=False))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Row number within ``keys`` for groups that fit one task each."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window))


def ranked_hot(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Row number within ``keys`` for groups too large for one task.

    Rows are range-partitioned by (keys, order), so one group spreads over many partitions. The rank is
    the rank inside the partition plus the group's rows in earlier partitions. The order must be unique
    inside a group. The partitioned rows are checkpointed because both halves must see the same
    partitions, also after an executor is lost. There are no more offsets than partitions and hot keys with their
    few subgroups together, so they are broadcast.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(partitions, *[F.col(key).asc() for key in keys], *order)
    placed = checkpointed(spread.withColumn("_part", F.spark_partition_id()))
    place = [*keys, "_part"]
    # One row per (group, partition): no more than partitions plus groups.
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*place)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    local = ranked(placed, place, order, "_local")
    return (
        attach(local, offsets, place, small=True)
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("long"))
        .drop("_local", "_offset", "_part")
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, hot_rows: int, total: int | None = None
) -> DataFrame:
    """Row number within ``keys``: windowed for ordinary keys, range-partitioned for hot ones."""
    hot = hot_keys(df, keys, hot_rows, total)
    ordinary, large = (df, None) if hot is None else split_hot(df, keys, hot)
    numbered = ranked(ordinary, keys, order, out).withColumn(out, F.col(out).cast("long"))
    return numbered if large is None else numbered.unionByName(ranked_hot(large, keys, order, out))
