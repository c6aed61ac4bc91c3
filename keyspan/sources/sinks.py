"""Writing one series of points per participant or recording."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from keyspan.sources.files import folders_in, is_there, remove


def write_profile_series(
    series: DataFrame, path: str, entity: str, buckets: int | None = None, mode: str = "error"
) -> None:
    """Write profile points as Parquet, one folder and file per entity.

    A series has a few dozen points per entity, so gathering an entity in one task is cheap. With very
    many entities, ``buckets`` folders are written instead, each with whole entities in sorted order:
    the file count stays fixed and a reader still finds an entity by its bucket and row-group statistics.
    """
    if buckets is None:
        placed, folder = series, entity
    else:
        placed, folder = series.withColumn("Bucket", F.pmod(F.xxhash64(entity), F.lit(buckets))), "Bucket"
    ordered = placed.repartition(folder).sortWithinPartitions(folder, entity, "Event_type", "Sequence")
    ordered.write.mode(mode).partitionBy(folder).parquet(path)


def replace_profile_series(
    series: DataFrame, path: str, entity: str, buckets: int | None = None, keep: int = 2
) -> str:
    """Write a series in place of the one at ``path``, whole or not at all; returns the folder of its files.

    Each run writes a folder of its own, and a mark (one row of a small table) only after that folder is
    complete. Readers follow the newest mark, so a run that is killed at any moment leaves the old series, and
    a rerun replaces it: entities that are gone from the data are gone from the series. The newest ``keep``
    series stay, for readers that have begun; older ones and those of killed runs are removed. One
    writer at a time. A series without rows replaces as well.
    """
    spark = series.sparkSession
    run = uuid.uuid4().hex
    write_profile_series(series, f"{path}/runs/{run}", entity, buckets)
    done = _marks(spark, path)
    number = 1 + (done[0]["Number"] if done else 0)
    mark = spark.range(1, numPartitions=1).select(
        F.lit(number).cast("long").alias("Number"), F.lit(run).alias("Run"), F.lit(series.schema.json()).alias("Schema")
    )
    mark.write.mode("append").parquet(f"{path}/marks")
    kept = {run, *[old["Run"] for old in done[: keep - 1]]}
    for name in folders_in(spark, f"{path}/runs"):
        if name not in kept:
            remove(spark, f"{path}/runs/{name}")
    return f"{path}/runs/{run}"


def read_profile_series(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete series at ``path``, with the columns and types that it was written with."""
    done = _marks(spark, path)
    if not done:
        raise FileNotFoundError(f"no complete series at {path}")
    schema = T.StructType.fromJson(json.loads(done[0]["Schema"]))
    return spark.read.schema(schema).parquet(f"{path}/runs/{done[0]['Run']}").select(*schema.names)


def _marks(spark: SparkSession, path: str, most: int = 100) -> list[Row]:
    """The newest marks first."""
    if not is_there(spark, f"{path}/marks/_SUCCESS"):
        return []
    return spark.read.parquet(f"{path}/marks").orderBy(F.col("Number").desc(), "Run").limit(most).collect()
