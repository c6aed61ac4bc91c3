"""Helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of characters other than space and the control characters from tab to carriage return.
BLANKS = " \t\n\x0b\f\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

# A table is broadcast by a hint only if it has been counted and is not longer than this.
MAX_BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, for intermediate tables and files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"


def settled(df: DataFrame) -> DataFrame:
    """The rows of `df`, written to the shared checkpoint folder; lineage ends there, so a lost executor costs nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """`df` without columns of these names (in any case): an operator's own output columns replace them."""
    lowered = {name.lower() for name in names}
    return df.select(*(F.col(f"`{name}`") for name in df.columns if name.lower() not in lowered))


def neutral(docs: DataFrame, used: Iterable[str]) -> DataFrame:
    """`docs` with all columns but the `used` ones named by their places, so that none clashes with an operator's own.

    `toDF(*docs.columns)` gives the names back to a result with the same columns in the same order.
    """
    return docs.toDF(*(name if name in used else f"_column{place}" for place, name in enumerate(docs.columns)))


def word_count(text: Column) -> Column:
    """Number of words (bigint); 0 for NULL."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, BLANK_CLASS + "+"))).cast("long")


def small_broadcast(df: DataFrame) -> DataFrame:
    """`df`, which must be settled, with a broadcast hint if it is short; else Spark joins it by shuffling."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


def give_back() -> None:
    """At the end of a task: what a Python worker has freed goes back to the system, for the stages that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
