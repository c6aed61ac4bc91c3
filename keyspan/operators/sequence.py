"""Numbering events outwards from the key event and dropping small groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keyspan.config import DEFAULT, INTERVAL_KEYS, LABEL_KEYS, AnalysisConfig
from keyspan.functions.expressions import is_fixation, is_saccade
from keyspan.functions.skew import attach, ranked, ranked_hot

KEY, BEFORE, AFTER = "key", "before", "after"
SEQUENCE_KEYS = (*LABEL_KEYS, "Event_type", "_side")


def side() -> Column:
    """Where an event lies: it is the key event, ends before it starts, or starts after it starts.

    NULL for an event that overlaps the key event without being it.
    """
    is_key = (F.col("Start") == F.col("KeyEventStart")) & (F.col("Stop") == F.col("KeyEventStop"))
    return (
        F.when(is_key, KEY)
        .when(F.col("Stop") <= F.col("KeyEventStart"), BEFORE)
        .when(F.col("Start") > F.col("KeyEventStart"), AFTER)
    )


def _outwards() -> list[Column]:
    """Nearest to the key event first: latest stop before it, earliest start after it."""
    distance = F.when(F.col("_side") == BEFORE, -F.col("Stop")).otherwise(F.col("Start"))
    return [distance.asc(), F.col("Start").asc_nulls_last(), F.col("RowId").asc()]


def _numbered(df: DataFrame, rank: Column) -> DataFrame:
    # Long, because a group may hold more events than an int can count.
    rank = rank.cast("long")
    place = F.col("_side")
    number = F.when(place == KEY, F.lit(0).cast("long")).when(place == BEFORE, -rank).when(place == AFTER, rank)
    return df.withColumns(
        {"FixationSequence": F.when(is_fixation(), number), "SaccadeSequence": F.when(is_saccade(), number)}
    )


def sequence_events(aligned: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Add FixationSequence and SaccadeSequence: 0 for the key event, -1, -2, .. before, 1, 2, .. after."""
    placed = aligned.withColumn("_side", side())
    numbered = _numbered(ranked(placed, SEQUENCE_KEYS, _outwards(), "_rank"), F.col("_rank"))
    return numbered.select(*aligned.columns, "FixationSequence", "SaccadeSequence")


def sequence_events_hot(aligned: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """As :func:`sequence_events` for hot intervals, whose rows are range-partitioned and stored once."""
    placed = aligned.withColumn("_side", side())
    numbered = _numbered(ranked_hot(placed, SEQUENCE_KEYS, _outwards(), "_rank"), F.col("_rank"))
    return numbered.select(*aligned.columns, "FixationSequence", "SaccadeSequence")


def unified_sequence() -> Column:
    return F.coalesce(F.col("FixationSequence"), F.col("SaccadeSequence"))


def with_group_size(df: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Add ``GroupRows``: the aligned rows of the same label and interval, of whatever event type."""
    return df.withColumn("GroupRows", F.count(F.lit(1)).over(Window.partitionBy(*LABEL_KEYS)))


def with_group_size_hot(df: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """As :func:`with_group_size` for hot intervals: sizes are aggregated and broadcast.

    There are at most ten relevant labels per hot interval, and the number of those is bounded.
    """
    sizes = df.groupBy(*LABEL_KEYS).agg(F.count(F.lit(1)).alias("GroupRows"))
    return attach(df, sizes, LABEL_KEYS, small=True)


def large_groups(sized: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return sized.filter(F.col("GroupRows") >= cfg.min_rows).drop("GroupRows")


def min_group_size(seqd: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Keep the labels of an interval that have enough rows."""
    return large_groups(with_group_size(seqd, cfg), cfg)


def sequence_of(seqd: DataFrame, event_type: str) -> DataFrame:
    """The events of one type with their number as ``Sequence``."""
    return seqd.filter(F.col("Event_type") == event_type).select(
        "RowId", *INTERVAL_KEYS, "TOI", "Start", "Stop", unified_sequence().alias("Sequence")
    )


def group_sizes(keyed: DataFrame, aligned: Column) -> DataFrame:
    """Rows of each label and interval, before and after alignment."""
    return keyed.groupBy(*LABEL_KEYS).agg(
        F.count(F.lit(1)).alias("_input"), F.count_if(F.coalesce(aligned, F.lit(False))).alias("_aligned")
    )


def stage_counts(keyed: DataFrame, aligned: Column, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Rows at each stage, from one pass over the keyed rows. Sequencing keeps every row."""
    size = F.col("_aligned")
    totals = group_sizes(keyed, aligned).agg(
        F.coalesce(F.sum("_input"), F.lit(0)).alias("input"),
        F.coalesce(F.sum(size), F.lit(0)).alias("aligned"),
        F.coalesce(F.sum(size), F.lit(0)).alias("sequenced"),
        F.coalesce(F.sum(F.when(size >= cfg.min_rows, size)), F.lit(0)).alias("final"),
    )
    return totals.unpivot([], ["input", "aligned", "sequenced", "final"], "Stage", "Rows")


def interval_counts(keyed: DataFrame, aligned: Column, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Distinct (interval, label) groups before and after the size filter."""
    size = F.col("_aligned")
    totals = group_sizes(keyed, aligned).agg(
        F.count_if(size > 0).alias("sequenced"), F.count_if(size >= cfg.min_rows).alias("final")
    )
    return totals.unpivot([], ["sequenced", "final"], "Stage", "Groups")
