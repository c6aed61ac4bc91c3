"""The key events themselves: sequence position 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keyspan.functions.expressions import first_rows, is_finite, nulls_last, ratio
from keyspan.operators.sequence import unified_sequence

EVENT_COLUMNS = ("Recording", "Participant", "Interval", "TOI", "Event_type", "Duration")
DETAIL_COLUMNS = (
    "Recording", "Participant", "Interval", "TOI",
    "Event_type", "Start", "Stop", "Duration", "Validity",
    "FixationSequence", "SaccadeSequence", "Sequence",
    "KeyEventStart", "KeyEventStop", "KeyEventType",
)
READING_ORDER = ("Recording", "Participant", "Interval", "TOI", "Start", "RowId")


def _key_rows(seqd: DataFrame) -> DataFrame:
    numbered = seqd.withColumn("Sequence", unified_sequence())
    return numbered.filter((F.col("Sequence") == 0) & is_finite("Duration"))


def seq0_events(seqd: DataFrame) -> DataFrame:
    """Key events with a finite duration; an event under two labels counts under each."""
    return _key_rows(seqd).select(*EVENT_COLUMNS)


def seq0_event_types(events: DataFrame) -> DataFrame:
    return events.groupBy("Event_type").agg(F.count(F.lit(1)).alias("N"))


def seq0_duration_per_recording(events: DataFrame) -> DataFrame:
    per_recording = events.groupBy("Recording").agg(
        F.avg("Duration").alias("AvgDuration_Seq0"), F.count(F.lit(1)).alias("N_Seq0_Events")
    )
    return per_recording.orderBy(F.col("Recording").asc_nulls_last())


def seq0_duration_overall(events: DataFrame) -> DataFrame:
    return events.agg(
        F.avg("Duration").alias("OverallAvgDuration_Seq0"), F.count(F.lit(1)).alias("Total_N_Seq0_Events")
    )


def seq0_recording_vs_overall(events: DataFrame) -> DataFrame:
    """Each recording's average beside the overall one, which is combined from the same partial sums."""
    sums = events.groupBy("Recording").agg(F.sum("Duration").alias("_sum"), F.count(F.lit(1)).alias("N_Seq0_Events"))
    overall = sums.agg(ratio(F.sum("_sum"), F.sum("N_Seq0_Events")).alias("OverallAvgDuration_Seq0"))
    # The overall average is one row.
    return sums.crossJoin(F.broadcast(overall)).select(
        "Recording",
        ratio(F.col("_sum"), F.col("N_Seq0_Events")).alias("AvgDuration_Seq0"),
        "N_Seq0_Events",
        "OverallAvgDuration_Seq0",
    )


def seq0_events_detailed(seqd: DataFrame) -> DataFrame:
    """Key events with their context, sorted for reading; equal ones stay in row order.

    The row id also lets the sort spread many equal events over its partitions.
    """
    return _key_rows(seqd).orderBy(*nulls_last(READING_ORDER)).select(*DETAIL_COLUMNS)


def seq0_events_first_rows(seqd: DataFrame, n: int = 50) -> DataFrame:
    """The first key events of the detailed listing, for display."""
    return first_rows(_key_rows(seqd), n, *READING_ORDER).select(*DETAIL_COLUMNS)
