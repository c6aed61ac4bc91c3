"""Gaze table derived from a generic ``events`` table (event_id, user_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keyspan.config import DEFAULT, FIXATION, SACCADE, AnalysisConfig
from keyspan.functions.skew import row_numbers
from keyspan.sources.gaze import as_gaze

ROWS_PER_LABEL = 26
# Label of each (user_id + chunk) % 12.
LABEL_CYCLE = (
    "FPEn", "PEn", "FPEt", "PEt", "FPEn2", "PEn2", "EA", "FPEn3", "PEn3", "FPEn4", "PEn4", "Other",
)


def gaze_from_events(events: DataFrame, cfg: AnalysisConfig = DEFAULT, n_rows: int | None = None) -> DataFrame:
    """Read each user's events as gaze events: 26 rows per label, two labels per interval.

    ``n_rows`` is the number of events, if it is known.
    """
    numbered = row_numbers(
        events.select("event_id", "user_id", "event_type", "value"),
        ["user_id"],
        [F.col("event_id").asc()],
        "_rn",
        cfg.hot_rows,
        n_rows,
    )
    chunked = numbered.withColumn("_chunk", F.floor((F.col("_rn") - 1) / ROWS_PER_LABEL).cast("int")).withColumn(
        "_dur", F.lit(60) + F.floor(F.col("value") * 8)
    )
    clock = Window.partitionBy("user_id", "_chunk").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    timed = chunked.withColumn("_stop", F.sum("_dur").over(clock))
    saccadic = F.col("event_type").isin("purchase", "signup")
    event_type: Column = (
        F.when(F.col("event_id") % 97 == 0, F.lit(None).cast("string"))
        .when(F.col("event_type").isin("click", "view"), FIXATION)
        .when(saccadic, SACCADE)
        .otherwise("Unclassified")
    )
    label = F.element_at(
        F.array(*[F.lit(name) for name in LABEL_CYCLE]),
        ((F.col("user_id") + F.col("_chunk")) % len(LABEL_CYCLE) + 1).cast("int"),
    )
    return as_gaze(
        timed.select(
            F.col("event_id").alias("RowId"),
            F.concat(F.lit("R"), (F.col("user_id") % 5).cast("string")).alias("Recording"),
            F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("Participant"),
            label.alias("TOI"),
            (F.floor(F.col("_chunk") / 2) + 1).cast("int").alias("Interval"),
            event_type.alias("Event_type"),
            F.when(F.col("event_id") % 13 == 0, "Partial").otherwise("Whole").alias("Validity"),
            (F.col("_stop") - F.col("_dur")).cast("double").alias("Start"),
            F.col("_stop").cast("double").alias("Stop"),
            F.col("_dur").cast("double").alias("Duration"),
            F.when(saccadic, F.floor(F.col("value")) / 8).alias("Saccade_amplitude"),
        )
    )
