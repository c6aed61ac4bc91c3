"""A gaze table with every hard case, derived from a generic ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keyspan.config import DEFAULT, AnalysisConfig
from keyspan.sources.events import gaze_from_events
from keyspan.sources.gaze import as_gaze

NAN, INFINITE = float("nan"), float("inf")


def hard_gaze_from_events(events: DataFrame, cfg: AnalysisConfig = DEFAULT, n_rows: int | None = None) -> DataFrame:
    """The gaze table of the events with

    - a third of all rows in one interval, and missing recordings, participants and intervals elsewhere;
    - missing starts and stops, and very many equal ones;
    - NaN and infinite durations, NaN amplitudes, and real values (eighths and finer, so that sums stay exact).
    """
    plain = gaze_from_events(events, cfg, n_rows)
    user = F.expr("CAST(substring(Participant, 2) AS BIGINT)")
    row = F.col("RowId")
    large = user % 3 == 0

    def time(name: str, missing: Column, step: int) -> Column:
        coarse = F.floor(F.col(name) / 512) * 512 + step
        fine = F.col(name) + (row % 8) / 8
        return F.when(missing, F.lit(None)).when(row % 4 == 0, coarse).otherwise(fine).cast("double").alias(name)

    changed = plain.select(
        "RowId",
        F.when(large, "R0").when(user % 7 == 1, F.lit(None)).otherwise(F.col("Recording")).alias("Recording"),
        F.when(large, "PX").when(user % 7 == 2, F.lit(None)).otherwise(F.col("Participant")).alias("Participant"),
        "TOI",
        F.when(large, 1)
        .when((user % 5 == 1) & (F.col("Interval") == 2), F.lit(None))
        .otherwise(F.col("Interval"))
        .alias("Interval"),
        "Event_type",
        "Validity",
        time("Start", row % 31 == 5, 0),
        time("Stop", row % 37 == 6, 512),
        F.when(row % 41 == 1, F.lit(NAN))
        .when(row % 997 == 7, F.lit(INFINITE))
        .otherwise(F.col("Duration") + (row % 16) / 16)
        .alias("Duration"),
        F.when(F.col("Saccade_amplitude").isNotNull() & (row % 43 == 2), F.lit(NAN))
        .otherwise(F.col("Saccade_amplitude") + (row % 32) / 1024)
        .alias("Saccade_amplitude"),
    )
    return as_gaze(changed)
