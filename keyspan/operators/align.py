"""Finding each interval's key event and cutting every label's events to one side of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keyspan.config import DEFAULT, INTERVAL_KEYS, LABEL_KEYS, AnalysisConfig
from keyspan.functions.skew import attach

KEY_COLUMNS = ("KeyEventStart", "KeyEventStop", "KeyEventType")


def covers_anchor(cfg: AnalysisConfig = DEFAULT) -> Column:
    """The event is running at the anchor time; an event that stops exactly there is over."""
    return (F.col("Start") <= cfg.anchor_ms) & (F.col("Stop") > cfg.anchor_ms)


def key_event_per_label(gaze: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """First event in row order that covers the anchor, per label and interval.

    Labels without such an event are left out. The condition reaches the scan as a pushed filter.
    """
    first = F.min(F.struct("RowId", "Start", "Stop", "Event_type")).alias("_key")
    found = gaze.filter(covers_anchor(cfg)).groupBy(*LABEL_KEYS).agg(first)
    return found.select(
        *LABEL_KEYS,
        F.col("_key.Start").alias("KeyEventStart"),
        F.col("_key.Stop").alias("KeyEventStop"),
        F.col("_key.Event_type").alias("KeyEventType"),
    )


def key_event_per_interval(gaze: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Key event per interval, by one pass: a row per label, then a row per interval.

    Labels count in the order of their first row. The type is the first known one among the labels with
    a key event, so it may stem from another label than the times. All labels and all validity values
    take part.
    """
    own = F.min(F.when(covers_anchor(cfg), F.struct("RowId", "Start", "Stop", "Event_type")))
    labels = gaze.groupBy(*LABEL_KEYS).agg(F.min("RowId").alias("_first"), own.alias("_own"))
    keyed = labels.filter(F.col("_own").isNotNull())
    times = F.min(F.struct("_first", "_own.Start", "_own.Stop"))
    types = F.min(F.when(F.col("_own.Event_type").isNotNull(), F.struct("_first", "_own.Event_type")))
    found = keyed.groupBy(*INTERVAL_KEYS).agg(times.alias("_times"), types.alias("_type"))
    return found.select(
        *INTERVAL_KEYS,
        F.col("_times.Start").alias("KeyEventStart"),
        F.col("_times.Stop").alias("KeyEventStop"),
        F.col("_type.Event_type").alias("KeyEventType"),
    )


def attach_key_event(gaze: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """All rows with their interval's key event, NULL where there is none.

    One shuffle by interval serves both windows here and, since every later window's keys include the
    interval's, also sequencing and sizing. Each interval is handled by one task.
    """
    by_interval = Window.partitionBy(*INTERVAL_KEYS)
    by_label = Window.partitionBy(*LABEL_KEYS)
    own = F.min(F.when(covers_anchor(cfg), F.struct("RowId", "Start", "Stop", "Event_type"))).over(by_label)
    times = F.struct("RowId", "_own.Start", "_own.Stop")
    types = F.struct("RowId", "_own.Event_type")
    keyed = (
        (gaze if cfg.clustered else gaze.repartition(*INTERVAL_KEYS))
        .withColumn("_own", own)
        .withColumns(
            {
                "_times": F.min(F.when(F.col("_own").isNotNull(), times)).over(by_interval),
                "_type": F.min(F.when(F.col("_own.Event_type").isNotNull(), types)).over(by_interval),
            }
        )
    )
    return keyed.select(
        *gaze.columns,
        F.col("_times.Start").alias("KeyEventStart"),
        F.col("_times.Stop").alias("KeyEventStop"),
        F.col("_type.Event_type").alias("KeyEventType"),
    )


def attach_key_event_hot(gaze: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """As :func:`attach_key_event` for hot intervals, whose rows must not meet in one task.

    The key events are aggregated with a combine before the shuffle. There are no more of them than hot
    intervals, whose number is bounded, so they are broadcast.
    """
    return attach(gaze, key_event_per_interval(gaze, cfg), INTERVAL_KEYS, small=True)


def intervals_with_key_event(keyed: DataFrame) -> DataFrame:
    """Drop the intervals in which no label has a key event."""
    return keyed.filter(F.col("KeyEventStart").isNotNull())


def relevant_labels(df: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return df.filter(F.col("TOI").isin(*cfg.relevant_labels))


def valid_rows(df: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return df.filter(F.col("Validity") == cfg.valid_value)


def on_own_side(cfg: AnalysisConfig = DEFAULT) -> Column:
    """Before labels end with the key event, after labels start with it; the key event itself is in."""
    ends_in_time = F.col("TOI").isin(*cfg.before_labels) & (F.col("Stop") <= F.col("KeyEventStop"))
    starts_in_time = F.col("TOI").isin(*cfg.after_labels) & (F.col("Start") >= F.col("KeyEventStart"))
    return ends_in_time | starts_in_time


def side_window_filter(df: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return df.filter(on_own_side(cfg))


def is_aligned(cfg: AnalysisConfig = DEFAULT) -> Column:
    """The row of a keyed table passes every alignment filter."""
    return (
        F.col("KeyEventStart").isNotNull()
        & F.col("TOI").isin(*cfg.relevant_labels)
        & (F.col("Validity") == cfg.valid_value)
        & on_own_side(cfg)
    )


def align_keyed(keyed: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """The alignment filters, in their defined order; none may run before the key event is found."""
    kept = valid_rows(relevant_labels(intervals_with_key_event(keyed), cfg), cfg)
    return side_window_filter(kept, cfg)


def align_to_key_event(gaze: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Gaze rows of the relevant labels on their side of the key event, with its times and type."""
    return align_keyed(attach_key_event(gaze, cfg), cfg)


def key_event_consistency(aligned: DataFrame) -> DataFrame:
    """Distinct key times per interval; ``Inconsistent`` should never be true."""
    times = aligned.select(*INTERVAL_KEYS, "KeyEventStart", "KeyEventStop").distinct()
    counts = times.groupBy(*INTERVAL_KEYS).agg(
        F.count_distinct("KeyEventStart").alias("N_Unique_Start"),
        F.count_distinct("KeyEventStop").alias("N_Unique_Stop"),
    )
    return counts.withColumn("Inconsistent", (F.col("N_Unique_Start") > 1) | (F.col("N_Unique_Stop") > 1))


def spot_check_before(aligned: DataFrame, cfg: AnalysisConfig = DEFAULT, **group: object) -> DataFrame:
    """Latest stop of each before label against the key event's stop.

    ``group`` narrows it to chosen keys, e.g. ``Recording="R1", Interval=2``.
    """
    rows = _only(aligned.filter(F.col("TOI").isin(*cfg.before_labels)), group)
    checked = rows.groupBy(*LABEL_KEYS).agg(
        F.max("Stop").alias("MaxStop"), F.max("KeyEventStop").alias("KeyEventStop")
    )
    return checked.withColumn("WithinKeyEvent", F.col("MaxStop") <= F.col("KeyEventStop"))


def spot_check_after(aligned: DataFrame, cfg: AnalysisConfig = DEFAULT, **group: object) -> DataFrame:
    """Earliest start of each after label against the key event's start."""
    rows = _only(aligned.filter(F.col("TOI").isin(*cfg.after_labels)), group)
    checked = rows.groupBy(*LABEL_KEYS).agg(
        F.min("Start").alias("MinStart"), F.min("KeyEventStart").alias("KeyEventStart")
    )
    return checked.withColumn("WithinKeyEvent", F.col("MinStart") >= F.col("KeyEventStart"))


def remaining_labels(aligned: DataFrame) -> DataFrame:
    """Distinct labels and validity values, sorted."""
    return distinct_values(aligned, "TOI", "Validity").orderBy("Field", F.col("Value").asc_nulls_last())


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values of several string columns as (Field, Value) rows, in one pass."""
    pairs = F.array(*[F.struct(F.lit(name).alias("Field"), F.col(name).alias("Value")) for name in columns])
    combinations = df.select(*columns).distinct()
    return combinations.select(F.inline(pairs)).distinct()


def _only(df: DataFrame, group: dict[str, object]) -> DataFrame:
    for key, value in group.items():
        df = df.filter(F.col(key) == value)
    return df
