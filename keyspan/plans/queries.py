"""One named query per operator, over the gaze table derived from a folder's ``events`` table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from keyspan.config import DEFAULT, INTERVAL_KEYS, AnalysisConfig
from keyspan.functions.skew import checkpoint_folder
from keyspan.operators import align, keyrow, profiles, quality, sequence, summarize
from keyspan.plans.analysis import Analysis
from keyspan.plans.appended import GazeStore
from keyspan.sources.events import gaze_from_events
from keyspan.sources.gaze import row_id_report, with_input_order
from keyspan.sources.hard_events import hard_gaze_from_events
from keyspan.sources.sinks import read_profile_series, replace_profile_series

Query = Callable[[SparkSession, str], DataFrame]

def analysis_of(spark: SparkSession, sf_dir: str, cfg: AnalysisConfig = DEFAULT) -> Analysis:
    """The plans for one folder as it is now."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # The gaze table has one row for each event.
    n_rows = events.count()
    return Analysis(gaze_from_events(events, cfg, n_rows), cfg, n_rows)


def written_and_read(a: Analysis, series: DataFrame, entity: str, buckets: int | None) -> DataFrame:
    """Write a series to the session's shared folder, in place of the last one, and read it back."""
    spark = a.gaze.sparkSession
    path = f"{checkpoint_folder(spark)}/profile_series/{entity}"
    replace_profile_series(series, path, entity, buckets)
    return read_profile_series(spark, path)


def written_participant_series(a: Analysis) -> DataFrame:
    """Participants grow with the data, so they share a fixed number of folders."""
    series = profiles.overlay_per_participant(a.profile_rows)
    return written_and_read(a, series, "Participant", a.cfg.series_buckets)


def written_recording_series(a: Analysis) -> DataFrame:
    """One folder per recording."""
    return written_and_read(a, profiles.overlay_per_recording(a.profile_rows), "Recording", None)


OPERATORS: dict[str, Callable[[Analysis], DataFrame]] = {
    "gaze": lambda a: a.gaze,
    "row_id_report": lambda a: row_id_report(a.gaze),
    # Alignment
    "key_event_per_label": lambda a: align.key_event_per_label(a.gaze, a.cfg),
    "key_event_per_interval": lambda a: align.key_event_per_interval(a.gaze, a.cfg),
    "intervals_with_key_event": lambda a: align.intervals_with_key_event(a.keyed),
    "relevant_labels": lambda a: align.relevant_labels(a.gaze, a.cfg),
    "valid_rows": lambda a: align.valid_rows(a.gaze, a.cfg),
    "side_window_filter": lambda a: align.side_window_filter(a.keyed, a.cfg),
    "aligned_events": lambda a: a.aligned,
    "key_event_consistency": lambda a: align.key_event_consistency(a.aligned),
    "spot_check_before": lambda a: align.spot_check_before(a.aligned, a.cfg),
    "spot_check_after": lambda a: align.spot_check_after(a.aligned, a.cfg),
    "remaining_labels": lambda a: align.remaining_labels(a.aligned),
    # Sequencing and size filter
    "fixation_sequence": lambda a: sequence.sequence_of(a.sequenced, "Fixation"),
    "saccade_sequence": lambda a: sequence.sequence_of(a.sequenced, "Saccade"),
    "sequenced_events": lambda a: a.sequenced,
    "min_group_size": lambda a: a.final,
    "stage_counts": lambda a: a.stage_counts(),
    "interval_counts": lambda a: a.interval_counts(),
    # Summaries
    "summary_rollup": lambda a: summarize.rollup(a.final),
    "fixation_summary_per_label": lambda a: summarize.fixation_summary_per_label(a.final),
    "saccade_summary_per_label": lambda a: summarize.saccade_summary_per_label(a.final),
    "summary_per_label": lambda a: summarize.summary_per_label(a.final),
    "summary_per_label_first_rows": lambda a: summarize.summary_per_label_first_rows(a.final),
    "combined_fpen_summary": lambda a: summarize.combined_fpen_summary(a.final, a.cfg),
    "combined_pen_summary": lambda a: summarize.combined_pen_summary(a.final, a.cfg),
    "before_after_summary": lambda a: summarize.before_after_summary(a.final, a.cfg),
    "fpet_summary": lambda a: summarize.fpet_summary(a.final, a.cfg),
    "pet_summary": lambda a: summarize.pet_summary(a.final, a.cfg),
    "overall_four_categories": lambda a: summarize.overall_four_categories(a.final, a.cfg),
    "fpenx_penx_per_participant": lambda a: summarize.fpenx_penx_per_participant(a.final, a.cfg),
    "fpenx_penx_overall": lambda a: summarize.fpenx_penx_overall(a.final, a.cfg),
    "fpet_pet_per_participant": lambda a: summarize.fpet_pet_per_participant(a.final, a.cfg),
    "fpet_pet_overall": lambda a: summarize.fpet_pet_overall(a.final, a.cfg),
    "overall_summary_long": lambda a: summarize.overall_summary_long(
        a.final, a.final["TOI"].isin(*a.cfg.fpen_family), "Combined_FPEnX"
    ),
    "all_overall_summaries": lambda a: summarize.all_overall_summaries(a.final, a.cfg),
    # Profiles
    "sequence_metric_rows": lambda a: a.profile_rows,
    "sequence_range_check": lambda a: profiles.sequence_range_check(a.profile_rows),
    "sequence_zero_categories": lambda a: profiles.sequence_zero_categories(a.profile_rows),
    "profile_per_recording": lambda a: profiles.profile_per_recording(a.profile_rows),
    "overlay_per_participant": lambda a: profiles.overlay_per_participant(a.profile_rows),
    "overlay_per_recording": lambda a: profiles.overlay_per_recording(a.profile_rows),
    "overlay_fpenx_penx": lambda a: profiles.overlay_fpenx_penx(a.profile_rows, a.cfg),
    "overlay_fpet_pet": lambda a: profiles.overlay_fpet_pet(a.profile_rows, a.cfg),
    "overlay_fpen_pen": lambda a: profiles.overlay_fpen_pen(a.profile_rows, a.cfg),
    "profile_4groups_per_recording": lambda a: profiles.profile_4groups_per_recording(a.profile_rows, a.cfg),
    "overlay_4groups_per_recording": lambda a: profiles.overlay_4groups_per_recording(a.profile_rows, a.cfg),
    "recordings_with_profiles": lambda a: profiles.recordings_with_profiles(a.profile_rows, a.cfg),
    "entity_lists": lambda a: profiles.entity_lists(a.profile_rows),
    "write_profile_series": written_participant_series,
    "write_recording_series": written_recording_series,
    # Data quality
    "fixation_duration_stats": lambda a: quality.fixation_duration_stats(a.final, a.cfg),
    "saccade_amplitude_stats": lambda a: quality.saccade_amplitude_stats(a.final, a.cfg),
    "implausible_counts": lambda a: quality.implausible_counts(a.final, a.cfg),
    "fixation_histogram": lambda a: quality.fixation_histogram(a.final, a.cfg),
    "saccade_histogram": lambda a: quality.saccade_histogram(a.final, a.cfg),
    "outlier_stats": lambda a: quality.readable_outlier_stats(quality.outlier_stats(a.final)),
    "outlier_filtered": lambda a: a.outlier_filtered,
    "outlier_removed_counts": lambda a: quality.outlier_removed_counts(a.marked),
    # Profiles after outlier removal
    "sequence_metric_rows_filtered": lambda a: a.filtered_profile_rows,
    "mean_median_per_recording": lambda a: a.profile_per_recording,
    "mean_median_overall": lambda a: a.profile_overall,
    "stat_series_per_recording": lambda a: profiles.stat_series(a.profile_per_recording),
    "stat_series_overall": lambda a: profiles.stat_series(a.profile_overall),
    # Key events
    "seq0_events": lambda a: keyrow.seq0_events(a.sequenced),
    "seq0_event_types": lambda a: keyrow.seq0_event_types(keyrow.seq0_events(a.sequenced)),
    "seq0_duration_per_recording": lambda a: keyrow.seq0_duration_per_recording(keyrow.seq0_events(a.sequenced)),
    "seq0_duration_overall": lambda a: keyrow.seq0_duration_overall(keyrow.seq0_events(a.sequenced)),
    "seq0_recording_vs_overall": lambda a: keyrow.seq0_recording_vs_overall(keyrow.seq0_events(a.sequenced)),
    "seq0_events_detailed": lambda a: keyrow.seq0_events_detailed(a.sequenced),
    "seq0_events_first_rows": lambda a: keyrow.seq0_events_first_rows(a.sequenced),
}


# The same operators where nearly every user and interval counts as hot, or there are too many recordings to broadcast.
ALL_HOT, MANY_RECORDINGS = AnalysisConfig(hot_rows=40), AnalysisConfig(broadcast_groups=2)
# As for groups of very many values: ranges of quantiles are narrowed again.
NARROWED = AnalysisConfig(quantile_rounds=2)
SKEWED: dict[str, tuple[str, AnalysisConfig]] = {
    "gaze_split": ("gaze", ALL_HOT),
    "aligned_events_split": ("aligned_events", ALL_HOT),
    "sequenced_events_split": ("sequenced_events", ALL_HOT),
    "min_group_size_split": ("min_group_size", ALL_HOT),
    "outlier_filtered_uneven": ("outlier_filtered", MANY_RECORDINGS),
    "fixation_duration_stats_narrowed": ("fixation_duration_stats", NARROWED),
    "mean_median_overall_narrowed": ("mean_median_overall", NARROWED),
}


# The same operators on the table of hard cases, each with its own SQL; its large interval is hot for the last ones.
HARD = (
    "gaze",
    "key_event_per_label",
    "key_event_per_interval",
    "aligned_events",
    "sequenced_events",
    "min_group_size",
    "interval_counts",
    "summary_rollup",
    "fixation_summary_per_label",
    "summary_per_label",
    "before_after_summary",
    "combined_fpen_summary",
    "overall_four_categories",
    "implausible_counts",
    "fixation_duration_stats",
)
HARD_HOT = ("aligned_events", "sequenced_events", "min_group_size")
LARGE_HOT = AnalysisConfig(hot_rows=200)


def hard_analysis_of(spark: SparkSession, sf_dir: str, cfg: AnalysisConfig = DEFAULT) -> Analysis:
    """The plans for one folder's hard cases."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n_rows = events.count()
    # Only intervals are to be hot here, not the users of the plain table.
    return Analysis(hard_gaze_from_events(events, DEFAULT, n_rows), cfg, n_rows)


def _bind(operator: Callable[[Analysis], DataFrame], cfg: AnalysisConfig = DEFAULT, source=analysis_of) -> Query:
    return lambda spark, sf_dir: operator(source(spark, sf_dir, cfg))


def input_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored order of the events, as the row numbers of a table that has none."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return with_input_order(events).select("RowId", "event_id")


def with_missing_keys(final: DataFrame) -> DataFrame:
    """The final rows where two rows of five lose all keys of their label."""
    lost = F.col("RowId") % 5 < 2
    keys = {key: F.when(~lost, F.col(key)) for key in summarize.PER_LABEL}
    return final.withColumns(keys)


def hard_fixations_with_saccades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skew-safe full outer join: 40 % of the rows have NULL keys, and a third of the others share two keys."""
    a = hard_analysis_of(spark, sf_dir, LARGE_HOT)
    return summarize.fixations_with_saccades(with_missing_keys(a.final), a.cfg)


def appended_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered rows of a table that came in two parts: half the rows of a third of the intervals come late."""
    a = analysis_of(spark, sf_dir)
    late = (F.pmod(F.xxhash64(*INTERVAL_KEYS), F.lit(3)) == 0) & (F.col("RowId") % 2 == 1)
    store = GazeStore(spark, f"{checkpoint_folder(spark)}/gaze_store/{uuid.uuid4().hex}", a.cfg, parts=8, files=1)
    store.append(a.gaze.filter(~late))
    store.append(a.gaze.filter(late))
    return store.sequenced


def all_queries() -> dict[str, Query]:
    usual = {name: _bind(operator) for name, operator in OPERATORS.items()}
    usual |= {"input_order": input_order, "appended_events": appended_events}
    usual["fixations_with_saccades"] = _bind(lambda a: summarize.fixations_with_saccades(a.final, a.cfg))
    usual["hard_fixations_with_saccades"] = hard_fixations_with_saccades
    usual |= {f"hard_{name}": _bind(OPERATORS[name], source=hard_analysis_of) for name in HARD}
    usual |= {f"hard_{name}_split": _bind(OPERATORS[name], LARGE_HOT, hard_analysis_of) for name in HARD_HOT}
    return usual | {name: _bind(OPERATORS[of], cfg) for name, (of, cfg) in SKEWED.items()}
