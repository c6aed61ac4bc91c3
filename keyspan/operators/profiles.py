"""Profiles: averages by position relative to the key event."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from keyspan.config import (
    DEFAULT,
    FIXATION_METRIC,
    FPEN_PEN,
    FPENX_PENX,
    FPET_PET,
    SACCADE_METRIC,
    AnalysisConfig,
)
from keyspan.functions.expressions import category_of, is_fixation, is_saccade, metric, ratio, with_category_order
from keyspan.functions.quantiles import exact_quantiles
from keyspan.operators.align import distinct_values
from keyspan.operators.sequence import unified_sequence

FOUR_GROUP_KEYS = ("TOI_Category", "Event_type", "Sequence")
STATISTICS = ("MeanMetric", "MedianMetric")


def sequence_metric_rows(
    seqd: DataFrame, cfg: AnalysisConfig = DEFAULT, categories: dict[str, tuple[str, ...]] | None = None
) -> DataFrame:
    """Rows to profile: before categories at negative positions, after categories from 0 on.

    Positions are those of the full sequence; they are not renumbered after rows were removed.
    """
    position = F.col("Sequence")
    own_side = (F.col("TOI_Category").isin(*cfg.before_categories) & (position < 0)) | (
        F.col("TOI_Category").isin(*cfg.after_categories) & (position >= 0)
    )
    rows = seqd.select(
        "Participant",
        "Recording",
        "TOI",
        category_of(categories or cfg.profile_categories).alias("TOI_Category"),
        "Event_type",
        F.when(is_fixation() | is_saccade(), unified_sequence()).alias("Sequence"),
        metric().alias("Metric"),
    )
    return rows.filter(F.col("Metric").isNotNull() & own_side & position.between(cfg.min_sequence, cfg.max_sequence))


def sequence_metric_rows_filtered(filtered: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """The same for outlier-filtered rows and the four main categories."""
    return sequence_metric_rows(filtered, cfg, cfg.four_categories)


def sequence_range_check(rows: DataFrame) -> DataFrame:
    return rows.groupBy("TOI_Category").agg(
        F.min("Sequence").alias("MinSeq"), F.max("Sequence").alias("MaxSeq"), F.count(F.lit(1)).alias("N_Rows")
    )


def sequence_zero_categories(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("Sequence") == 0).select("TOI_Category").distinct()


def averages(rows: DataFrame, keys: Iterable[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg("Metric").alias("AvgMetric"), F.count(F.lit(1)).alias("N"))


def profile_per_recording(rows: DataFrame) -> DataFrame:
    name = F.when(is_fixation(), FIXATION_METRIC).when(is_saccade(), SACCADE_METRIC)
    return averages(rows, ["Recording", "Event_type", "Sequence"]).withColumn("MetricName", name)


def overlay_scale(points: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Bring saccade averages onto the scale of the fixation averages, per entity.

    Entities need two points or more and both event types. The factor is the ratio of the two value
    ranges if both are finite and positive, otherwise 1. ``points`` are averages, a few dozen per
    entity, so the windows are small whatever the size of the data.
    """
    all_points = Window.partitionBy(*entity)
    fixation = F.when(is_fixation(), F.col("AvgMetric"))
    saccade = F.when(is_saccade(), F.col("AvgMetric"))
    ranged = points.withColumns(
        {
            "_points": F.count(F.lit(1)).over(all_points),
            "_fixations": F.count_if(is_fixation()).over(all_points),
            "_saccades": F.count_if(is_saccade()).over(all_points),
            "_fix_range": F.max(fixation).over(all_points) - F.min(fixation).over(all_points),
            "_sacc_range": F.max(saccade).over(all_points) - F.min(saccade).over(all_points),
        }
    )
    eligible = (F.col("_points") >= 2) & (F.col("_fixations") > 0) & (F.col("_saccades") > 0)
    # An infinite end makes the range infinite or NaN; NaN sorts above every number.
    usable = [(F.col(name) > 0) & (F.col(name) < float("inf")) for name in ("_fix_range", "_sacc_range")]
    factor = F.when(usable[0] & usable[1], F.try_divide("_fix_range", "_sacc_range")).otherwise(1.0)
    scaled = F.when(is_saccade(), F.col("AvgMetric") * F.col("ScalingFactor")).otherwise(F.col("AvgMetric"))
    return (
        ranged.filter(eligible)
        .withColumn("ScalingFactor", factor)
        .withColumn("ScaledMetric", scaled)
        .select(*points.columns, "ScalingFactor", "ScaledMetric")
    )


def overlay_per_entity(rows: DataFrame, entity: str) -> DataFrame:
    """Scaled series of every participant or recording at once; rows without one give no series."""
    rows = rows.filter(F.col(entity).isNotNull())
    return overlay_scale(averages(rows, [entity, "Event_type", "Sequence"]), [entity])


def overlay_per_participant(rows: DataFrame) -> DataFrame:
    return overlay_per_entity(rows, "Participant")


def overlay_per_recording(rows: DataFrame) -> DataFrame:
    return overlay_per_entity(rows, "Recording")


def overlay_combination(rows: DataFrame, labels: Iterable[str], name: str) -> DataFrame:
    """Scaled overall series of a set of labels."""
    points = averages(rows.filter(F.col("TOI").isin(*labels)), ["Event_type", "Sequence"])
    return overlay_scale(points.withColumn("TOI_Combination", F.lit(name)), ["TOI_Combination"])


def overlay_fpenx_penx(rows: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return overlay_combination(rows, cfg.fpen_family + cfg.pen_family, FPENX_PENX)


def overlay_fpet_pet(rows: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return overlay_combination(rows, (cfg.fpet, cfg.pet), FPET_PET)


def overlay_fpen_pen(rows: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return overlay_combination(rows, cfg.first_instance_labels, FPEN_PEN)


def profile_4groups_per_recording(rows: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    four = rows.filter(F.col("TOI_Category").isin(*cfg.four_categories))
    points = averages(four, ["Recording", *FOUR_GROUP_KEYS])
    return with_category_order(points, cfg.four_categories)


def overlay_4groups_per_recording(rows: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Scaled four-category series; one factor per recording across its categories. Rows without one give none."""
    rows = rows.filter(F.col("Recording").isNotNull())
    return overlay_scale(profile_4groups_per_recording(rows, cfg), ["Recording"])


def recordings_with_profiles(rows: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Recordings and categories that have a four-category profile, as (Field, Value) rows."""
    four = rows.filter(F.col("TOI_Category").isin(*cfg.four_categories))
    return distinct_values(four, "Recording", "TOI_Category")


def entity_lists(rows: DataFrame) -> DataFrame:
    """Participants and recordings that have profile rows, as (Field, Value) rows."""
    return distinct_values(rows, "Participant", "Recording")


def mean_median(
    rows: DataFrame, keys: Sequence[str], cfg: AnalysisConfig = DEFAULT, few_groups: bool = False
) -> DataFrame:
    """MeanMetric, exact MedianMetric and N per group."""
    found = exact_quantiles(rows, keys, F.col("Metric"), {"MedianMetric": 0.5}, cfg.quantile_rounds, few_groups)
    mean = ratio(F.col("_sum"), F.col("_n")).alias("MeanMetric")
    profile = found.select(*keys, mean, "MedianMetric", F.col("_n").alias("N"))
    return with_category_order(profile, cfg.four_categories)


def mean_median_per_recording(rows: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return mean_median(rows, ["Recording", *FOUR_GROUP_KEYS], cfg)


def mean_median_overall(rows: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    # No more groups than categories, two event types and the configured positions make.
    return mean_median(rows, FOUR_GROUP_KEYS, cfg, few_groups=True)


def points_of(points: DataFrame, event_type: str) -> DataFrame:
    """The points of one event type, e.g. for a chart of its own."""
    return points.filter(F.col("Event_type") == event_type)


def stat_series(profile: DataFrame, event_type: str | None = None, stat: str | None = None) -> DataFrame:
    """Points to draw as (.., Stat, Value, N) rows: all series, or those of one event type or statistic."""
    chosen = [stat] if stat else list(STATISTICS)
    unknown = [name for name in chosen if name not in STATISTICS]
    if unknown:
        raise ValueError(f"unknown statistic {unknown}; choose from {list(STATISTICS)}")
    rows = profile if event_type is None else points_of(profile, event_type)
    if "Recording" in rows.columns:
        # A series is drawn for a recording. The condition names N as well, so that it stays above the aggregation
        # and all passes over the rows share one shuffle.
        rows = rows.filter(F.when(F.col("N") >= 0, F.col("Recording")).isNotNull())
    ids = [name for name in profile.columns if name not in STATISTICS]
    return rows.unpivot(ids, chosen, "Stat", "Value")
