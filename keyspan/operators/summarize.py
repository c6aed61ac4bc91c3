"""Averages and counts per label, per participant, per family and overall.

Every report is folded from one rollup: sums and counts per recording, participant, label and event type. A report
takes the final rows, or their rollup, so that any number of reports needs one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from keyspan.config import AFTER_EVENT, BEFORE_EVENT, DEFAULT, FPENX_PENX, FPET_PET, AnalysisConfig
from keyspan.functions.expressions import (
    categories_of,
    category_of,
    first_rows,
    is_fixation,
    is_saccade,
    null_safe,
    nulls_last,
    ratio,
    with_category_order,
)
from keyspan.functions.outer import full_outer

PER_LABEL = ("Recording", "Participant", "TOI")
PER_PARTICIPANT = ("Recording", "Participant")


ROLLUP_KEYS = (*PER_LABEL, "Event_type")
# Sums and counts of the measures, and rows; each can be added up.
MERGEABLE = ("SumDuration", "N_Duration", "SumAmplitude", "N_Amplitude", "N_Rows")


def rollup(final: DataFrame) -> DataFrame:
    """Sums and counts by recording, participant, label and event type; a rollup is returned as it is.

    A report of thousands of recordings has a few dozen rows for each of them here, whatever the number of events.
    """
    if set(MERGEABLE) <= set(final.columns):
        return final
    return final.groupBy(*ROLLUP_KEYS).agg(
        F.sum("Duration").alias("SumDuration"),
        F.count("Duration").alias("N_Duration"),
        F.sum("Saccade_amplitude").alias("SumAmplitude"),
        F.count("Saccade_amplitude").alias("N_Amplitude"),
        F.count(F.lit(1)).alias("N_Rows"),
    )


def avg_duration(where: Column | None = None) -> Column:
    """Mean of the durations in the folded parts, or in those that meet a condition."""
    total, count = F.col("SumDuration"), F.col("N_Duration")
    return ratio(F.sum(total), F.sum(count)) if where is None else ratio(F.sum(F.when(where, total)), F.sum(F.when(where, count)))


def avg_amplitude(where: Column | None = None) -> Column:
    total, count = F.col("SumAmplitude"), F.col("N_Amplitude")
    return ratio(F.sum(total), F.sum(count)) if where is None else ratio(F.sum(F.when(where, total)), F.sum(F.when(where, count)))


def rows_of(where: Column) -> Column:
    """Rows of the folded parts that meet a condition."""
    return F.coalesce(F.sum(F.when(where, F.col("N_Rows"))), F.lit(0))


def fixation_summary_per_label(final: DataFrame) -> DataFrame:
    parts = rollup(final).filter(is_fixation())
    return parts.groupBy(*PER_LABEL).agg(avg_duration().alias("AvgFixationDuration"), F.sum("N_Rows").alias("N_Fixations"))


def saccade_summary_per_label(final: DataFrame) -> DataFrame:
    parts = rollup(final).filter(is_saccade())
    return parts.groupBy(*PER_LABEL).agg(avg_amplitude().alias("AvgSaccadeAmplitude"), F.sum("N_Rows").alias("N_Saccades"))


def join_label_summaries(fixations: DataFrame, saccades: DataFrame) -> DataFrame:
    """Full outer join of two per-label summaries; NULL keys match, a missing side stays NULL."""
    other = saccades.withColumnsRenamed({key: "_s_" + key for key in PER_LABEL})
    joined = fixations.join(other, null_safe(PER_LABEL, "_s_"), "full")
    keys = [F.coalesce(key, "_s_" + key).alias(key) for key in PER_LABEL]
    return joined.select(*keys, "AvgFixationDuration", "N_Fixations", "AvgSaccadeAmplitude", "N_Saccades")


def fixations_with_saccades(final: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Every fixation beside the saccade summary of its label, and the summaries of labels without fixations.

    A label (NULL keys included) may hold any share of the fixations: see :func:`full_outer`.
    """
    fixations = final.filter(is_fixation()).select(*PER_LABEL, "RowId", "Duration")
    return full_outer(fixations, saccade_summary_per_label(final), PER_LABEL, cfg.hot_rows, left_id=["RowId"])


def summary_per_label(final: DataFrame) -> DataFrame:
    """Fixation and saccade summaries side by side.

    Both come from one table, so one conditional aggregation replaces two scans and a join. A label
    without fixations (or saccades) has NULL there, not 0, and a label with neither has no row.
    """
    both = rollup(final).groupBy(*PER_LABEL).agg(
        avg_duration(is_fixation()).alias("AvgFixationDuration"),
        F.sum(F.when(is_fixation(), F.col("N_Rows"))).alias("N_Fixations"),
        avg_amplitude(is_saccade()).alias("AvgSaccadeAmplitude"),
        F.sum(F.when(is_saccade(), F.col("N_Rows"))).alias("N_Saccades"),
    )
    return both.filter(F.col("N_Fixations").isNotNull() | F.col("N_Saccades").isNotNull())


def summary_per_label_first_rows(final: DataFrame, n: int = 50) -> DataFrame:
    """The first rows of the side-by-side summary, for display."""
    return first_rows(summary_per_label(final), n, *PER_LABEL)


def fix_and_sacc(parts: DataFrame, keys: Iterable[str], suffix: str = "") -> DataFrame:
    """Both averages and counts per group of a rollup. Rows without an event type are not counted."""
    return parts.groupBy(*keys).agg(
        avg_duration(is_fixation()).alias("AvgFixDuration" + suffix),
        rows_of(is_fixation()).alias("N_Fix" + suffix),
        avg_amplitude(is_saccade()).alias("AvgSaccAmplitude" + suffix),
        rows_of(is_saccade()).alias("N_Sacc" + suffix),
    )


def labels_per_participant(final: DataFrame, labels: Iterable[str], suffix: str = "") -> DataFrame:
    return fix_and_sacc(rollup(final).filter(F.col("TOI").isin(*labels)), PER_PARTICIPANT, suffix)


def combined_fpen_summary(final: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return labels_per_participant(final, cfg.fpen_family, "_All_FPEn")


def combined_pen_summary(final: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return labels_per_participant(final, cfg.pen_family, "_All_PEn")


def before_after_summary(final: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Before labels against after labels, per recording and participant, sorted."""
    windows = {BEFORE_EVENT: (cfg.ea, *cfg.before_labels), AFTER_EVENT: cfg.after_labels}
    grouped = rollup(final).withColumn("TimeWindowGroup", category_of(windows))
    keys = (*PER_PARTICIPANT, "TimeWindowGroup")
    summary = fix_and_sacc(grouped.filter(F.col("TimeWindowGroup").isNotNull()), keys)
    return summary.orderBy(*nulls_last(keys))


def fpet_summary(final: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return labels_per_participant(final, (cfg.fpet,), "_FPEt")


def pet_summary(final: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return labels_per_participant(final, (cfg.pet,), "_PEt")


def fpenx_penx_per_participant(final: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return labels_per_participant(final, cfg.fpen_family + cfg.pen_family)


def fpet_pet_per_participant(final: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return labels_per_participant(final, (cfg.fpet, cfg.pet))


def event_type_metrics(parts: DataFrame, keys: Iterable[str]) -> DataFrame:
    """AvgDuration for fixations, AvgAmplitude for saccades and N, by ``keys`` and event type of a rollup."""
    return parts.groupBy(*keys, "Event_type").agg(
        F.when(is_fixation(), avg_duration()).alias("AvgDuration"),
        F.when(is_saccade(), avg_amplitude()).alias("AvgAmplitude"),
        F.sum("N_Rows").alias("N"),
    )


def category_metrics(final: DataFrame, categories: Mapping[str, Iterable[str]], column: str) -> DataFrame:
    """Metrics by category and event type from one pass, even where a label has several categories."""
    wanted = sorted({label for group in categories.values() for label in group})
    parts = rollup(final).filter(F.col("TOI").isin(*wanted))
    # First by label, so that a part is not multiplied by its categories.
    labels = parts.groupBy("TOI", "Event_type").agg(*[F.sum(name).alias(name) for name in MERGEABLE])
    return event_type_metrics(labels.withColumn(column, F.explode(categories_of(categories))), [column])


def drop_empty_metrics(metrics: DataFrame) -> DataFrame:
    """Drop fixations and saccades without an average. Other types stay; a missing type does not."""
    empty = (is_fixation() & F.col("AvgDuration").isNull()) | (is_saccade() & F.col("AvgAmplitude").isNull())
    return metrics.filter(~empty)


def overall_four_categories(final: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    metrics = drop_empty_metrics(category_metrics(final, cfg.four_categories, "TOI_Category"))
    columns = ("TOI_Category", "Event_type", "AvgDuration", "AvgAmplitude", "N")
    return metrics.select(*columns).orderBy("TOI_Category", F.col("Event_type").asc_nulls_last())


def combination_overall(final: DataFrame, labels: Iterable[str], name: str) -> DataFrame:
    metrics = drop_empty_metrics(category_metrics(final, {name: tuple(labels)}, "TOI_Combination"))
    return metrics.select("TOI_Combination", "Event_type", "AvgDuration", "AvgAmplitude", "N")


def fpenx_penx_overall(final: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return combination_overall(final, cfg.fpen_family + cfg.pen_family, FPENX_PENX)


def fpet_pet_overall(final: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return combination_overall(final, (cfg.fpet, cfg.pet), FPET_PET)


def long_metrics(metrics: DataFrame) -> DataFrame:
    """One row per metric; types that have neither metric disappear."""
    unpivoted = metrics.unpivot(
        ["Category", "Event_type", "N"], ["AvgDuration", "AvgAmplitude"], "MetricType", "AvgMetric"
    )
    return unpivoted.filter(F.col("AvgMetric").isNotNull()).select(
        "Category", "Event_type", "MetricType", "AvgMetric", "N"
    )


def overall_summary_long(final: DataFrame, condition: Column, label: str) -> DataFrame:
    """Long summary of the rows that meet a condition, under a label of the caller's choice."""
    metrics = event_type_metrics(rollup(final.filter(condition)), [])
    return long_metrics(metrics.withColumn("Category", F.lit(label)))


def all_overall_summaries(final: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """The long summary of all seven categories at once, in category order."""
    metrics = category_metrics(final, cfg.overall_categories, "Category")
    return with_category_order(long_metrics(metrics), cfg.overall_categories, "Category")
