"""Data-quality statistics and outlier removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keyspan.config import DEFAULT, AnalysisConfig
from keyspan.functions.expressions import is_fixation, is_other_type, is_saccade, ratio
from keyspan.functions.quantiles import exact_quantiles
from keyspan.functions.skew import attach, attach_uneven

INFINITE = float("inf")


def numeric_summary(df: DataFrame, value: Column, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Minimum, quartiles, mean, maximum and NULL count of one column, exactly."""
    quartiles = {"Q25": 0.25, "Median": 0.5, "Q75": 0.75}
    found = exact_quantiles(df, [], value, quartiles, cfg.quantile_rounds, few_groups=True)
    return found.select(
        F.col("_min").alias("Min"),
        "Q25",
        "Median",
        ratio(F.col("_sum"), F.col("_n")).alias("Mean"),
        "Q75",
        F.col("_max").alias("Max"),
        F.coalesce("_nulls", F.lit(0)).alias("N_Null"),
    )


def fixation_duration_stats(final: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return numeric_summary(final.filter(is_fixation()), F.col("Duration"), cfg)


def saccade_amplitude_stats(final: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return numeric_summary(final.filter(is_saccade()), F.col("Saccade_amplitude"), cfg)


def implausible_counts(final: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    duration, amplitude = F.col("Duration"), F.col("Saccade_amplitude")
    return final.agg(
        F.count_if(is_fixation() & (duration < cfg.short_fixation_ms)).alias("N_Fix_Short"),
        F.count_if(is_fixation() & (duration > cfg.long_fixation_ms)).alias("N_Fix_Long"),
        F.count_if(is_saccade() & (amplitude < cfg.small_saccade_deg)).alias("N_Sacc_Small"),
        F.count_if(is_saccade() & (amplitude > cfg.large_saccade_deg)).alias("N_Sacc_Large"),
    )


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Counts in equal-width bins from minimum to maximum; empty bins are left out.

    The range first, then the bins: each task shuffles no more rows than there are bins.
    """
    values = df.select(value.alias("_value")).filter(F.col("_value").isNotNull())
    ends = values.agg(F.min("_value").alias("_low"), F.max("_value").alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    number = F.when(F.col("_high") == F.col("_low"), F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide(F.col("_value") - F.col("_low"), width)), F.lit(bins - 1))
    )
    # The range is one row.
    placed = values.crossJoin(F.broadcast(ends)).select(
        number.cast("int").alias("Bin"), "_low", width.alias("_width")
    )
    return (
        placed.groupBy("Bin", "_low", "_width")
        .agg(F.count(F.lit(1)).alias("Count"))
        .select("Bin", (F.col("_low") + F.col("Bin") * F.col("_width")).alias("BinStart"), "Count")
    )


def fixation_histogram(final: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return histogram(final.filter(is_fixation()), F.col("Duration"), cfg.histogram_bins)


def saccade_histogram(final: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return histogram(final.filter(is_saccade()), F.col("Saccade_amplitude"), cfg.histogram_bins)


def outlier_stats(final: DataFrame) -> DataFrame:
    """Mean and deviation per recording: fixation durations and saccade amplitudes, over all labels.

    Where no positive deviation exists it is infinite, so that no row is out of bounds. One pass serves
    both event types; ``n_rows`` is the recording's size.
    """
    duration = F.when(is_fixation(), F.col("Duration"))
    amplitude = F.when(is_saccade(), F.col("Saccade_amplitude"))

    def spread(value: Column) -> Column:
        deviation = F.stddev_samp(value)
        return F.when(deviation.isNull() | (deviation == 0), F.lit(INFINITE)).otherwise(deviation)

    return final.groupBy("Recording").agg(
        F.avg(duration).alias("mean_dur"),
        spread(duration).alias("sd_dur"),
        F.avg(amplitude).alias("mean_amp"),
        spread(amplitude).alias("sd_amp"),
        F.count_if(is_fixation()).alias("n_fix"),
        F.count_if(is_saccade()).alias("n_sacc"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def readable_outlier_stats(stats: DataFrame) -> DataFrame:
    """For display: rounded, and an infinite deviation as NULL with an ``unbounded`` flag."""
    columns = ["Recording"]
    for mean, deviation, flag in (("mean_dur", "sd_dur", "unbounded_dur"), ("mean_amp", "sd_amp", "unbounded_amp")):
        infinite = F.col(deviation) == INFINITE
        columns += [
            F.round(mean, 6).alias(mean),
            F.when(~infinite, F.round(deviation, 6)).alias(deviation),
            infinite.alias(flag),
        ]
    return stats.select(*columns, "n_fix", "n_sacc", "n_rows")


def mark_outliers(final: DataFrame, cfg: AnalysisConfig = DEFAULT, recordings: int | None = None) -> DataFrame:
    """All rows with ``_kept``: inside mean +- k deviations of their recording, or of another type.

    ``recordings`` is the checked number of recordings: up to the configured limit their statistics are
    broadcast, beyond it (or if unknown) only those of the largest recordings are, and the rest is joined
    by a shuffle that no recording can dominate.
    """
    stats = outlier_stats(final)
    keys = ["Recording"]
    if recordings is not None and recordings <= cfg.broadcast_groups:
        rows = attach(final, stats, keys, small=True)
    else:
        rows = attach_uneven(final, stats, keys, "n_rows", cfg.broadcast_groups)

    def inside(value: str, mean: str, deviation: str) -> Column:
        margin = F.col(deviation) * cfg.sd_limit
        return F.col(value).between(F.col(mean) - margin, F.col(mean) + margin)

    kept = (
        (is_fixation() & inside("Duration", "mean_dur", "sd_dur"))
        | (is_saccade() & inside("Saccade_amplitude", "mean_amp", "sd_amp"))
        | is_other_type()
    )
    return rows.select(*final.columns, F.coalesce(kept, F.lit(False)).alias("_kept"))


def outlier_filtered(marked: DataFrame) -> DataFrame:
    return marked.filter("_kept").drop("_kept")


def outlier_removed_counts(marked: DataFrame) -> DataFrame:
    return marked.agg(
        F.count(F.lit(1)).alias("N_Before"),
        F.count_if("_kept").alias("N_After"),
        F.count_if(~F.col("_kept")).alias("N_Removed"),
    )
