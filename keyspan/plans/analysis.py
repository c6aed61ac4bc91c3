"""The stages of the analysis, composed so that they share shuffles and stay even under skew."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame

from keyspan.config import DEFAULT, INTERVAL_KEYS, AnalysisConfig
from keyspan.functions.skew import checkpointed, hot_keys, split_hot
from keyspan.operators import align, profiles, quality, sequence, summarize

# Rows of ordinary intervals, and those of hot intervals if there are any.
Parts = tuple[DataFrame, DataFrame | None]
Operator = Callable[[DataFrame, AnalysisConfig], DataFrame]


class Analysis:
    """Lazily built stage tables of one gaze table.

    Rows are counted first. Only if there are more than ``cfg.hot_rows`` of them, rows per interval are counted for
    those that are hot (more than ``cfg.hot_rows`` rows each). Without any hot one, every stage is one plan with one
    shuffle by interval. With some, their rows take a second path that never gathers an interval in one task, and the
    two results are unioned.
    """

    def __init__(self, gaze: DataFrame, cfg: AnalysisConfig = DEFAULT, n_rows: int | None = None):
        self.gaze = gaze
        self.cfg = cfg
        if n_rows is not None:  # known to the caller
            self.n_rows = n_rows

    @cached_property
    def n_rows(self) -> int:
        return self.gaze.count()

    @cached_property
    def hot_intervals(self) -> DataFrame | None:
        return hot_keys(self.gaze, INTERVAL_KEYS, self.cfg.hot_rows, self.n_rows)

    @cached_property
    def n_recordings(self) -> int:
        """Recordings, counted no further than the broadcast limit needs; a table within it has no more than rows."""
        limit = self.cfg.broadcast_groups
        return self.n_rows if self.n_rows <= limit else self.gaze.select("Recording").distinct().limit(limit + 1).count()

    @cached_property
    def _keyed(self) -> Parts:
        if self.hot_intervals is None:
            return align.attach_key_event(self.gaze, self.cfg), None
        cold, hot = split_hot(self.gaze, INTERVAL_KEYS, self.hot_intervals)
        return align.attach_key_event(cold, self.cfg), align.attach_key_event_hot(hot, self.cfg)

    @cached_property
    def _aligned(self) -> Parts:
        return self._step(self._keyed, align.align_keyed, align.align_keyed)

    @cached_property
    def _sequenced(self) -> Parts:
        cold, hot = self._aligned
        # Numbering keeps every row, so groups can be sized first, while their rows are at hand. Hot rows are stored
        # for numbering, and sized from there.
        numbered = sequence.sequence_events(sequence.with_group_size(cold, self.cfg), self.cfg)
        if hot is None:
            return numbered, None
        return numbered, sequence.with_group_size_hot(sequence.sequence_events_hot(hot, self.cfg), self.cfg)

    def _step(self, parts: Parts, ordinary: Operator, for_hot: Operator) -> Parts:
        cold, hot = parts
        return ordinary(cold, self.cfg), None if hot is None else for_hot(hot, self.cfg)

    @cached_property
    def keyed(self) -> DataFrame:
        """All rows with the key event of their interval, NULL where it has none."""
        return _union(self._keyed)

    @cached_property
    def aligned(self) -> DataFrame:
        """Relevant, valid rows on their side of the key event."""
        return _union(self._aligned)

    @cached_property
    def numbered_with_sizes(self) -> DataFrame:
        """Aligned rows, numbered outwards from the key event, with the size of their group (``GroupRows``)."""
        return _union(self._sequenced)

    @cached_property
    def sequenced(self) -> DataFrame:
        """Aligned rows, numbered outwards from the key event."""
        return self.numbered_with_sizes.drop("GroupRows")

    @cached_property
    def final(self) -> DataFrame:
        """Numbered rows of the labels that have enough of them."""
        return sequence.large_groups(_union(self._sequenced), self.cfg)

    @cached_property
    def rollup(self) -> DataFrame:
        """Sums and counts from which every summary is folded, stored: one pass over the rows for all of them."""
        return checkpointed(summarize.rollup(self.final))

    def stored(self) -> Analysis:
        """The same analysis with its numbered rows written to the checkpoint folder.

        For several reports in one application: each then reads the numbered rows with their group sizes
        and needs no shuffle by interval of its own.
        """
        copy = Analysis(self.gaze, self.cfg)
        copy.n_rows = self.n_rows
        copy.hot_intervals = self.hot_intervals
        copy._sequenced = (checkpointed(_union(self._sequenced)), None)
        return copy

    @cached_property
    def marked(self) -> DataFrame:
        """Final rows with a flag for those inside the outlier bounds."""
        return quality.mark_outliers(self.final, self.cfg, self.n_recordings)

    @cached_property
    def outlier_filtered(self) -> DataFrame:
        return quality.outlier_filtered(self.marked)

    @cached_property
    def profile_rows(self) -> DataFrame:
        """Rows of the mean profiles. They come from all numbered rows, small groups included."""
        return profiles.sequence_metric_rows(self.sequenced, self.cfg)

    @cached_property
    def filtered_profile_rows(self) -> DataFrame:
        """Rows of the mean and median profiles: without small groups and without outliers."""
        return profiles.sequence_metric_rows_filtered(self.outlier_filtered, self.cfg)

    @cached_property
    def profile_per_recording(self) -> DataFrame:
        """Mean and median profile of each recording."""
        return profiles.mean_median_per_recording(self.filtered_profile_rows, self.cfg)

    @cached_property
    def profile_overall(self) -> DataFrame:
        """Mean and median profile over all recordings."""
        return profiles.mean_median_overall(self.filtered_profile_rows, self.cfg)

    def stage_counts(self) -> DataFrame:
        return sequence.stage_counts(self.keyed, align.is_aligned(self.cfg), self.cfg)

    def interval_counts(self) -> DataFrame:
        return sequence.interval_counts(self.keyed, align.is_aligned(self.cfg), self.cfg)


def _union(parts: Parts) -> DataFrame:
    cold, hot = parts
    return cold if hot is None else cold.unionByName(hot)
