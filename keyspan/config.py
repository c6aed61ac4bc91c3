"""Labels, categories, thresholds and size limits used by every operator."""

from __future__ import annotations

from dataclasses import dataclass

# Label, category, combination, event-type and metric names and thresholds that results are
# defined by.
FPEN_FAMILY = ("FPEn", "FPEn2", "FPEn3", "FPEn4")
PEN_FAMILY = ("PEn", "PEn2", "PEn3", "PEn4")
FPET = "FPEt"
PET = "PEt"
EA = "EA"
FIXATION = "Fixation"
SACCADE = "Saccade"
WHOLE = "Whole"
FPENX = "Combined_FPEnX"
PENX = "Combined_PEnX"
BEFORE = "Combined_Before"
AFTER = "Combined_After"
BEFORE_EVENT = "BeforeEvent"
AFTER_EVENT = "AfterEvent"
FPENX_PENX = "FPEnX + PEnX"
FPET_PET = "FPEt + PEt"
FPEN_PEN = "FPEn + PEn"
FIXATION_METRIC = "Avg Fixation Duration (ms)"
SACCADE_METRIC = "Avg Saccade Amplitude (deg)"
ANCHOR_MS = 5000.0
MIN_ROWS = 10
MIN_SEQUENCE = -5
MAX_SEQUENCE = 5
SD_LIMIT = 3.0
SHORT_FIXATION_MS = 80.0
LONG_FIXATION_MS = 1500.0
SMALL_SACCADE_DEG = 1.0
LARGE_SACCADE_DEG = 40.0
HISTOGRAM_BINS = 50

# Column groups that the operators share.
INTERVAL_KEYS = ("Recording", "Participant", "Interval")
LABEL_KEYS = (*INTERVAL_KEYS, "TOI")


@dataclass(frozen=True)
class AnalysisConfig:
    """Every parameter of the analysis; the defaults are the standard study set-up."""

    anchor_ms: float = ANCHOR_MS
    fpen_family: tuple[str, ...] = FPEN_FAMILY
    pen_family: tuple[str, ...] = PEN_FAMILY
    fpet: str = FPET
    pet: str = PET
    ea: str = EA
    valid_value: str = WHOLE
    min_rows: int = MIN_ROWS
    min_sequence: int = MIN_SEQUENCE
    max_sequence: int = MAX_SEQUENCE
    sd_limit: float = SD_LIMIT
    short_fixation_ms: float = SHORT_FIXATION_MS
    long_fixation_ms: float = LONG_FIXATION_MS
    small_saccade_deg: float = SMALL_SACCADE_DEG
    large_saccade_deg: float = LARGE_SACCADE_DEG
    histogram_bins: int = HISTOGRAM_BINS
    # An interval with more rows than this is "hot": it is never windowed in one task.
    hot_rows: int = 5_000_000
    # The stored gaze table is already clustered by interval (bucketed by Recording, Participant and
    # Interval), so that the shuffle by interval can be left out.
    clustered: bool = False
    # Per-recording statistics are broadcast only up to this many recordings (about 5 MB).
    broadcast_groups: int = 100_000
    # How often the range of a quantile is narrowed before its values are counted: once serves groups of some
    # billion values, each further time 300 times as many.
    quantile_rounds: int = 1
    # Folders of a written series of very many entities.
    series_buckets: int = 32

    @property
    def before_labels(self) -> tuple[str, ...]:
        """Labels whose events are cut to the time before the key event."""
        return (*self.fpen_family, self.fpet)

    @property
    def after_labels(self) -> tuple[str, ...]:
        """Labels whose events are cut to the time after the key event."""
        return (*self.pen_family, self.pet)

    @property
    def relevant_labels(self) -> tuple[str, ...]:
        return self.before_labels + self.after_labels

    @property
    def first_instance_labels(self) -> tuple[str, ...]:
        """The first label of each family."""
        return (self.fpen_family[0], self.pen_family[0])

    @property
    def four_categories(self) -> dict[str, tuple[str, ...]]:
        return {
            FPENX: self.fpen_family,
            FPET: (self.fpet,),
            PENX: self.pen_family,
            PET: (self.pet,),
        }

    @property
    def profile_categories(self) -> dict[str, tuple[str, ...]]:
        return {
            FPENX: self.fpen_family,
            FPET: (self.fpet,),
            EA: (self.ea,),
            PENX: self.pen_family,
            PET: (self.pet,),
        }

    @property
    def overall_categories(self) -> dict[str, tuple[str, ...]]:
        """Categories of the long overall summary; one label may belong to several."""
        return {
            EA: (self.ea,),
            FPENX: self.fpen_family,
            FPET: (self.fpet,),
            BEFORE: (self.ea, *self.before_labels),
            PENX: self.pen_family,
            PET: (self.pet,),
            AFTER: self.after_labels,
        }

    @property
    def before_categories(self) -> tuple[str, ...]:
        return (FPENX, FPET, EA)

    @property
    def after_categories(self) -> tuple[str, ...]:
        return (PENX, PET)


DEFAULT = AnalysisConfig()
