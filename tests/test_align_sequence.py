"""Alignment and numbering on hand-computed tables."""

from helpers import event, gaze, rows
from pyspark.sql import functions as F

from keyspan.operators import align, profiles, sequence
from keyspan.plans.analysis import Analysis
from keyspan.plans.queries import analysis_of

OVERLAPS = [
    event("EA", "Fixation", 4900, 5100),
    event("FPEn", "Fixation", 4000, 4300),
    event("FPEn", "Saccade", 4300, 4350, 2.0),
    event("FPEn", "Fixation", 4350, 4900),
    event("FPEn", "Fixation", 4900, 5100),
    event("FPEn", "Fixation", 5100, 5300),
    event("FPEn", "Saccade", 4860, 4950, 1.0),
    event("PEn", "Fixation", 4900, 5100),
    event("PEn", "Saccade", 5100, 5140, 3.0),
    event("PEn", "Fixation", 5140, 5500),
    event("PEn", "Fixation", 5500, 5600, Validity="Partial"),
    event("PEn", "Fixation", 5140, 5200),
    event("PEn", "Fixation", 4900, 5000),
    event("FPEn", "Fixation", 100, 200, Interval=2),
]

FIRST_ROWS = [
    event("Other", None, 4990, 5010),
    event("PEn", "Saccade", 4950, 5050),
    event("PEn", "Fixation", 5010, 5200),
    event("PEn", "Fixation", 4990, 5300),
    event("PEn", "Fixation", 4800, 5200, Interval=2),
    event("PEn", "Fixation", 4700, 5100, Interval=2),
    event("FPEt", "Fixation", 5000, 5100, Interval=3),
    event("FPEt", "Fixation", 4900, 5000, Interval=4),
    event("FPEn", "Fixation", 4000, 4500, Interval=5),
    event("FPEn", "Fixation", 3900, 4500, Interval=5),
    event("FPEn", "Fixation", 4950, 5050, Interval=5),
]


def numbered(spark, events):
    seqd = Analysis(gaze(spark, events)).sequenced
    found = seqd.select("RowId", "FixationSequence", "SaccadeSequence").collect()
    return {row[0]: row[1] if row[1] is not None else row[2] for row in found}


def test_key_event_is_searched_before_any_filter(spark):
    aligned = align.align_to_key_event(gaze(spark, OVERLAPS))
    assert rows(aligned.select("KeyEventStart", "KeyEventStop").distinct(), "KeyEventStart", "KeyEventStop") == [
        (4900.0, 5100.0)
    ]
    assert "EA" not in {row.TOI for row in aligned.collect()}


def test_sequences_and_exclusions(spark):
    expected = {2: -2, 3: -1, 4: -1, 5: 0, 7: None, 8: 0, 9: 1, 10: 1, 12: 2, 13: None}
    assert numbered(spark, OVERLAPS) == expected


def test_small_groups_are_dropped(spark):
    seqd = Analysis(gaze(spark, OVERLAPS)).sequenced
    assert sequence.min_group_size(seqd).count() == 0
    assert rows(sequence.with_group_size(seqd), "GroupRows") == [(5,)] * 10


def test_first_rows_boundaries_and_ties(spark):
    assert numbered(spark, FIRST_ROWS) == {3: 1, 4: None, 5: 0, 7: 0, 9: -2, 10: -1, 11: 0}


def test_type_and_times_of_the_key_event_may_differ_in_origin(spark):
    found = align.key_event_per_interval(gaze(spark, FIRST_ROWS))
    assert rows(found.filter("Interval = 1"), "KeyEventStart", "KeyEventStop", "KeyEventType") == [
        (4990.0, 5010.0, "Saccade")
    ]


def test_labels_count_in_the_order_of_their_first_row(spark):
    events = [
        event("FPEn", "Fixation", 100, 200),
        event("PEn", "Saccade", 4950, 5050),
        event("FPEn", "Fixation", 4900, 5100),
    ]
    table = gaze(spark, events)
    expected = [(4900.0, 5100.0, "Fixation")]
    names = ("KeyEventStart", "KeyEventStop", "KeyEventType")
    assert rows(align.key_event_per_interval(table), *names) == expected
    assert rows(align.attach_key_event(table).select(*names).distinct(), *names) == expected


def test_key_event_per_label_takes_the_first_row(spark):
    events = [event("FPEn", "Saccade", 4990, 5020), event("FPEn", "Fixation", 4800, 5200)]
    found = align.key_event_per_label(gaze(spark, events))
    assert rows(found, "TOI", "KeyEventStart", "KeyEventStop", "KeyEventType") == [
        ("FPEn", 4990.0, 5020.0, "Saccade")
    ]


def test_missing_keys_form_a_group(spark):
    events = [
        event("FPEn", "Fixation", 4900, 5100, Recording=None, Participant=None),
        event("FPEn", "Fixation", 4500, 4600, Recording=None, Participant=None),
    ]
    assert numbered(spark, events) == {1: 0, 2: -1}
    assert align.key_event_per_interval(gaze(spark, events)).count() == 1


def test_missing_times(spark):
    events = [
        event("FPEn", "Fixation", 4900, 5100),
        {"TOI": "FPEn", "Start": None, "Stop": 4000.0},
        {"TOI": "FPEn", "Start": 3000.0, "Stop": None},
        {"TOI": "FPEn", "Start": 3500.0, "Stop": 4000.0},
        {"TOI": "FPEn", "Start": float("nan"), "Stop": 100.0},
    ]
    # Without a stop a before row is dropped; without a start it is last among equal stops.
    assert numbered(spark, events) == {1: 0, 2: -2, 4: -1, 5: -3}


def test_counts_and_checks(spark):
    analysis = Analysis(gaze(spark, OVERLAPS))
    assert rows(analysis.stage_counts(), "Stage", "Rows") == [
        ("aligned", 10),
        ("final", 0),
        ("input", 14),
        ("sequenced", 10),
    ]
    assert rows(analysis.interval_counts(), "Stage", "Groups") == [("final", 0), ("sequenced", 2)]
    assert rows(align.key_event_consistency(analysis.aligned), "N_Unique_Start", "Inconsistent") == [(1, False)]
    before = align.spot_check_before(analysis.aligned, Recording="R1", Interval=1, TOI="FPEn")
    assert rows(before, "MaxStop", "KeyEventStop", "WithinKeyEvent") == [(5100.0, 5100.0, True)]
    after = align.spot_check_after(analysis.aligned, Participant="P1")
    assert rows(after, "MinStart", "KeyEventStart", "WithinKeyEvent") == [(4900.0, 4900.0, True)]
    assert rows(align.remaining_labels(analysis.aligned), "Field", "Value") == [
        ("TOI", "FPEn"),
        ("TOI", "PEn"),
        ("Validity", "Whole"),
    ]


def test_invariants_on_derived_data(spark):
    analysis = analysis_of(spark, "/root/testdata/sf0.01")
    number = sequence.unified_sequence()
    groups = (
        analysis.sequenced.filter(number != 0)
        .groupBy("Recording", "Participant", "TOI", "Interval", "Event_type", F.signum(number).alias("side"))
        .agg(F.max(F.abs(number)).alias("last"), F.count(number).alias("n"), F.count_distinct(number).alias("different"))
    )
    assert groups.count() > 100
    assert groups.filter("last <> n OR different <> n").count() == 0
    assert align.key_event_consistency(analysis.aligned).filter("Inconsistent").count() == 0
    assert align.spot_check_before(analysis.aligned).filter("NOT WithinKeyEvent").count() == 0
    assert align.spot_check_after(analysis.aligned).filter("NOT WithinKeyEvent").count() == 0
    for row in profiles.sequence_range_check(analysis.profile_rows).collect():
        before = row.TOI_Category in ("Combined_FPEnX", "FPEt")
        assert (-5 <= row.MinSeq and row.MaxSeq <= -1) if before else (0 <= row.MinSeq and row.MaxSeq <= 5)
