"""Summaries, profiles, quality checks and key-event reports on hand-computed tables."""

import math

import pytest
from helpers import event, gaze, rows, same
from pyspark.sql import functions as F

from keyspan.config import AnalysisConfig
from keyspan.operators import keyrow, profiles, quality, summarize
from keyspan.plans.analysis import Analysis


@pytest.fixture(scope="module")
def final(spark):
    events = [
        {"TOI": "FPEn", "Duration": 100.0},
        {"TOI": "FPEn"},
        {"TOI": "FPEn", "Event_type": "Saccade", "Saccade_amplitude": 2.0},
        {"TOI": "FPEn", "Event_type": "Unclassified"},
        {"TOI": "FPEn", "Event_type": None},
        {"TOI": "PEn", "Event_type": "Saccade", "Saccade_amplitude": 3.0},
        {"TOI": "PEn", "Event_type": "Saccade", "Saccade_amplitude": 5.0},
        {"TOI": "FPEt", "Duration": 300.0},
    ]
    return gaze(spark, events)


def test_label_summaries(final):
    fixations = summarize.fixation_summary_per_label(final)
    saccades = summarize.saccade_summary_per_label(final)
    assert rows(fixations, "TOI", "AvgFixationDuration", "N_Fixations") == [("FPEn", 100.0, 2), ("FPEt", 300.0, 1)]
    assert rows(saccades, "TOI", "AvgSaccadeAmplitude", "N_Saccades") == [("FPEn", 2.0, 1), ("PEn", 4.0, 2)]
    columns = ("TOI", "AvgFixationDuration", "N_Fixations", "AvgSaccadeAmplitude", "N_Saccades")
    expected = [("FPEn", 100.0, 2, 2.0, 1), ("FPEt", 300.0, 1, None, None), ("PEn", None, None, 4.0, 2)]
    assert rows(summarize.summary_per_label(final), *columns) == expected
    assert rows(summarize.join_label_summaries(fixations, saccades), *columns) == expected


def test_missing_keys_match_in_the_join(spark):
    table = gaze(
        spark,
        [
            {"Recording": None, "Duration": 10.0},
            {"Recording": None, "Event_type": "Saccade", "Saccade_amplitude": 1.0},
        ],
    )
    joined = summarize.join_label_summaries(
        summarize.fixation_summary_per_label(table), summarize.saccade_summary_per_label(table)
    )
    assert rows(joined, "Recording", "N_Fixations", "N_Saccades") == [(None, 1, 1)]


def test_participant_summaries(final):
    columns = ("AvgFixDuration", "N_Fix", "AvgSaccAmplitude", "N_Sacc")
    assert rows(summarize.before_after_summary(final), "TimeWindowGroup", *columns) == [
        ("AfterEvent", None, 0, 4.0, 2),
        ("BeforeEvent", 200.0, 3, 2.0, 1),
    ]
    assert rows(summarize.fpenx_penx_per_participant(final), *columns) == [(100.0, 2, 10.0 / 3, 3)]
    assert rows(summarize.fpet_pet_per_participant(final), *columns) == [(300.0, 1, None, 0)]
    fpen = summarize.combined_fpen_summary(final)
    assert fpen.columns[2:] == [name + "_All_FPEn" for name in columns]
    assert rows(fpen, *fpen.columns[2:]) == [(100.0, 2, 2.0, 1)]
    assert rows(summarize.combined_pen_summary(final), "N_Fix_All_PEn", "N_Sacc_All_PEn") == [(0, 2)]
    assert rows(summarize.fpet_summary(final), "AvgFixDuration_FPEt") == [(300.0,)]
    assert summarize.pet_summary(final).count() == 0


def test_overall_summaries(final):
    columns = ("TOI_Category", "Event_type", "AvgDuration", "AvgAmplitude", "N")
    assert rows(summarize.overall_four_categories(final), *columns) == [
        ("Combined_FPEnX", "Fixation", 100.0, None, 2),
        ("Combined_FPEnX", "Saccade", None, 2.0, 1),
        ("Combined_FPEnX", "Unclassified", None, None, 1),
        ("Combined_PEnX", "Saccade", None, 4.0, 2),
        ("FPEt", "Fixation", 300.0, None, 1),
    ]
    long = summarize.overall_summary_long(final, F.col("TOI") == "FPEn", "mine")
    assert rows(long, "Category", "Event_type", "MetricType", "AvgMetric", "N") == [
        ("mine", "Fixation", "AvgDuration", 100.0, 2),
        ("mine", "Saccade", "AvgAmplitude", 2.0, 1),
    ]
    everything = rows(
        summarize.all_overall_summaries(final), "CategoryOrder", "Category", "MetricType", "AvgMetric", "N"
    )
    assert everything == [
        (2, "Combined_FPEnX", "AvgAmplitude", 2.0, 1),
        (2, "Combined_FPEnX", "AvgDuration", 100.0, 2),
        (3, "FPEt", "AvgDuration", 300.0, 1),
        (4, "Combined_Before", "AvgAmplitude", 2.0, 1),
        (4, "Combined_Before", "AvgDuration", 200.0, 3),
        (5, "Combined_PEnX", "AvgAmplitude", 4.0, 2),
        (7, "Combined_After", "AvgAmplitude", 4.0, 2),
    ]
    assert rows(summarize.fpenx_penx_overall(final), "TOI_Combination", "Event_type", "N") == [
        ("FPEnX + PEnX", "Fixation", 2),
        ("FPEnX + PEnX", "Saccade", 3),
        ("FPEnX + PEnX", "Unclassified", 1),
    ]


def test_metrics_without_values_are_dropped(spark):
    table = gaze(spark, [{"TOI": "FPEt"}, {"TOI": "FPEt", "Event_type": "Saccade"}])
    assert summarize.fpet_pet_overall(table).count() == 0


def outlier_events():
    events = [{"Recording": "RA", "Duration": 100.0}] * 11 + [{"Recording": "RA", "Duration": 1000.0}]
    events += [{"Recording": "RB", "Duration": 100.0}] * 9 + [{"Recording": "RB", "Duration": 1000.0}]
    events += [{"Recording": "RC", "Event_type": "Saccade", "Saccade_amplitude": 50.0}]
    events += [{"Recording": "RD", "Duration": 100.0}] * 3
    events += [{"Recording": "RE", "Duration": value} for value in (100.0, 110.0, None)]
    events += [{"Recording": "RE", "Event_type": kind} for kind in (None, "Unclassified")]
    return events


@pytest.mark.parametrize("recordings", [5, None])
def test_outlier_filter(spark, recordings):
    table = gaze(spark, outlier_events())
    cfg = AnalysisConfig(broadcast_groups=100 if recordings else 2)
    marked = quality.mark_outliers(table, cfg, recordings)
    kept = {row.Recording: row["count"] for row in quality.outlier_filtered(marked).groupBy("Recording").count().collect()}
    assert kept == {"RA": 11, "RB": 10, "RC": 1, "RD": 3, "RE": 4}
    assert rows(quality.outlier_removed_counts(marked), "N_Before", "N_After", "N_Removed") == [(31, 29, 2)]
    assert quality.outlier_filtered(marked).columns == table.columns


def test_outlier_statistics(spark):
    stats = {row.Recording: row for row in quality.outlier_stats(gaze(spark, outlier_events())).collect()}
    assert (stats["RA"].mean_dur, round(stats["RA"].sd_dur, 4)) == (175.0, 259.8076)
    assert stats["RC"].sd_amp == math.inf and stats["RC"].mean_dur is None
    assert stats["RD"].sd_dur == math.inf
    shown = quality.readable_outlier_stats(quality.outlier_stats(gaze(spark, outlier_events())))
    assert rows(shown.filter("Recording = 'RD'"), "sd_dur", "unbounded_dur") == [(None, True)]


def test_quality_reports(spark):
    durations = [70.0, 79.0, 80.0, 1500.0, 1501.0, None]
    amplitudes = [0.5, 1.0, 40.0, 41.0]
    events = [{"Duration": value} for value in durations]
    events += [{"Event_type": "Saccade", "Saccade_amplitude": value} for value in amplitudes]
    table = gaze(spark, events)
    assert tuple(quality.implausible_counts(table).first()) == (2, 1, 1, 1)
    stats = quality.fixation_duration_stats(table).first()
    assert tuple(stats) == (70.0, 79.0, 80.0, 646.0, 1500.0, 1501.0, 1)
    assert tuple(quality.saccade_amplitude_stats(table).first()) == (0.5, 0.875, 20.5, 20.625, 40.25, 41.0, 0)
    nothing = quality.fixation_duration_stats(gaze(spark, [{"Duration": None}] * 3)).first()
    assert tuple(nothing) == (None, None, None, None, None, None, 3)
    empty = quality.fixation_duration_stats(gaze(spark, [{"Event_type": None}])).first()
    assert tuple(empty) == (None, None, None, None, None, None, 0)
    bins = rows(quality.histogram(table, F.col("Duration"), 3), "Bin", "BinStart", "Count")
    assert bins == [(0, 70.0, 3), (2, 1024.0, 2)]
    same_value = gaze(spark, [{"Duration": 5.0}] * 4)
    assert rows(quality.fixation_histogram(same_value), "Bin", "BinStart", "Count") == [(0, 5.0, 4)]


def test_overlay_scaling(spark):
    points = [
        ("P1", "Fixation", -1, 200.0), ("P1", "Fixation", 1, 400.0), ("P1", "Saccade", -1, 2.0), ("P1", "Saccade", 1, 6.0),
        ("P2", "Fixation", 0, 200.0), ("P2", "Saccade", 0, 3.0),
        ("P3", "Fixation", -1, 200.0), ("P3", "Fixation", 1, 300.0),
        ("P4", "Fixation", -1, 1.0), ("P4", "Fixation", 1, float("inf")), ("P4", "Saccade", 1, 2.0), ("P4", "Saccade", 2, 3.0),
    ]
    df = spark.createDataFrame(points, "Participant string, Event_type string, Sequence long, AvgMetric double")
    scaled = profiles.overlay_scale(df, ["Participant"])
    assert rows(scaled, "Participant", "Event_type", "Sequence", "ScalingFactor", "ScaledMetric") == [
        ("P1", "Fixation", -1, 50.0, 200.0),
        ("P1", "Fixation", 1, 50.0, 400.0),
        ("P1", "Saccade", -1, 50.0, 100.0),
        ("P1", "Saccade", 1, 50.0, 300.0),
        ("P2", "Fixation", 0, 1.0, 200.0),
        ("P2", "Saccade", 0, 1.0, 3.0),
        ("P4", "Fixation", -1, 1.0, 1.0),
        ("P4", "Fixation", 1, 1.0, float("inf")),
        ("P4", "Saccade", 1, 1.0, 2.0),
        ("P4", "Saccade", 2, 1.0, 3.0),
    ]


def seven_before_and_after():
    """Seven fixations each before and after, of 10, 20, .. 70 ms by distance, and the key event."""
    events = [event("FPEn", "Fixation", 4950, 5050), event("PEn", "Fixation", 4950, 5050)]
    for i in range(1, 8):
        events.append(event("FPEn", "Fixation", 4900 - 100 * i, 4900 - 100 * i + 50) | {"Duration": 10.0 * i})
        events.append(event("PEn", "Fixation", 5000 + 100 * i, 5000 + 100 * i + 50) | {"Duration": 10.0 * i})
    return events


def test_profile_rows_take_their_side_and_range(spark):
    analysis = Analysis(gaze(spark, seven_before_and_after()))
    found = rows(analysis.profile_rows.filter("TOI = 'FPEn'"), "Sequence", "Metric")
    assert sorted(found) == [(-5, 50.0), (-4, 40.0), (-3, 30.0), (-2, 20.0), (-1, 10.0)]
    found = rows(analysis.profile_rows.filter("TOI = 'PEn'"), "Sequence", "Metric")
    assert sorted(found) == [(0, 100.0), (1, 10.0), (2, 20.0), (3, 30.0), (4, 40.0), (5, 50.0)]
    # Groups of eight rows are in the mean profiles but not in the mean and median ones.
    assert analysis.filtered_profile_rows.count() == 0
    ranges = rows(profiles.sequence_range_check(analysis.profile_rows), "TOI_Category", "MinSeq", "MaxSeq", "N_Rows")
    assert ranges == [("Combined_FPEnX", -5, -1, 5), ("Combined_PEnX", 0, 5, 6)]
    assert rows(profiles.sequence_zero_categories(analysis.profile_rows), "TOI_Category") == [("Combined_PEnX",)]


def test_removed_outliers_leave_gaps(spark):
    events = [e | {"Duration": 100.0} for e in seven_before_and_after() if e["TOI"] == "PEn"]
    events += [event("PEn", "Fixation", 6000 + 100 * i, 6000 + 100 * i + 50) | {"Duration": 100.0} for i in range(9)]
    events[2]["Duration"] = 9000.0
    analysis = Analysis(gaze(spark, events))
    assert sorted(r[0] for r in rows(analysis.filtered_profile_rows, "Sequence")) == [0, 1, 3, 4, 5]


def test_mean_and_median(spark):
    data = [("R1", "FPEt", "Fixation", -1, v) for v in (1.0, 2.0, 10.0, 50.0)]
    data += [("R2", "FPEt", "Fixation", -1, 7.0)]
    schema = "Recording string, TOI_Category string, Event_type string, Sequence long, Metric double"
    table = spark.createDataFrame(data, schema)
    columns = ("MeanMetric", "MedianMetric", "N", "CategoryOrder")
    per_recording = profiles.mean_median_per_recording(table)
    assert rows(per_recording, "Recording", *columns) == [("R1", 15.75, 6.0, 4, 2), ("R2", 7.0, 7.0, 1, 2)]
    overall = profiles.mean_median_overall(table)
    assert rows(overall, *columns) == [(14.0, 7.0, 5, 2)]
    assert rows(profiles.stat_series(overall), "Stat", "Value") == [("MeanMetric", 14.0), ("MedianMetric", 7.0)]
    assert rows(profiles.stat_series(overall, "Fixation", "MedianMetric"), "Value", "N") == [(7.0, 5)]
    assert profiles.stat_series(overall, "Saccade").count() == 0
    with pytest.raises(ValueError):
        profiles.stat_series(overall, stat="ModeMetric")


def test_key_event_reports(spark):
    events = [
        event("FPEn", "Fixation", 4900, 5100),
        event("PEn", "Fixation", 4900, 5100),
        event("PEn", "Saccade", 4900, 5100) | {"Recording": "R2", "Duration": 50.0},
        event("PEn", "Fixation", 4900, 5100) | {"Recording": "R3", "Duration": float("inf")},
        event("PEn", "Fixation", 4900, 5100) | {"Recording": "R4", "Duration": None},
    ]
    seqd = Analysis(gaze(spark, events)).sequenced
    found = keyrow.seq0_events(seqd)
    assert rows(found, "Recording", "TOI", "Duration") == [
        ("R1", "FPEn", 200.0),
        ("R1", "PEn", 200.0),
        ("R2", "PEn", 50.0),
    ]
    assert rows(keyrow.seq0_event_types(found), "Event_type", "N") == [("Fixation", 2), ("Saccade", 1)]
    assert rows(keyrow.seq0_duration_per_recording(found), "Recording", "AvgDuration_Seq0", "N_Seq0_Events") == [
        ("R1", 200.0, 2),
        ("R2", 50.0, 1),
    ]
    assert tuple(keyrow.seq0_duration_overall(found).first()) == (150.0, 3)
    assert rows(keyrow.seq0_recording_vs_overall(found), "AvgDuration_Seq0", "OverallAvgDuration_Seq0") == [
        (200.0, 150.0),
        (50.0, 150.0),
    ]
    detailed = keyrow.seq0_events_detailed(seqd)
    assert detailed.columns == list(keyrow.DETAIL_COLUMNS)
    shown = keyrow.seq0_events_first_rows(seqd, 2).collect()
    assert [(row.Recording, row.TOI) for row in shown] == [("R1", "FPEn"), ("R1", "PEn")]


def test_parameters_are_honoured(spark):
    cfg = AnalysisConfig(
        anchor_ms=1000.0, fpen_family=("A", "B"), pen_family=("C",), fpet="D", pet="E", min_rows=1, valid_value="ok"
    )
    events = [event("A", "Fixation", 900, 1100, Validity="ok"), event("A", "Fixation", 700, 800, Validity="ok")]
    analysis = Analysis(gaze(spark, events), cfg)
    assert rows(analysis.final, "FixationSequence") == [(-1,), (0,)]
    assert rows(analysis.profile_rows, "TOI_Category", "Sequence") == [("Combined_FPEnX", -1)]


def test_a_missing_entity_gives_no_series(spark):
    rows = [
        (p, r, "FPEnx", t, s, float(s + (t == "Fixation")))
        for p, r in (("P1", "R1"), (None, "R1"), ("P1", None))
        for t in ("Fixation", "Saccade")
        for s in (1, 2, 3)
    ]
    schema = "Participant string, Recording string, TOI_Category string, Event_type string, Sequence long, Metric double"
    table = spark.createDataFrame(rows, schema)
    assert profiles.overlay_per_participant(table).filter("Participant IS NULL").isEmpty()
    assert profiles.overlay_per_recording(table).filter("Recording IS NULL").isEmpty()
    assert not profiles.overlay_per_recording(table).isEmpty()
    assert profiles.overlay_4groups_per_recording(table).filter("Recording IS NULL").isEmpty()
    series = profiles.stat_series(profiles.mean_median_per_recording(table))
    assert series.filter("Recording IS NULL").isEmpty()
    assert not profiles.profile_per_recording(table).filter("Recording IS NULL").isEmpty()


def test_all_summaries_fold_from_one_stored_rollup(spark):
    """Reports of the rollup equal those of the rows, and read nothing else."""
    from keyspan.plans.queries import analysis_of

    a = analysis_of(spark, "/root/testdata/sf0.001")
    reports = [
        summarize.fixation_summary_per_label, summarize.saccade_summary_per_label, summarize.summary_per_label,
        summarize.combined_fpen_summary, summarize.combined_pen_summary, summarize.before_after_summary,
        summarize.fpet_summary, summarize.pet_summary, summarize.overall_four_categories,
        summarize.fpenx_penx_per_participant, summarize.fpenx_penx_overall, summarize.fpet_pet_per_participant,
        summarize.fpet_pet_overall, summarize.all_overall_summaries,
    ]
    for report in reports:
        folded = report(a.rollup)
        same(folded, report(a.final))
        assert "FileScan" not in folded._jdf.queryExecution().executedPlan().toString()
    mine = summarize.overall_summary_long(a.rollup, F.col("TOI") == "FPEn", "mine")
    same(mine, summarize.overall_summary_long(a.final, F.col("TOI") == "FPEn", "mine"))
