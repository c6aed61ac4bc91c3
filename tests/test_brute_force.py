"""Alignment, numbering, sizes and outliers against a plain row-by-row computation on random tables."""

import random
import statistics

import pytest
from helpers import gaze, rows

from keyspan.config import AnalysisConfig
from keyspan.plans.analysis import Analysis

BEFORE = {"FPEn", "FPEn2", "FPEn3", "FPEn4", "FPEt"}
AFTER = {"PEn", "PEn2", "PEn3", "PEn4", "PEt"}


def random_events(seed, n=1500):
    rnd = random.Random(seed)
    events = []
    for _ in range(n):
        start = float(rnd.choice(range(4000, 6000, 50)))
        # A third of all rows fall into one interval.
        hot = rnd.random() < 0.34
        events.append(
            {
                "Recording": "R0" if hot else rnd.choice(["R1", "R2", None]),
                "Participant": "P0" if hot else rnd.choice(["P1", "P2"]),
                "Interval": 1 if hot else rnd.choice([1, 2, 3]),
                "TOI": rnd.choice(["FPEn", "FPEn2", "FPEt", "PEn", "PEn2", "PEt", "EA", "Other"]),
                "Event_type": rnd.choice(["Fixation", "Fixation", "Saccade", "Blink", None]),
                "Validity": rnd.choice(["Whole"] * 6 + ["Partial", None]),
                "Start": None if rnd.random() < 0.02 else start,
                "Stop": None if rnd.random() < 0.02 else start + rnd.choice([50.0, 100.0, 150.0]),
                "Duration": rnd.choice([None, 100.0, 110.0, 120.0, 130.0, 3000.0]),
                "Saccade_amplitude": rnd.choice([None, 1.0, 2.5, 3.0]),
            }
        )
    return events


def at_most(a, b):
    return a is not None and b is not None and a <= b


def expected(events):
    """{row number: (key start, key stop, key type, fixation number, saccade number)} and kept row numbers."""
    rows_ = [{"RowId": i, **e} for i, e in enumerate(events, start=1)]
    labels = {}
    for row in rows_:
        labels.setdefault((row["Recording"], row["Participant"], row["TOI"], row["Interval"]), []).append(row)
    label_key = {}
    for label, members in labels.items():
        running = [m for m in members if at_most(m["Start"], 5000) and m["Stop"] is not None and m["Stop"] > 5000]
        if running:
            label_key[label] = running[0]
    keys, types = {}, {}
    for row in rows_:
        label = (row["Recording"], row["Participant"], row["TOI"], row["Interval"])
        interval = (row["Recording"], row["Participant"], row["Interval"])
        found = label_key.get(label)
        if found:
            keys.setdefault(interval, (found["Start"], found["Stop"]))
            if found["Event_type"] is not None:
                types.setdefault(interval, found["Event_type"])
    result, groups = {}, {}
    for row in rows_:
        interval = (row["Recording"], row["Participant"], row["Interval"])
        if interval not in keys or row["Validity"] != "Whole":
            continue
        start, stop = keys[interval]
        own_side = (row["TOI"] in BEFORE and at_most(row["Stop"], stop)) or (
            row["TOI"] in AFTER and at_most(start, row["Start"])
        )
        if own_side:
            result[row["RowId"]] = [start, stop, types.get(interval), None, None]
            groups.setdefault((interval, row["TOI"]), []).append(row)
    for (interval, _), members in groups.items():
        start, stop = keys[interval]
        members.sort(key=lambda m: (m["Start"] is None, m["Start"] or 0, m["RowId"]))
        for place, kind in ((3, "Fixation"), (4, "Saccade")):
            own = [m for m in members if m["Event_type"] == kind]
            is_key = [m for m in own if m["Start"] == start and m["Stop"] == stop]
            before = [m for m in own if at_most(m["Stop"], start)]
            after = [m for m in own if m["Start"] is not None and m["Start"] > start]
            for m in is_key:
                result[m["RowId"]][place] = 0
            for number, m in enumerate(sorted(before, key=lambda m: -m["Stop"]), start=1):
                result[m["RowId"]][place] = -number
            for number, m in enumerate(after, start=1):
                result[m["RowId"]][place] = number
    final = [m for members in groups.values() if len(members) >= 10 for m in members]
    return {k: tuple(v) for k, v in result.items()}, final


def expected_unfiltered(final):
    """Row numbers that stay inside mean +- 3 deviations of their recording, or are of another type."""
    def bounds(recording, kind, column):
        values = [
            m[column] for m in final
            if m["Recording"] == recording and m["Event_type"] == kind and m[column] is not None
        ]
        if len(values) < 2 or statistics.stdev(values) == 0:
            return float("-inf"), float("inf")
        mean, deviation = statistics.fmean(values), statistics.stdev(values)
        return mean - 3 * deviation, mean + 3 * deviation

    kept = set()
    for m in final:
        column = {"Fixation": "Duration", "Saccade": "Saccade_amplitude"}.get(m["Event_type"])
        if column is None:
            kept.add(m["RowId"])
        elif m[column] is not None:
            low, high = bounds(m["Recording"], m["Event_type"], column)
            if low <= m[column] <= high:
                kept.add(m["RowId"])
    return kept


CONFIGS = {
    "ordinary": AnalysisConfig(),
    "hot intervals": AnalysisConfig(hot_rows=100),
    "many recordings": AnalysisConfig(broadcast_groups=1),
    "all hot": AnalysisConfig(hot_rows=1, broadcast_groups=2),
    "only the largest hot": AnalysisConfig(hot_rows=400),
}


@pytest.mark.parametrize("name", CONFIGS)
@pytest.mark.parametrize("seed", [1, 2])
def test_random_tables(spark, name, seed):
    events = random_events(seed)
    want, final = expected(events)
    # Rows arrive in any order and partitioning; RowId alone carries the input order.
    analysis = Analysis(gaze(spark, events).orderBy("Duration", "Stop").repartition(5), CONFIGS[name])
    found = analysis.sequenced.select(
        "RowId", "KeyEventStart", "KeyEventStop", "KeyEventType", "FixationSequence", "SaccadeSequence"
    ).collect()
    assert {row[0]: tuple(row[1:]) for row in found} == want
    assert [r[0] for r in rows(analysis.final, "RowId")] == [
        r[0] for r in sorted(((m["RowId"],) for m in final), key=repr)
    ]
    assert {row.RowId for row in analysis.outlier_filtered.select("RowId").collect()} == expected_unfiltered(final)
    totals = {row.Stage: row.Rows for row in analysis.stage_counts().collect()}
    assert totals == {"input": len(events), "aligned": len(want), "sequenced": len(want), "final": len(final)}


def test_hot_paths_are_taken(spark):
    table = gaze(spark, random_events(1))
    assert Analysis(table, CONFIGS["ordinary"]).hot_intervals is None
    assert Analysis(table, CONFIGS["hot intervals"]).hot_intervals.count() == 1
    assert Analysis(table, CONFIGS["many recordings"]).n_recordings == 2  # stops one above the limit


def test_stored_rows_give_the_same_results(spark):
    analysis = Analysis(gaze(spark, random_events(3)), CONFIGS["hot intervals"])
    assert analysis.final.count() > 0
    stored = analysis.stored()
    assert "Window" not in stored.final._jdf.queryExecution().executedPlan().toString()
    for stage in ("sequenced", "final", "outlier_filtered", "profile_rows", "filtered_profile_rows"):
        left, right = getattr(analysis, stage), getattr(stored, stage)
        assert left.columns == right.columns
        assert rows(left, *left.columns) == rows(right, *left.columns)
