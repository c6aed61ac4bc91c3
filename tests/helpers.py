"""Small gaze tables and result comparison."""

from keyspan.sources.gaze import GAZE_SCHEMA, as_gaze

COLUMNS = [field.name for field in GAZE_SCHEMA]
DEFAULTS = {
    "Recording": "R1",
    "Participant": "P1",
    "TOI": "FPEn",
    "Interval": 1,
    "Event_type": "Fixation",
    "Validity": "Whole",
    "Start": None,
    "Stop": None,
    "Duration": None,
    "Saccade_amplitude": None,
}


def gaze(spark, rows):
    """Rows are dicts; missing fields take the defaults, RowId counts from 1."""
    full = []
    for number, row in enumerate(rows, start=1):
        record = {"RowId": number, **DEFAULTS, **row}
        full.append(tuple(record[name] for name in COLUMNS))
    return as_gaze(spark.createDataFrame(full, GAZE_SCHEMA))


def event(toi, event_type, start, stop, amp=None, **more):
    return {
        "TOI": toi,
        "Event_type": event_type,
        "Start": float(start),
        "Stop": float(stop),
        "Duration": float(stop - start),
        "Saccade_amplitude": amp,
        **more,
    }


def rows(df, *columns):
    """Sorted tuples of the chosen columns."""
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=repr)


def same(left, right):
    """Both tables have the same columns and the same rows, in any order."""
    assert left.dtypes == right.dtypes
    assert rows(left, *left.columns) == rows(right, *left.columns)
