"""Reading, checking and writing tables."""

import os

import pandas as pd
import pytest
from helpers import event, gaze, rows
from pyspark.sql import functions as F

from keyspan.config import AnalysisConfig
from keyspan.operators import align, quality, sequence
from keyspan.plans.queries import analysis_of
from keyspan.sources.events import gaze_from_events
from keyspan.sources.gaze import GAZE_SCHEMA, as_gaze, gaze_from_pandas, load_gaze, require_row_ids, row_id_report, with_input_order
from keyspan.sources.sinks import read_profile_series, replace_profile_series, write_profile_series


@pytest.fixture(scope="module")
def table(spark):
    return gaze(spark, [event("FPEn", "Fixation", 4900, 5100), event("PEn", "Saccade", 10, 20, 1.5)])


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_formats(spark, table, tmp_path, fmt):
    path = str(tmp_path / fmt)
    options = {"header": "true"} if fmt == "csv" else {}
    table.write.format(fmt).options(**options).save(path)
    loaded = load_gaze(spark, path, fmt, **options)
    assert dict(loaded.dtypes) == dict(table.dtypes)
    assert rows(loaded, *table.columns) == rows(table, *table.columns)


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    path = tmp_path / "gaze.csv"
    path.write_text(
        "TOI,RowId,Extra,Recording,Participant,Interval,Event_type,Validity,Start,Stop,Duration,Saccade_amplitude\n"
        "FPEn,1,x,R1,P1,2,Fixation,Whole,4900,5100.5,200.5,NA\n"
        "PEn,2,y,R1,NA,2,NA,Whole,NaN,5100.5,NA,1.25\n"
    )
    loaded = load_gaze(spark, str(path), "csv", header="true", nullValue="NA")
    assert rows(loaded, "RowId", "TOI", "Participant", "Interval", "Start", "Saccade_amplitude", "Extra") == [
        (1, "FPEn", "P1", 2, 4900.0, None, "x"),
        (2, "PEn", None, 2, None, 1.25, "y"),
    ]
    assert dict(loaded.dtypes)["Interval"] == "int"


def test_in_memory_table(spark):
    frame = pd.DataFrame(
        {
            "Recording": ["R1", "R1"], "Participant": ["P1", "P1"], "TOI": ["PEn", "FPEn"], "Interval": [1, 1],
            "Event_type": ["Fixation", "Saccade"], "Validity": ["Whole", "Whole"], "Start": [0.0, 5.0],
            "Stop": [5.0, 6.0], "Duration": [5.0, float("nan")], "Saccade_amplitude": [float("nan"), 2.0],
            "Extra": ["x", "y"],
        }
    )
    loaded = gaze_from_pandas(spark, frame)
    found = rows(loaded, "RowId", "TOI", "Duration", "Saccade_amplitude", "Extra")
    assert found == [(0, "PEn", 5.0, None, "x"), (1, "FPEn", None, 2.0, "y")]
    assert "Extra" in align.align_to_key_event(loaded).columns


def test_wrong_columns_are_refused(table):
    with pytest.raises(ValueError, match="lacks"):
        as_gaze(table.drop("RowId"))
    with pytest.raises(ValueError, match="derived"):
        as_gaze(table.withColumnRenamed("Duration", "KeyEventStart").withColumn("Duration", table["Stop"]))


# Per folder: rows, groups, key events, their summed starts, aligned rows and their sides (before, key, after,
# none), final rows, implausible values (short and long fixations, small and large saccades), fixations removed.
DERIVED_COUNTS = {
    "sf0.001": [1000, 44, 25, 119319, 390, (182, 19, 186, 3), 326, (4, 2, 24, 0), 3],
    "sf0.01": [10000, 460, 239, 1099710, 3766, (1533, 186, 2002, 45), 3108, (57, 33, 186, 1), 20],
    "sf0.1": [100000, 4578, 2470, 11286826, 38437, (15913, 1892, 20207, 425), 31800, (647, 311, 1975, 21), 224],
}


@pytest.mark.parametrize("folder", DERIVED_COUNTS)
def test_stage_by_stage_counts(spark, folder):
    analysis = analysis_of(spark, f"/root/testdata/{folder}")
    keys = align.key_event_per_interval(analysis.gaze)
    sides = {row.side: row["count"] for row in analysis.aligned.groupBy(sequence.side().alias("side")).count().collect()}
    removed = analysis.marked.filter("NOT _kept AND Event_type = 'Fixation'")
    assert DERIVED_COUNTS[folder] == [
        analysis.gaze.count(),
        analysis.gaze.select("Recording", "Participant", "TOI", "Interval").distinct().count(),
        keys.count(),
        int(keys.groupBy().sum("KeyEventStart").first()[0]),
        analysis.aligned.count(),
        tuple(sides.get(name, 0) for name in ("before", "key", "after", None)),
        analysis.final.count(),
        tuple(quality.implausible_counts(analysis.final).first()),
        removed.count(),
    ]


def test_derived_gaze_with_hot_users(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plain = gaze_from_events(events)
    spread = gaze_from_events(events, AnalysisConfig(hot_rows=60))
    assert rows(plain, *plain.columns) == rows(spread, *plain.columns)


@pytest.mark.parametrize("buckets", [None, 2])
def test_series_output(spark, tmp_path, buckets):
    data = [(f"P{i}", kind, n, float(n)) for i in range(5) for kind in ("Fixation", "Saccade") for n in (-1, 1)]
    series = spark.createDataFrame(data, "Participant string, Event_type string, Sequence int, ScaledMetric double")
    path = str(tmp_path / "series")
    write_profile_series(series, path, "Participant", buckets)
    back = spark.read.parquet(path)
    assert rows(back, *series.columns) == rows(series, *series.columns)
    folders = [name for name in os.listdir(path) if "=" in name]
    assert len(folders) == 5 if buckets is None else len(folders) <= buckets
    for folder in folders:
        assert len([f for f in os.listdir(os.path.join(path, folder)) if f.endswith(".parquet")]) == 1


@pytest.fixture
def small_splits(spark):
    """Files are read in many splits."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def frames_without_ids():
    """Tables of several files, one of them empty, with rows that repeat."""
    sizes = (700, 0, 1, 450)
    return [
        pd.DataFrame(
            {
                "Recording": [f"R{n}"] * size, "Participant": ["P1"] * size, "TOI": ["FPEn", "PEn"] * (size // 2) + ["EA"] * (size % 2),
                "Interval": pd.array([i % 3 for i in range(size)], "int32"), "Event_type": ["Fixation"] * size,
                "Validity": ["Whole"] * size, "Start": [float(i // 2) for i in range(size)],
                "Stop": [float(i // 2 + 9) for i in range(size)], "Duration": [9.0] * size, "Saccade_amplitude": [0.5] * size,
            }
        )
        for n, size in enumerate(sizes)
    ]


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_rows_are_numbered_in_input_order(spark, tmp_path, small_splits, fmt):
    frames = frames_without_ids()
    for n, frame in enumerate(frames):
        file = tmp_path / f"part-{n}.{fmt}"
        if fmt == "parquet":
            frame.to_parquet(file, row_group_size=40)
        elif fmt == "csv":
            frame.to_csv(file, index=False)
        else:
            frame.to_json(file, orient="records", lines=True)
    whole = pd.concat(frames, ignore_index=True)
    schema = None if fmt == "parquet" else GAZE_SCHEMA.__class__([f for f in GAZE_SCHEMA if f.name != "RowId"])
    loaded = load_gaze(spark, str(tmp_path), fmt, schema=schema, **({"header": "true"} if fmt == "csv" else {}))
    names = ["Recording", "TOI", "Interval", "Start", "Stop"]
    got = sorted(tuple(r) for r in loaded.select("RowId", *names).collect())
    assert got == [(i, *row) for i, row in enumerate(whole[names].itertuples(index=False, name=None))]
    assert loaded.rdd.getNumPartitions() > 1
    assert require_row_ids(loaded) is loaded
    plan = loaded._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_first_follows_the_input_order(spark, tmp_path):
    """Of two events that cover the anchor the one that is stored first is the key event."""
    frame = pd.concat([f.assign(Interval=pd.array([1] * len(f), "int32")) for f in frames_without_ids()[2:3]])
    first = frame.assign(TOI="PEn", Start=4990.0, Stop=5001.0)
    second = frame.assign(TOI="PEn", Start=4800.0, Stop=5300.0)
    first.to_parquet(tmp_path / "a.parquet")
    second.to_parquet(tmp_path / "b.parquet")
    keys = align.key_event_per_interval(load_gaze(spark, str(tmp_path)))
    assert rows(keys, "KeyEventStart", "KeyEventStop") == [(4990.0, 5001.0)]


def test_missing_and_repeated_ids_are_refused(spark, tmp_path, table):
    good = [r.asDict() for r in table.collect()]
    schema = GAZE_SCHEMA.__class__([f.__class__(f.name, f.dataType, True) for f in GAZE_SCHEMA])
    bad = [g | {"RowId": i} for i in (7, 7, None, None, 3, 9, 9, 9) for g in good[:1]]
    spark.createDataFrame(bad, schema).write.parquet(str(tmp_path / "bad"))
    assert rows(row_id_report(spark.read.parquet(str(tmp_path / "bad"))), "Rows", "N_Null", "N_Repeated", "FirstRepeated") == [(8, 2, 2, 7)]
    assert load_gaze(spark, str(tmp_path / "bad")).count() == 8
    with pytest.raises(ValueError, match="2 rows without it, 2 repeated ids .the smallest: 7"):
        load_gaze(spark, str(tmp_path / "bad"), check_ids=True)
    table.write.parquet(str(tmp_path / "good"))
    assert load_gaze(spark, str(tmp_path / "good"), check_ids=True).count() == 2
    empty = row_id_report(table.limit(0))
    assert rows(empty, "Rows", "N_Null", "N_Repeated", "FirstRepeated") == [(0, 0, 0, None)]


def test_numbering_many_files_joins_by_file(spark, tmp_path, monkeypatch):
    from keyspan.sources import gaze as source

    for n in range(6):
        pd.DataFrame({"v": range(n * 10, n * 10 + n)}).to_parquet(tmp_path / f"{n}.parquet")
    monkeypatch.setattr(source, "BROADCAST_FILES", 3)
    numbered = with_input_order(spark.read.parquet(str(tmp_path)))
    assert sorted(rows(numbered, "RowId", "v")) == list(enumerate(n * 10 + i for n in range(6) for i in range(n)))


SERIES = "Participant string, Event_type string, Sequence int, ScaledMetric double"


@pytest.mark.parametrize("buckets", [None, 2])
def test_a_rerun_replaces_a_series(spark, tmp_path, buckets):
    path = str(tmp_path / "series")
    # Names that look like numbers or hold separators keep their type and text.
    for number, names in enumerate((["001", "P1", "a/b=c"], ["P1", "P2"], [], ["P3"])):
        series = spark.createDataFrame([(name, "Fixation", 1, float(number)) for name in names], SERIES)
        replace_profile_series(series, path, "Participant", buckets)
        back = read_profile_series(spark, path)
        assert back.dtypes == series.dtypes
        assert rows(back, *series.columns) == rows(series, *series.columns)
    assert len(os.listdir(os.path.join(path, "runs"))) == 2


def test_a_killed_run_leaves_the_old_series(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "series")
    with pytest.raises(FileNotFoundError):
        read_profile_series(spark, path)
    old = spark.createDataFrame([("P1", "Fixation", 1, 1.0)], SERIES)
    new = spark.createDataFrame([("P2", "Fixation", 1, 2.0)], SERIES)
    replace_profile_series(old, path, "Participant")
    reader = read_profile_series(spark, path)
    failing = new.withColumn("ScaledMetric", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):  # while its files are written
        replace_profile_series(failing, path, "Participant")
    with monkeypatch.context() as patch:  # between its files and its mark
        patch.setattr("keyspan.sources.sinks._marks", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            replace_profile_series(new, path, "Participant")
    assert rows(read_profile_series(spark, path), "Participant") == [("P1",)]
    replace_profile_series(new, path, "Participant")
    assert rows(read_profile_series(spark, path), "Participant") == [("P2",)]
    assert rows(reader, "Participant") == [("P1",)]
    assert len(os.listdir(os.path.join(path, "runs"))) == 2
