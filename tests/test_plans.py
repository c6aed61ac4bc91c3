"""The physical plans keep their shape: few shuffles, pushed filters, no Python, bounded joins."""

import re

import pytest
from helpers import event, gaze, same
from pyspark.sql import functions as F

from keyspan.config import AnalysisConfig
from keyspan.operators import align
from keyspan.plans.analysis import Analysis
from keyspan.plans.queries import OPERATORS, analysis_of
from keyspan.sources.gaze import as_gaze, load_gaze

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A stored gaze table, as a user would have it."""
    path = str(tmp_path_factory.mktemp("gaze") / "gaze.parquet")
    analysis_of(spark, DIR).gaze.write.parquet(path)
    return path


def executed(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def count(plan, pattern):
    return len(re.findall(pattern, plan))


def test_one_shuffle_to_the_final_rows(spark, stored):
    plan = executed(Analysis(load_gaze(spark, stored)).final)
    assert count(plan, r"[^d]Exchange hashpartitioning") == 1
    assert count(plan, r" Sort \[") == 2
    assert "Join" not in plan


def test_a_bucketed_table_is_not_shuffled(spark, stored, tmp_path):
    gaze_rows = load_gaze(spark, stored)
    keys = ("Recording", "Participant", "Interval")
    writer = gaze_rows.write.bucketBy(4, *keys).sortBy(*keys).option("path", str(tmp_path / "bucketed"))
    writer.saveAsTable("bucketed_gaze")
    clustered = Analysis(as_gaze(spark.table("bucketed_gaze")), AnalysisConfig(clustered=True))
    plan = executed(clustered.final)
    assert "Exchange" not in plan
    same(clustered.final, Analysis(gaze_rows).final)
    spark.sql("DROP TABLE bucketed_gaze")


def test_unused_columns_are_not_read(spark, stored):
    events = Analysis(load_gaze(spark, stored).withColumn("Extra", F.lit(1))).aligned.groupBy("TOI").count()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", executed(events)).group(1)
    assert "Stop" in schema
    assert "Duration" not in schema and "Saccade_amplitude" not in schema
    only_labels = executed(align.relevant_labels(load_gaze(spark, stored)).select("TOI"))
    assert re.search(r"ReadSchema: struct<TOI:string>", only_labels)
    assert "PushedFilters: [In(TOI" in only_labels


def test_anchor_condition_reaches_the_scan(spark, stored):
    plan = executed(align.key_event_per_label(load_gaze(spark, stored, has_nan=False)))
    assert "LessThanOrEqual(Start,5000.0)" in plan and "GreaterThan(Stop,5000.0)" in plan


def test_interval_filter_reaches_the_scan(spark, stored):
    aligned = Analysis(load_gaze(spark, stored)).aligned
    plan = executed(aligned.filter("Recording = 'R1'"))
    assert "EqualTo(Recording,R1)" in plan


@pytest.mark.parametrize("name", [name for name in OPERATORS if not name.startswith("write_")])
def test_every_query_reads_and_shuffles_the_rows_once(spark, stored, name):
    plan = executed(OPERATORS[name](Analysis(load_gaze(spark, stored))))
    new = [line for line in plan.split("\n") if "ReusedExchange" not in line]
    assert sum("REPARTITION_BY_COL" in line for line in new) <= 1
    # The key events alone are found by a second, filtered read.
    assert sum("FileScan" in line for line in new) <= 1
    assert "Python" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan


def test_uneven_statistics_share_the_shuffle(spark, stored):
    plan = executed(Analysis(load_gaze(spark, stored), AnalysisConfig(broadcast_groups=2)).marked)
    new = [line for line in plan.split("\n") if "ReusedExchange" not in line]
    assert sum("REPARTITION_BY_COL" in line for line in new) == 1


def test_statistics_of_too_many_recordings_are_not_broadcast_whole(spark):
    events = [event("PEn", "Fixation", 4900, 5100, Recording=f"R{i}") for i in range(6)]
    table = gaze(spark, events)
    wide = Analysis(table, AnalysisConfig(min_rows=1, broadcast_groups=3))
    assert wide.n_recordings == 4
    assert wide.outlier_filtered.count() == 6
    assert "limit=3" in wide.outlier_filtered._jdf.queryExecution().toString().replace("GlobalLimit 3", "limit=3")
