"""Skew-safe ranking and joins, exact quantiles."""

import math
import random

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from keyspan.functions import skew
from keyspan.functions.quantiles import exact_quantiles


def test_row_numbers_with_hot_keys_and_ties(spark):
    rnd = random.Random(5)
    data = [(rnd.choice(["a", "a", "b", None]), rnd.choice([1.0, 1.0, 1.0, 2.0, None]), i) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, v double, id long").repartition(7)
    order = [F.col("v").asc_nulls_last(), F.col("id").desc()]
    plain = skew.row_numbers(df, ["k"], order, "n", hot_rows=10**6)
    spread = skew.row_numbers(df, ["k"], order, "n", hot_rows=300)
    some = skew.row_numbers(df, ["k"], order, "n", hot_rows=1000)
    assert plain.dtypes == spread.dtypes
    assert rows(plain, "k", "v", "id", "n") == rows(spread, "k", "v", "id", "n") == rows(some, "k", "v", "id", "n")


def test_hot_keys_are_the_largest(spark):
    data = [("a",)] * 5 + [("b",)] * 9 + [(None,)] * 7 + [("c",)] * 2
    df = spark.createDataFrame(data, "k string")
    assert skew.hot_keys(df, ["k"], 9) is None
    assert rows(skew.hot_keys(df, ["k"], 4), "k") == [("a",), ("b",), (None,)]
    assert rows(skew.hot_keys(df, ["k"], 6), "k") == [("b",), (None,)]


def test_any_number_of_keys_may_be_hot(spark, monkeypatch):
    # Far more hot keys than are taken at once: the largest take the split path, the others the ordinary one.
    df = spark.range(40_000).select((F.col("id") % 12_000).alias("k"), "id")
    for most in (100, 10_000, 20_000):
        monkeypatch.setattr(skew, "HOT_KEYS", most)
        assert skew.hot_keys(df, ["k"], 2).count() == min(most, 12_000)
        out = skew.row_numbers(df, ["k"], [F.col("id").asc()], "n", hot_rows=2)
        assert out.count() == 40_000
        assert out.filter(F.col("n") != F.floor(F.col("id") / 12_000) + 1).isEmpty()


def test_a_small_table_is_counted_and_no_more(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert skew.hot_keys(df, ["k"], 1000) is None
    new = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
    assert len(new) <= 2


def test_ranges_of_quantiles_become_narrow(spark):
    """Of real values, in a narrow range beside huge ones, few are left to be sorted."""
    df = spark.range(200_000).select(F.when(F.col("id") % 50 == 0, F.rand(2) * 1e200).otherwise(F.rand(1) * 3).alias("v"))
    for rounds, most in ((1, 2_000), (2, 60)):
        found = exact_quantiles(df, [], F.col("v"), {"m": 0.5}, rounds, few_groups=True)
        plan = executed(found)
        assert 0 < rows_sorted(found) <= most, plan
    values = sorted(row.v for row in df.collect())
    assert found.first()["m"] == (values[99_999] + values[100_000]) / 2


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def rows_sorted(df):
    """Rows that the window of picked positions reads."""
    plan = df._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() in ("AdaptiveSparkPlan", "ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage"):
            todo.append(node.plan() if "Stage" in node.nodeName() else node.finalPhysicalPlan())
        if node.nodeName().startswith("Exchange") and "_count" in node.output().toString():
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
    return max(found, default=0)


@pytest.mark.parametrize("rounds", [0, 1, 2, 3])
def test_quantiles_at_every_position(spark, rounds):
    """All ranks of small groups, heavy ties and infinities, whatever the number of rounds."""
    rnd = random.Random(rounds)
    data = [("few", float(i)) for i in range(7)] + [("tied", rnd.choice([1.0, 1.0, 1.0, 2.0])) for _ in range(500)]
    data += [("wide", rnd.choice([-1, 1]) * 10.0 ** rnd.randint(-200, 200)) for _ in range(700)]
    data += [(None, rnd.gauss(0, 1)) for _ in range(3_000)] + [("ends", v) for v in (-float("inf"), 0.0, float("inf"))]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    wanted = {"q0": 0.0, "q1": 0.07, "q8": 0.5, "q15": 0.93, "q16": 1.0}
    found = {row.k: row for row in exact_quantiles(df, ["k"], F.col("v"), wanted, rounds, few_groups=rounds % 2 == 0).collect()}
    for key in ("few", "tied", "wide", None):
        values = sorted(v for k, v in data if k == key)
        for name, probability in wanted.items():
            place = (len(values) - 1) * probability
            low, high = values[math.floor(place)], values[math.ceil(place)]
            assert found[key][name] == (low if low == high else low + (place - math.floor(place)) * (high - low)), (key, name)
    assert (found["ends"]["q0"], found["ends"]["q8"], found["ends"]["q16"]) == (-float("inf"), 0.0, float("inf"))


def test_quantiles_start_no_job(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"), (F.col("id") % 3).alias("k"))
    spark.sparkContext.setJobGroup("quantiles", "built only")
    try:
        exact_quantiles(df, ["k"], F.col("v"), {"m": 0.5}, rounds=2)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("quantiles")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_hot_group_is_spread_over_partitions(spark, monkeypatch):
    # One key, one value: only the last order column tells rows apart.
    df = spark.range(20000).select(F.lit("x").alias("k"), F.lit(1.0).alias("v"), "id")
    seen = []
    real = skew.checkpointed

    def checkpointed(placed):
        result = real(placed)
        if "id" in result.columns:  # not the offsets
            seen.extend(row["count"] for row in result.groupBy("_part").count().collect())
        return result

    monkeypatch.setattr(skew, "checkpointed", checkpointed)
    numbered = skew.ranked_hot(df, ["k"], [F.col("v").asc(), F.col("id").asc()], "n")
    assert numbered.filter(F.col("n") != F.col("id") + 1).count() == 0
    assert len(seen) == 8 and max(seen) < 20000 / 2


def test_uneven_attach(spark):
    data = [("a", 1)] * 500 + [("b", 2)] * 5 + [("c", 3)] * 4 + [(None, 4)] * 3 + [("lone", 5)]
    df = spark.createDataFrame(data, "k string, v int")
    table = df.filter("v < 5").groupBy("k").agg(F.max("v").alias("m"), F.count(F.lit(1)).alias("size"))
    want = rows(skew.attach(df, table, ["k"], small=True), "k", "v", "m")
    assert rows(skew.attach_uneven(df, table, ["k"], "size", top=2), "k", "v", "m") == want
    assert len(want) == len(data)


def test_quantiles_of_groups(spark):
    rnd = random.Random(9)
    data = [
        (rnd.choice(["a", "b", None]), rnd.choice([None, rnd.uniform(-5, 400), float(rnd.randint(0, 3))]))
        for _ in range(2000)
    ]
    data += [("one", 7.25), ("two", 1.0), ("two", 2.0), ("none", None), ("inf", float("inf"))]
    df = spark.createDataFrame(data, "k string, v double")
    wanted = {"q10": 0.1, "q25": 0.25, "median": 0.5, "q99": 0.99}
    found = exact_quantiles(df, ["k"], F.col("v"), wanted).collect()
    by_key = {row.k: row for row in found}
    assert set(by_key) == {"a", "b", None, "one", "two", "none", "inf"}
    none = by_key.pop("none")
    assert (none["_n"], none["_nulls"], none["median"]) == (0, 1, None)
    for key, row in by_key.items():
        assert row["_nulls"] == sum(k == key and v is None for k, v in data)
        values = [v for k, v in data if k == key and v is not None]
        assert row["_n"] == len(values)
        if key == "inf":
            assert row["median"] == float("inf")
            continue
        assert np.isclose(row["_sum"], sum(values))
        for name, probability in wanted.items():
            assert np.isclose(row[name], np.quantile(values, probability), rtol=0, atol=1e-9), (key, name)


def test_quantiles_of_everything(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    row = exact_quantiles(df, [], F.col("v"), {"m": 0.5, "q": 0.333}).first()
    assert (row["m"], row["_n"], row["_sum"]) == (50.0, 101, 5050.0)
    assert np.isclose(row["q"], 33.3)


def test_checkpoint_folder_is_the_sessions_own(spark):
    assert skew.checkpoint_folder(spark) == spark.sparkContext.getCheckpointDir()
