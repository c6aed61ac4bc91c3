"""The skew-safe full outer join against a row-by-row computation."""

import random
from collections import Counter

import pytest
from helpers import rows
from pyspark.sql import functions as F

from keyspan.functions.outer import full_outer

LEFT, RIGHT = "a string, b int, x long", "a string, b int, y long"


def by_hand(left, right):
    found = Counter((lr[0], lr[1], lr[2], rr[2]) for lr in left for rr in right if lr[:2] == rr[:2])
    of_left, of_right = {lr[:2] for lr in left}, {rr[:2] for rr in right}
    found.update((lr[0], lr[1], lr[2], None) for lr in left if lr[:2] not in of_right)
    found.update((rr[0], rr[1], None, rr[2]) for rr in right if rr[:2] not in of_left)
    return found


def joined(spark, left, right, hot_rows):
    out = full_outer(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["a", "b"], hot_rows)
    assert out.columns == ["a", "b", "x", "y"]
    return Counter(tuple(row) for row in out.collect())


def table(rnd, n, names):
    # Two rows of five have no key at all; some have half a key; values and whole rows repeat.
    return [
        (None, None, rnd.randrange(n)) if rnd.random() < 0.4 else (rnd.choice(names), rnd.choice([1, 2, None]), rnd.randrange(n // 2))
        for _ in range(n)
    ]


@pytest.mark.parametrize("hot_rows", [1, 3, 20, 10**6])
def test_any_tables(spark, hot_rows):
    rnd = random.Random(hot_rows)
    left, right = table(rnd, 120, ["k", "l", "left", None]), table(rnd, 40, ["k", "l", "right", None])
    assert joined(spark, left, right, hot_rows) == by_hand(left, right)
    assert joined(spark, right, left, hot_rows) == by_hand(right, left)


def test_hot_keys_of_one_side_only(spark):
    left, right = [(None, 1, 7)] * 30 + [("k", 1, 1)], [("r", None, i) for i in range(30)] + [("k", 1, 2)]
    for hot_rows in (2, 100):
        assert joined(spark, left, right, hot_rows) == by_hand(left, right)


def test_empty_sides(spark):
    some = [(None, None, 1), ("k", 1, 2), ("k", 1, 2)]
    for left, right in (([], []), (some, []), ([], some)):
        assert joined(spark, left, right, 1) == by_hand(left, right)


def test_clashing_columns_are_refused(spark):
    df = spark.createDataFrame([("k", 1, 2)], LEFT)
    with pytest.raises(ValueError, match="x"):
        full_outer(df, df, ["a", "b"], 10)


def test_tasks_are_even(spark):
    """Two fifths of the rows without key, most others with one key: no shuffle partition holds more than its share."""
    n, hot_rows = 40_000, 500
    key = F.when(F.col("id") % 5 < 2, F.lit(None)).when(F.col("id") % 5 < 4, F.lit("k")).otherwise(F.col("id").cast("string"))
    left = spark.range(n).select(key.alias("k"), F.col("id").alias("x"))
    right = spark.createDataFrame([(None, 1), ("k", 2), ("none", 3)], "k string, y int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = full_outer(left, right, ["k"], hot_rows, left_id=["x"])
        sizes = [row["count"] for row in out.groupBy(F.spark_partition_id()).count().collect()]
        assert rows(out.filter("x IS NULL"), "k", "y") == [("none", 3)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == n + 1
    assert max(sizes) < 2 * n / int(spark.conf.get("spark.sql.shuffle.partitions"))
