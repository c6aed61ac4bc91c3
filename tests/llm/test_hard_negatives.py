import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyspan.llm import hard_negatives
from keyspan.llm.hard_negatives import Mining


def usable(row):
    vec_id, label, vector = row
    return None not in (vec_id, label, vector) and all(x is not None and math.isfinite(x) for x in vector)


def expected(rows, anchor, positives=5, negatives=10, low=30, high=90):
    """Every score in Python's integers."""
    kept = {}
    for vec_id, label, vector in sorted((r for r in rows if usable(r)), reverse=True):
        kept[vec_id] = (label, [math.floor(256 * x) for x in vector])
    out = []
    for a, (label, vector) in kept.items():
        if not anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(vector, v)), i, lab) for i, (lab, v) in kept.items() if i != a]
        scored.sort()
        for score, p, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [(n, s) for s, n, lab in scored if lab != label and low * -score <= 100 * -s <= high * -score]
            out += [(a, p, rank, n, -score, -s) for rank, (n, s) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, params=Mining(), parts=3):
    table = spark.createDataFrame(rows, "vec_id long, label int, vector array<double>").repartition(parts)
    clashing = table.select("*", *[F.lit("x").alias(n) for n in ("row", "rank", "score", "anchor_id", "other_id")])
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(clashing, F.col("vec_id") % 10 == 0, params).collect())


def random_rows(seed, n, dims, labels, step):
    rng = random.Random(seed)
    return [(i, rng.randrange(labels), [rng.randint(-9, 9) * step for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("seed, n, dims, labels, step", [(1, 120, 7, 2, 0.05), (2, 90, 20, 4, 0.01), (3, 60, 1, 2, 1.0)])
def test_random_rows_with_ties(spark, seed, n, dims, labels, step):
    rows = random_rows(seed, n, dims, labels, step)
    small = Mining(columns_at_once=2, task_rows=20, block_bytes=1000, chunk_bytes=8 * dims * 4)
    assert mined(spark, rows, small) == expected(rows, lambda i: i % 10 == 0)


def test_hard_rows(spark):
    rows = random_rows(4, 80, 6, 3, 0.1)
    rows += [(None, 1, [0.1] * 6), (200, None, [0.1] * 6), (210, 1, None), (220, 1, [0.1, None]), (230, 1, [math.nan]), (240, 1, [math.inf])]
    rows += [(300, 1, []), (310, 2, [0.0] * 6), (320, 0, [0.5] * 3), (330, 0, [0.2] * 9), (40, 0, [0.3] * 6), (40, 0, [0.3] * 6)]
    rows += [(1000 + i, i % 2, [0.25] * 6) for i in range(150)]
    got = mined(spark, rows)
    assert got == expected(rows, lambda i: i % 10 == 0) and got
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0])]) == []
    assert mined(spark, [(0, 1, [1.0]), (2, 1, [1.0])]) == []


def test_values_too_large_for_doubles_are_exact(spark):
    rows = [(i, i % 2, [float(2**17 + i), float(i * 2**16), 0.5 + i]) for i in range(24)]
    rows += [(30, 0, [2.0**22] * 3), (31, 0, [2.0**22] * 3), (32, 1, [2.0**20, 2.0**21, -1.0])]
    assert mined(spark, rows) == expected(rows, lambda i: i % 10 == 0)
    with pytest.raises(Exception, match="does not fit 64 bits"):
        mined(spark, [(0, 0, [2.0**40]), (1, 0, [2.0**40]), (2, 1, [2.0**39])])


def test_candidates_leave_before_all_columns_are_read():
    rng = np.random.default_rng(5)
    rows = np.floor(256 * rng.normal(size=(500, 32)) * 2.0 ** -np.arange(32))
    block = hard_negatives.Block(np.arange(500), np.zeros(500, np.int64), rows, 32)
    seen = []

    def alive(least, most):
        exact = rows @ rows[0]
        seen.append(len(least))
        assert (most >= np.sort(least)[-5]).sum() >= 5 and exact.max() <= most.max()
        return most >= np.sort(least)[-5]

    place, scores = hard_negatives.scan(rows[0], block, np.arange(500), alive, 4)
    assert seen == sorted(seen, reverse=True) and seen[3] < 50
    assert set(np.argsort(-(rows @ rows[0]))[:5]) <= set(place)
    assert (scores == (rows @ rows[0])[place]).all()


def test_matrix_of_lists():
    lists = pa.array([[0.5], [], [0.01, -0.01, 2.0]], pa.list_(pa.float32()))
    assert hard_negatives.matrix(lists.slice(1, 2), 256).tolist() == [[0, 0, 0], [2, -3, 512]]


def test_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = []
    for r in table.collect():
        label = r.label if r.label is None or r.vec_id % 7 else (r.label + 1) % 10
        rows.append((r.vec_id, label, r.embedding))
    got = sorted(tuple(r) for r in hard_negatives.mined_embeddings(table).collect())
    assert got == expected(rows, lambda i: i % 100 == 0)
