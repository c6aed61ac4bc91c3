import math
import random

import numpy as np

from keyspan.llm import nn_descent as n


def brute(rows, every=20, most=20):
    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        ok[i] = min(ok.get(i, v), v)
    ids = sorted(ok)
    if not ids:
        return {}
    x = np.array([ok[i] for i in ids], np.float64)
    out = {}
    for k, i in enumerate(ids):
        if i % every == 0:
            scores = x @ x[k]
            order = sorted((j for j in range(len(ids)) if j != k), key=lambda j: (-scores[j], ids[j]))
            out[i] = [(ids[j], scores[j]) for j in order[:most]]
    return out


def check(df, least):
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    want, got = brute(rows), {}
    for r in n.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {q for q, found in want.items() if found}
    hits = total = 0
    vectors = {i: np.array(v, np.float64) for i, v in reversed(rows) if i in want or v is not None and None not in v}
    for q, found in want.items():
        mine = got.get(q, [])
        assert [r.rank for r in mine] == list(range(1, len(found) + 1))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert len({r.vec_id for r in mine}) == len(mine) and q not in {r.vec_id for r in mine}
        for r in mine:
            assert abs(r.score - vectors[r.vec_id] @ vectors[q]) < 1e-9
        last = found[-1][1] if found else 0
        hits += sum(r.score >= last - 1e-12 for r in mine)
        total += len(found)
    assert hits >= least * total
    return hits / max(1, total)


def test_recall_on_the_whole_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), 0.9)


def test_copies_ties_and_unusable_vectors(spark):
    rng = random.Random(4)
    vector = lambda: [rng.gauss(0, 1) for _ in range(6)]
    same = vector()
    rows = [(i, vector()) for i in range(150)] + [(200 + i, same) for i in range(120)]
    rows += [(400, None), (420, [0.0] * 6), (440, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (460, [float("nan")] * 6), (480, [float("inf")] * 6)]
    rows += [(None, vector()), *rows[:5], (500, [x * 50 for x in same])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, node int")
    check(df.repartition(3), 0.95)


def test_few_vectors(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(0, 100, 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(df, 1.0)
    assert n.nearest(df.limit(0)).count() == 0
    assert n.nearest(df.limit(1)).count() == 0
