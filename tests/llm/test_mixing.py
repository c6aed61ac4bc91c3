import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keyspan.llm import mixing


def targets(sizes):
    """Reshares step by step, as the rule says."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit >= 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * unit for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check(docs):
    rows = mixing.mix_sources(docs).collect()
    source = {(r.doc_id): r.source for r in docs.select("doc_id", "source").collect()}
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.select("doc_id", "text").collect()}
    sums, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        sums[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
    want = targets(sums)
    for r in rows:
        assert r.source_size == sums[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
    for s in sums:
        assert abs(taken[s] - want[s]) <= 3
    return rows


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(check(docs)) == sorted(check(docs.repartition(7)))


def test_hard_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "x y \n\x0b z", None), (4, "q " * 50, "b"), (4, "q " * 50, "b")]
    rows += [(10 + i, "w " * (i % 7), "é" if i % 3 else "Z") for i in range(60)] + [(5, "long " * 40_000, "a")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    assert len(check(docs)) == len(rows)
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs.where("text is null")).collect()[0].taken == 0


def test_documents_of_the_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = mixing.mixed_documents(docs)
    assert mixed.schema == docs.schema
    words = mixing.word_count(F.col("text"))
    got = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(words).alias("n")).collect()}
    want = {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect() if r.taken}
    assert {k: v for k, v in got.items() if v} == want
    assert all(r.n_chars == len(r.text) for r in mixed.collect())


def test_columns_with_names_of_its_own_pass_through(spark):
    names = ["cut", "epochs", "_part", "_words", "_src", "_key", "_whole", "src", "part"]
    rows = [(i, "ab"[i % 2], " ".join(["w"] * (i % 7)), *names) for i in range(60)] + [(None, None, None, *names)]
    schema = "doc_id bigint, source string, text string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    out = mixing.mixed_documents(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    rows = out.collect()
    assert all(row[n] == n for row in rows for n in names)
    taken = sum(len((r["text"] or "").split()) for r in rows)
    assert taken == sum(r["taken"] for r in mixing.mix_sources(docs).collect())
