import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keyspan.llm import exact_dedup
from keyspan.llm.exact_dedup import Dedup


def expected(rows):
    """(doc_id, keep_id, group_size, sha) of every row, and how many rows of each text stay: one."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return out, groups


def order(row):
    return tuple((value is not None, value if value is not None else 0) for value in row)


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want, groups = expected(rows)
    got = exact_dedup.duplicates_digest(docs).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=order) == sorted(want, key=order)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)
    return rows


HARD = (
    [(1, None), (2, ""), (3, None), (None, "alone"), (None, "both"), (7, "both"), (None, None)]
    + [(8, "same row"), (8, "same row"), (8, "same row"), (9, "same row "), (10, "Same row")]
    + [(100 + i, "hot text") for i in range(300)]
    + [(500 + i, f"rare {i % 40}") for i in range(90)]
    + [(700, "long " * 60_000), (701, "long " * 60_000), (702, "long " * 60_000 + ".")]
)


@pytest.mark.parametrize("parts", [1, 7])
def test_hard_rows(spark, parts):
    docs = spark.createDataFrame(HARD, "doc_id long, text string").repartition(parts)
    clashing = docs.select("*", *[F.lit("x").alias(n) for n in ("digest", "salt", "salts", "row", "hot", "keep_id", "kept")])
    check(clashing)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert exact_dedup.duplicates_digest(docs).collect() == []
    assert exact_dedup.deduplicated(docs).collect() == []


@pytest.mark.parametrize("digest", [lambda t: F.length(t), lambda t: F.lit(1)])
def test_full_texts_decide_where_digests_collide(spark, digest):
    rows = [r for r in HARD if len(r[1] or "") < 100]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup.duplicate_groups(docs, Dedup(digest=digest)).collect()
    want, groups = expected(rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=order) == sorted([w[:3] for w in want], key=order)
    assert sum(r.kept for r in got) == len(groups)


def test_hot_digests_are_spread_over_salts(spark):
    docs = spark.createDataFrame(HARD, "doc_id long, text string").repartition(16)
    rows = docs.select("doc_id", "text").withColumn("digest", exact_dedup.sha256(F.coalesce("text", F.lit(""))))
    hot = exact_dedup._hot(rows.select("digest"), Dedup(hot_groups=10)).collect()
    assert len(hot) < 10
    assert max(r.salts for r in hot) >= 7  # 300 of 405 rows


def test_rows_that_stay_keep_all_columns(spark):
    rows = [(i, t, f"s{n}", n) for n, (i, t) in enumerate(HARD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, digest int").repartition(6)
    kept = exact_dedup.deduplicated(docs)
    assert kept.schema == docs.schema
    got = {tuple(r) for r in kept.collect()}
    _, groups = expected(HARD)
    assert len(got) == len(groups) and got <= set(rows)
    for doc_id, text, *_ in got:
        assert doc_id == max((i for i in groups[text or ""] if i is not None), default=None)


def test_whole_table(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))
