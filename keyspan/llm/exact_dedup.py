"""Exact duplicates by skew-safe combining: of equal texts the row with the largest doc_id stays.

1. Digests of all rows are counted, combined before the shuffle. A digest with more than 1 / `hot_groups` of all rows is
   hot, so there are fewer than `hot_groups` of them; each gets salts in proportion to its rows.
2. Rows are deduplicated inside their partition, then merged by (digest, salt). The text itself is part of the grouping
   key of both, so full contents are compared, and a text moves only once for each partition that holds it.
3. The salt winners of hot digests are combined globally, again by full text. All other digests have one salt, so their
   texts move once in all.
4. Every row takes the result of its digest by a join of narrow rows, salted for hot digests. If two different texts
   share a digest, the rows of that digest are joined by their text instead.

Defined cases: a NULL text counts as empty, so NULL and empty texts are equal. A NULL doc_id is smaller than all others; a
group without any id has a NULL keep_id. Of rows that also share the largest doc_id exactly one stays. Texts are compared
whole, byte by byte. No rows: no rows. Further columns are ignored by `duplicate_groups` and returned by `deduplicated`,
where rows that tie are told apart by a hash of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import settled


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass(frozen=True)
class Dedup:
    """A digest is hot above 1 / `hot_groups` of all rows; any function of the text can be the digest."""

    hot_groups: int = 1000
    digest: Callable[[Column], Column] = sha256


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _hot(digests: DataFrame, params: Dedup) -> DataFrame:
    """digest, salts: the hot digests of a settled table; fewer than `hot_groups` rows."""
    total = digests.count()
    sizes = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"))
    share = F.col("rows") * params.hot_groups
    salts = F.ceil(share / F.lit(max(total, 1))).cast("int")
    return settled(sizes.where(share > total).select("digest", salts.alias("salts")))


def _winners(rows: DataFrame, hot: DataFrame, first: dict[str, Column], again: dict[str, Column]) -> DataFrame:
    """digest, text and the aggregates: one row for each text, by local, salted and global comparison of full texts.

    `first` aggregates rows, `again` aggregates its results.
    """
    salt = F.coalesce(F.pmod(F.spark_partition_id(), F.col("salts")), F.lit(0))
    salted = rows.join(F.broadcast(hot), "digest", "left").withColumn("salt", salt)
    found = salted.groupBy("digest", "salt", "text").agg(
        *[value.alias(name) for name, value in first.items()],
        # An aggregate, not a key: conditions on it stay above the shuffle, which so serves both uses below.
        F.max(F.col("salts").isNotNull()).alias("hot"),
    )
    names = ["digest", "text", *first]
    single = found.where(~F.col("hot")).select(*names)
    spread = found.where("hot").groupBy("digest", "text").agg(*[value.alias(name) for name, value in again.items()])
    return single.unionByName(spread.select(*names))


def _verdicts(members: DataFrame, classes: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """The result of every member (doc_id, row, keys) from its class (keys, keep_id, group_size), hot digests salted."""
    top = members.groupBy(*keys).agg(F.max(F.struct("doc_id", "row"))["row"].alias("top"))
    salts = F.broadcast(hot)
    each = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    spread = classes.join(top, keys).join(salts, "digest", "left").withColumn("salt", each).drop("salts")
    own = F.coalesce(F.pmod("row", "salts"), F.lit(0)).cast("int")
    salted = members.join(salts, "digest", "left").withColumn("salt", own).drop("salts")
    found = salted.join(spread, [*keys, "salt"])
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("top")).alias("kept"), "digest")


def duplicate_groups(docs: DataFrame, params: Dedup = Dedup()) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, digest."""
    rows = docs.select("doc_id", _text().alias("text")).withColumn("digest", params.digest(F.col("text")))
    members = settled(rows.select("doc_id", "digest", F.monotonically_increasing_id().alias("row")))
    hot = _hot(members.select("digest"), params)
    texts = _winners(
        rows,
        hot,
        {"keep_id": F.max("doc_id"), "group_size": F.count(F.lit(1))},
        {"keep_id": F.max("keep_id"), "group_size": F.sum("group_size")},
    )
    classes = settled(
        texts.groupBy("digest").agg(
            F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts")
        )
    )
    single = classes.where(F.col("texts") == 1).drop("texts")
    shared = classes.where(F.col("texts") > 1).select("digest")
    if shared.isEmpty():
        return _verdicts(members, single, hot, ["digest"])
    # Different texts with one digest: their rows are told apart by the texts themselves.
    same = _verdicts(members.join(shared, "digest", "left_anti"), single, hot, ["digest"])
    mixed = rows.join(shared, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id())
    told_apart = texts.join(shared, "digest", "left_semi")
    return same.unionByName(_verdicts(settled(mixed), told_apart, hot, ["digest", "text"]))


def deduplicated(docs: DataFrame, params: Dedup = Dedup()) -> DataFrame:
    """The rows that stay, with all their columns."""
    others = [F.col(f"`{name}`") for name in docs.columns if name != "text"]
    row = F.struct(*others, F.col("text").isNull().alias("_no_text"))
    rank = F.struct("doc_id", F.xxhash64(*others, F.col("text").isNull()))
    rows = docs.select(_text().alias("text"), row.alias("row"), rank.alias("rank"))
    rows = rows.withColumn("digest", params.digest(F.col("text")))
    hot = _hot(settled(rows.select("digest")), params)
    kept = _winners(
        rows,
        hot,
        {"row": F.max_by("row", "rank"), "rank": F.max("rank")},
        {"row": F.max_by("row", "rank"), "rank": F.max("rank")},
    )
    text = F.when(~F.col("row._no_text"), F.col("text")).alias("text")
    return kept.select(*[text if name == "text" else F.col(f"row.`{name}`") for name in docs.columns])


def duplicates_digest(docs: DataFrame, params: Dedup = Dedup()) -> DataFrame:
    """doc_id, keep_id, group_size, kept and the SHA-256 of the text for every row."""
    found = duplicate_groups(docs, params)
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
