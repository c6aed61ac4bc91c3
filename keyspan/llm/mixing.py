"""Mixing sources to target weights.

Documents get hash-random keys. Within each source they are range-sorted by key, their sizes in words are summed up
along that order over all partitions, and the source is cut where its target is reached: whole epochs first, then the
documents up to the cut. The document at the cut gives the words that are still missing, so each source meets its
target to less than a word. The keys depend on the rows alone, so reruns take the same words.

Sources weigh 3, 1, 2, repeating, in code-point order with NULL last, and share `share` of all words; no source's
target exceeds `max_epochs` times its size, and what it can't take is shared among the others by weight again.

Defined cases: a NULL text has size 0. Rows equal in id and text share one key; the words that a cut gives them are
split evenly, rounded down. A source without words has target 0. No rows: no rows. Input columns with the name of an
output column are replaced by `mix_sources`; `mixed_documents` keeps columns of any name, but makes `n_chars` anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyspan.llm.common import BLANK_CLASS, WORD_PATTERN, neutral, settled, small_broadcast, word_count


@dataclass(frozen=True)
class Mix:
    """Weights by rank of the source, the share of all words to take, and how often one document may be taken."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    max_epochs: int = 2


# Sources are told apart and ordered by this column: NULL comes last.
def _source_key() -> Column:
    return F.struct(F.col("source").isNull().alias("missing"), F.col("source").alias("name"))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, source, random key (two hashes of id and text: equal for equal rows only) and size."""
    return docs.select(
        "doc_id",
        _source_key().alias("src"),
        F.struct(
            F.xxhash64(F.lit("mix"), "doc_id", _text()).alias("a"), F.xxhash64(_text(), "doc_id").alias("b")
        ).alias("key"),
        word_count(F.col("text")).alias("size"),
    )


def with_rank(df: DataFrame, order: str) -> DataFrame:
    """`df`, settled, with `rank` from 0 by the unique column `order`; no task sees more than its own range."""
    ranged = settled(
        df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    )
    # One row for each partition.
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = parts.select(
        "_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return ranged.join(before, "_part").withColumn("rank", inside + F.col("_before")).drop("_part", "_before")


def source_targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """src, source_size, target: one settled row for each source of `sizes` (src, size)."""
    sources = with_rank(sizes.groupBy("src").agg(F.sum("size").alias("source_size")), "src")
    weights = F.array(*map(F.lit, mix.weights))
    sources = settled(
        sources.withColumn(
            "weight", F.element_at(weights, (F.col("rank") % len(mix.weights) + 1).cast("int")).cast("double")
        ).withColumn("limit", (F.col("source_size") * mix.max_epochs).cast("double"))
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    # Words per unit of weight: it only grows as sources reach their limits, until no further one does.
    level, full = 0.0, -1
    while True:
        at_limit = F.col("limit") <= F.col("weight") * level if level else F.lit(False)
        row = sources.agg(
            F.sum(F.when(at_limit, F.col("limit"))).alias("taken"),
            F.sum(F.when(~at_limit, F.col("weight"))).alias("weight"),
            F.count(F.when(at_limit, 1)).alias("full"),
        ).first()
        if row["full"] == full or not row["weight"]:
            break
        full = row["full"]
        level = (mix.share * total - (row["taken"] or 0.0)) / row["weight"]
    target = F.least(F.col("limit"), F.col("weight") * level)
    return settled(sources.select("src", "source_size", target.alias("target")))


def _fractions(sized: DataFrame, targets: DataFrame, mix: Mix) -> DataFrame:
    """For each key: `times`, how often its rows are taken (a fraction at the cut only)."""
    groups = sized.groupBy("src", "key").agg(F.sum("size").alias("group_size"))
    ranged = settled(
        groups.repartitionByRange("src", "key")
        .sortWithinPartitions("src", "key")
        .withColumn("_part", F.spark_partition_id())
    )
    # At most partitions + sources rows: a source spans neighbouring partitions.
    parts = ranged.groupBy("src", "_part").agg(F.sum("group_size").alias("_sum"))
    before = settled(
        parts.withColumn("_before", F.sum("_sum").over(Window.partitionBy("src").orderBy("_part")) - F.col("_sum")).drop(
            "_sum"
        )
    )
    inside = F.sum("group_size").over(Window.partitionBy("_part", "src").orderBy("key")) - F.col("group_size")
    # The window runs over the rows as they lie: a partition's rows of one source, in key order.
    placed = ranged.withColumn("_inside", inside).join(small_broadcast(before), ["src", "_part"])
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    start = F.col("_inside") + F.col("_before")
    part = F.when(
        F.col("group_size") > 0,
        F.greatest(F.lit(0), F.least(F.col("group_size"), rest - start)) / F.col("group_size"),
    ).otherwise(0.0)
    return placed.join(small_broadcast(targets), "src").select(
        "src", "key", "source_size", "target", epochs.cast("long").alias("epochs"), part.alias("part")
    )


def _taken() -> Column:
    # The cut's fraction of a document is a whole number of words; rounding first undoes the division's error.
    return F.col("epochs") * F.col("size") + F.floor(F.round(F.col("part") * F.col("size"), 6)).cast("long")


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of `docs`."""
    sized = settled(_keyed(docs))
    targets = source_targets(sized, mix)
    fractions = _fractions(sized, targets, mix)
    return sized.join(fractions, ["src", "key"]).select(
        "doc_id", "size", "source_size", "target", _taken().alias("taken")
    )


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, the one at a source's cut as far as it is taken.

    The cut of each source is one key, so the rows need no shuffle: a row is taken once more than the whole epochs if
    its key lies before the cut. `n_chars`, if there, becomes the length of the text.
    """
    sized = settled(_keyed(docs))
    targets = source_targets(sized, mix)
    fractions = _fractions(sized, targets, mix)
    cuts = settled(
        fractions.groupBy("src").agg(
            F.max("epochs").alias("epochs"),
            F.max(F.when(F.col("part") > 0, F.struct("key", "part"))).alias("cut"),
        )
    )
    plain = neutral(docs, ("doc_id", "source", "text", "n_chars"))
    keyed = plain.select(
        *plain.columns,
        _source_key().alias("_src"),
        F.struct(
            F.xxhash64(F.lit("mix"), "doc_id", _text()).alias("a"), F.xxhash64(_text(), "doc_id").alias("b")
        ).alias("_key"),
    )
    joined = keyed.join(small_broadcast(cuts.select(F.col("src").alias("_src"), "epochs", "cut")), "_src")
    part = (
        F.when(F.col("cut").isNull() | (F.col("_key") > F.col("cut.key")), 0.0)
        .when(F.col("_key") == F.col("cut.key"), F.col("cut.part"))
        .otherwise(1.0)
    )
    words = F.floor(F.round(part * word_count(F.col("text")), 6)).cast("int")
    joined = joined.withColumn("_part", part).withColumn("_words", F.when(F.col("_part").between(1e-12, 1 - 1e-12), words))
    copies = F.concat(
        F.array_repeat(F.lit(True), F.col("epochs").cast("int")),
        F.when((F.col("_part") >= 1) | (F.col("_words") > 0), F.array(F.col("_part") >= 1)).otherwise(
            F.array().cast("array<boolean>")
        ),
    )
    begin = F.call_function(
        "regexp_extract",
        F.col("text"),
        F.concat(F.lit(f"^(?:{BLANK_CLASS}*+{WORD_PATTERN}+){{"), F.coalesce("_words", F.lit(1)), F.lit("}+")),
        F.lit(0),
    )
    out = joined.select(
        *plain.columns, "_words", F.explode(copies).alias("_whole")
    ).withColumn("text", F.when(F.col("_whole"), F.col("text")).otherwise(begin))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*plain.columns).toDF(*docs.columns)
