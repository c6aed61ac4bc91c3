"""Hard negatives by a BOND vertical scan: columns of dimensions, bounds from what remains, a shrinking candidate set.

Rows are read in blocks. A block is turned into columns, one for each dimension, with each column's minimum and maximum.
An anchor reads the columns in the descending order of its own magnitudes. After each few columns a candidate's score is
known up to the least and the largest that the remaining columns can add, and candidates that can no longer matter leave
the set; the last ones are scored in full, so results are exact.

1. The first `positives` rows of the anchor's label: a candidate leaves when it cannot reach the last place so far.
2. Their scores fix one window of scores for each positive. Of the rows of other labels a candidate leaves when it can be
   in no window, or cannot reach the last place of any window that it can be in.

Places found are kept from block to block in a task, so later blocks are cut sooner; tasks return their best few rows,
which Spark merges. Anchors are taken in chunks of at most `chunk_bytes`, each compared with all rows: rows are never
shuffled for the scan, and what a task holds doesn't grow with the table.

Components x count as floor(`scale` * x).

Defined cases: rows with a NULL id, a NULL label, a NULL vector or any NULL or non-finite component take no part. Of rows
with one id that of the smallest label and vector counts. Shorter vectors read as filled up with zeros, empty ones as
zeros. Scores are exact integers; a returned score beyond 64 bits raises OverflowError. Anchors without positives, and
positives without rows in their window, give no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyspan.llm.common import settled
from keyspan.llm.mixing import with_rank

SCORED = "anchor_id bigint, positive_id bigint, positive_score bigint, other_id bigint, score bigint"
# Sums of products of integers are exact in a double below this.
EXACT = 2.0**53


@dataclass(frozen=True)
class Mining:
    """Positives of an anchor, negatives of a positive, and the window of scores in hundredths of the positive's."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    columns_at_once: int = 8
    task_rows: int = 4_096
    block_bytes: int = 8_000_000
    chunk_bytes: int = 4_000_000


def matrix(lists: pa.Array, scale: int) -> np.ndarray:
    """Rows of a list column as whole numbers in float64, short ones filled up with zeros."""
    offsets = lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    out = np.zeros((len(sizes), max(1, sizes.max(initial=0))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = np.floor(values * scale)
    return out


class Block:
    """Some rows as columns: `columns[d]` holds dimension d of all of them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, dims: int):
        rows = np.pad(rows, ((0, 0), (0, max(0, dims - rows.shape[1]))))
        self.ids, self.labels = ids, labels
        self.columns = np.ascontiguousarray(rows.T)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)


def scan(
    anchor: np.ndarray,
    block: Block,
    start: np.ndarray,
    alive: Callable[[np.ndarray, np.ndarray], np.ndarray],
    step: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of `start` (places in the block) that outlive every cut, and their exact scores.

    `alive` tells from the bounds of the scores which candidates stay.
    """
    dims = len(block.columns)
    anchor = np.pad(anchor, (0, max(0, dims - len(anchor))))
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.sort(np.stack([anchor * block.low, anchor * block.high]), axis=0)[:, order]
    if not np.maximum(-ends[0], ends[1]).sum() < EXACT:
        return start, _large_scores(anchor, block, start)
    # What the columns from each place of the order on can still add.
    rest = np.zeros((2, dims + 1))
    rest[:, :dims] = np.cumsum(ends[:, ::-1], axis=1)[:, ::-1]
    place, partial = start, np.zeros(len(start))
    whole = len(start) == len(block.ids)
    for begin in range(0, dims, step):
        read = order[begin : begin + step]
        columns = block.columns[read] if whole else block.columns[np.ix_(read, place)]
        partial = partial + anchor[read] @ columns
        least, most = rest[:, min(begin + step, dims)]
        stay = alive(partial + least, partial + most)
        if not stay.all():
            place, partial, whole = place[stay], partial[stay], False
            if not len(place):
                break
    return place, partial.astype(np.int64)


def _large_scores(anchor: np.ndarray, block: Block, start: np.ndarray) -> np.ndarray:
    """Scores in Python's integers, for values whose products do not fit a double."""
    factors = [int(x) for x in anchor]
    rows = block.columns[:, start].T
    return np.array([sum(f * int(x) for f, x in zip(factors, row, strict=True)) for row in rows] + [0], object)[:-1]


class Best:
    """The first `size` rows found so far: higher scores first, ties by smaller id."""

    def __init__(self, size: int):
        self.size = size
        self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def bar(self) -> float:
        """A score below this no longer gets a place."""
        return float(self.scores[-1]) if len(self.scores) == self.size else -np.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        if scores.dtype == object:  # beyond 64 bits
            first = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.size], np.int64)
        else:
            first = np.lexsort((ids, -scores))[: self.size]
        self.ids, self.scores = ids[first], scores[first]


def _blocks(batches: Iterable[pa.RecordBatch], dims: int, params: Mining) -> Iterator[Block]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("vector")
        width = 8 * max(dims, int(np.diff(lists.offsets.to_numpy()).max(initial=1)))
        at_once = max(1, params.block_bytes // width)
        ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        for begin in range(0, batch.num_rows, at_once):
            part = slice(begin, begin + at_once)
            yield Block(ids[part], labels[part], matrix(lists.slice(begin, at_once), params.scale), dims)


def _fits(score: int) -> int:
    if not -(2**63) <= score < 2**63:
        raise OverflowError(f"score {score} does not fit 64 bits")
    return int(score)


def _batch(rows: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
    names = [field.split()[0] for field in SCORED.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


@dataclass(frozen=True)
class Chunk:
    """Some anchors: ids, labels, one row of components each."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray


def _find_positives(chunk: Chunk, params: Mining) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(params.positives) for _ in chunk.ids]
        for block in _blocks(batches, chunk.rows.shape[1], params):
            for own, label, row, found in zip(chunk.ids, chunk.labels, chunk.rows, best, strict=True):
                start = np.flatnonzero((block.labels == label) & (block.ids != own))

                def alive(least: np.ndarray, most: np.ndarray, found: Best = found) -> np.ndarray:
                    bar = found.bar
                    if len(least) >= found.size:
                        # So many rows score at least this.
                        bar = max(bar, np.partition(least, -found.size)[-found.size])
                    return most >= bar

                place, scores = scan(row, block, start, alive, params.columns_at_once)
                found.add(block.ids[place], scores)
        rows = [
            (own, 0, 0, other, _fits(score))
            for own, found in zip(chunk.ids.tolist(), best, strict=True)
            for other, score in zip(found.ids.tolist(), found.scores.tolist(), strict=True)
        ]
        yield _batch(rows)

    return run


def _find_negatives(
    chunk: Chunk, positives: dict[int, list[tuple[int, int]]], params: Mining
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def window(score: int) -> tuple[int, int]:
        return -(-params.low * score // 100), params.high * score // 100

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A positive below zero has an empty window.
        windows = [[window(score) for _, score in positives.get(own, [])] for own in chunk.ids.tolist()]
        best = [[Best(params.negatives) for _ in ws] for ws in windows]
        for block in _blocks(batches, chunk.rows.shape[1], params):
            for own, label, row, ws, found in zip(chunk.ids, chunk.labels, chunk.rows, windows, best, strict=True):
                open_ = [(low, high, b) for (low, high), b in zip(ws, found, strict=True) if low <= high]
                if not open_:
                    continue
                start = np.flatnonzero((block.labels != label) & (block.ids != own))

                def alive(least: np.ndarray, most: np.ndarray, open_: list = open_) -> np.ndarray:
                    stay = np.zeros(len(least), bool)
                    for low, high, b in open_:
                        stay |= (most >= max(low, b.bar)) & (least <= high)
                    return stay

                place, scores = scan(row, block, start, alive, params.columns_at_once)
                for low, high, b in open_:
                    inside = (scores >= low) & (scores <= high)
                    b.add(block.ids[place[inside]], scores[inside])
        rows = [
            (own, positive, score, other, _fits(value))
            for own, found in zip(chunk.ids.tolist(), best, strict=True)
            for (positive, score), b in zip(positives.get(own, []), found, strict=True)
            for other, value in zip(b.ids.tolist(), b.scores.tolist(), strict=True)
        ]
        yield _batch(rows)

    return run


def _first(found: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The best `size` rows of each key, numbered by `rank`; tasks have sent no more than that each."""
    window = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "other_id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= size)


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector: one row for each id, without those that take no part."""
    broken = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~broken
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "vector").where(known)
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return one.select("vec_id", "row.label", "row.vector")


def hard_negatives(vectors: DataFrame, anchors: Column, params: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` has vec_id, label and vector, an array of numbers; `anchors` is a condition on them.
    """
    spark = vectors.sparkSession
    # Even parts; a task returns its best rows of every anchor, so it should not hold too few to choose from.
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // params.task_rows))
    rows = settled(_usable(vectors).repartition(max(1, parts)))
    asked = with_rank(rows.where(anchors), "vec_id")
    count, dims = asked.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    at_once = max(1, params.chunk_bytes // (8 * max(dims or 1, 1)))
    merged = None
    for number in range(-(-count // at_once)):
        few = asked.where(F.col("rank").between(number * at_once, (number + 1) * at_once - 1))
        table = few.select("vec_id", "label", "vector").toArrow().combine_chunks()
        lists = table["vector"].combine_chunks()
        chunk = Chunk(table["vec_id"].to_numpy(), table["label"].to_numpy(), matrix(lists, params.scale))
        found = rows.mapInArrow(_find_positives(chunk, params), SCORED)
        # At most `positives` rows for each anchor of the chunk.
        near: dict[int, list[tuple[int, int]]] = {}
        for r in _first(found, ["anchor_id"], params.positives).select("anchor_id", "other_id", "score").collect():
            near.setdefault(r.anchor_id, []).append((r.other_id, r.score))
        part = rows.mapInArrow(_find_negatives(chunk, near, params), SCORED)
        merged = part if merged is None else merged.unionByName(part)
    if merged is None:
        merged = spark.createDataFrame([], SCORED)
    return _first(merged, ["anchor_id", "positive_id"], params.negatives).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("other_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def mined_embeddings(embeddings: DataFrame, params: Mining = Mining()) -> DataFrame:
    """Hard negatives of every hundredth row of `embeddings`, every seventh label changed."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, params)
