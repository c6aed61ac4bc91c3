"""Approximate nearest neighbours by inner product: NN-descent builds a graph, queries walk it greedily.

1. Equal vectors collapse into one node, so copies of one vector cost nothing; results name the copies again.
2. First neighbours come from blocks of vectors that lie next to each other along random projections.
3. In each round every node sends its vector to the nodes that list it and to those that it lists: a join of neighbour
   lists with vectors. So each node sees its neighbours together and tells each of them which of the others are better
   than its worst neighbour so far (neighbours of neighbours). Lists are merged; rounds end when few entries change.
   Of the nodes that list a node, `reverse` take part, by a hash: NN-descent samples them.
4. A query starts at nodes of the graph and keeps the best nodes found. Every round expands the best ones that have not
   been expanded, by a join with the graph, until none of a query's `beam` best is left or `walks` rounds are done.
5. The best found are scored exactly, in double precision, on the original vectors.

Rounds move vectors as 8-bit numbers with a scale; only the last step decides on ranks. All lists are bounded by
parameters, no node's neighbours are gathered without a bound, and every round is settled in the checkpoint folder.

Defined cases: vectors that are NULL, zero, of another length than most, or hold NULL or non-finite components take no
part, nor do rows with a NULL id. Of rows with one id the smallest vector counts. Ties go to the smaller id. With few
vectors every query gets all candidates. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyspan.llm.common import settled


@dataclass(frozen=True)
class Descent:
    """Sizes of neighbour lists, of blocks and candidate lists; rounds at most; and when the graph is good enough."""

    neighbours: int = 32
    reverse: int = 16
    told: int = 5
    block: int = 512
    projections: int = 2
    rounds: int = 7
    settled_share: float = 0.05
    nodes_a_part: int = 1000
    beam: int = 320
    expanded: int = 96
    walks: int = 3
    exact: int = 64


NODE = "node bigint, scale float, vec binary, ids array<bigint>, scores array<float>"


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column without nulls, and where each row's begin and end."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(), offsets - offsets[0]


def _packed(vec: pa.Array, scale: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(vec.to_pylist()), np.int8)
    return raw.reshape(len(vec), -1).astype(np.float32) * scale.to_numpy()[:, None]


def _best(group: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Positions of the `most` best different ids of each group, groups ascending, best first."""
    order = np.lexsort((ids, -scores, group))
    # The same id may have been found twice, with one score up to rounding: its first place counts.
    by_id = np.lexsort((np.arange(len(order)), ids[order], group[order]))
    g, i = group[order][by_id], ids[order][by_id]
    fresh = np.ones(len(order), bool)
    fresh[by_id[1:]] = (g[1:] != g[:-1]) | (i[1:] != i[:-1])
    order = order[fresh]
    own = group[order]
    begin = np.flatnonzero(np.diff(own, prepend=own[0] - 1)) if len(own) else np.empty(0, np.int64)
    place = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
    return order[place < most]


def _groups(batches: Iterable[pa.RecordBatch], column: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by `column`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table[column].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut).combine_chunks()
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _rows_of(ids: np.ndarray, scores: np.ndarray, group: np.ndarray, n: int) -> list[pa.Array]:
    ends = np.searchsorted(group, np.arange(n + 1))
    offsets = pa.array(ends.astype(np.int32))
    return [
        pa.ListArray.from_arrays(offsets, pa.array(ids)),
        pa.ListArray.from_arrays(offsets, pa.array(scores.astype(np.float32))),
    ]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (double array) of the rows that take part, one for each id."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.forall("vec", finite) & F.exists("vec", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (length["n"] if length else 0))


def nodes_of(vectors: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(node, vec) for each different vector, the node being its smallest id; and (node, vec_id) of its `most` + 1 first ids.

    A query names `most` neighbours at most, so further copies of one vector can't be among them. Copies are reduced
    in two steps, by salt and then over salts, so no task sees all copies of one vector.
    """
    named = vectors.select("vec_id", "vec", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt"))
    first = Window.partitionBy("vec", "salt").orderBy("vec_id")
    few = named.withColumn("at", F.row_number().over(first)).where(F.col("at") <= most + 1).drop("at", "salt")
    members = few.groupBy("vec").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, most + 1).alias("ids"))
    members = settled(members.select(F.col("ids")[0].alias("node"), "vec", "ids"))
    return members.select("node", "vec"), members.select("node", F.explode("ids").alias("vec_id"))


def _quantised(nodes: DataFrame) -> DataFrame:
    """node, scale, vec: 8-bit numbers, of which 127 is the largest component."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = _lists(batch.column("vec"))
            if not len(values):
                continue
            x = values.reshape(len(ends) - 1, -1)
            scale = np.abs(x).max(axis=1) / 127
            small = np.round(x / scale[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(scale.astype(np.float32)), pa.array([v.tobytes() for v in small], pa.binary())],
                ["node", "scale", "vec"],
            )

    return settled(nodes.mapInArrow(rows, "node bigint, scale float, vec binary"))


def _project(number: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _packed(batch.column("vec"), batch.column("scale"))
                direction = np.random.default_rng(number).normal(size=x.shape[1]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x @ direction)], ["node", "scale", "vec", "along"])

    return run


def _first_lists(small: DataFrame, params: Descent) -> DataFrame:
    """node, ids, scores: neighbours in blocks along random projections."""
    found = []
    for number in range(params.projections):

        def block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            size = 0

            def flush() -> Iterator[pa.RecordBatch]:
                table = pa.Table.from_batches(held).combine_chunks()
                nodes, x = table["node"].to_numpy(), _packed(table["vec"], table["scale"])
                scores = x @ x.T
                np.fill_diagonal(scores, -np.inf)
                k = min(params.neighbours, len(nodes) - 1)
                if k:
                    top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                    offsets = pa.array(np.arange(0, len(nodes) * k + 1, k, dtype=np.int32))
                    lists = [nodes[top].ravel(), np.take_along_axis(scores, top, 1).ravel()]
                    columns = [pa.array(nodes), *(pa.ListArray.from_arrays(offsets, pa.array(c)) for c in lists)]
                    yield pa.RecordBatch.from_arrays(columns, ["node", "ids", "scores"])

            for batch in batches:
                for at in range(0, batch.num_rows, params.block):
                    part = batch.slice(at, params.block)
                    held.append(part)
                    size += part.num_rows
                    if size >= params.block:
                        yield from flush()
                        held, size = [], 0
            if held:
                yield from flush()

        along = small.mapInArrow(_project(number), "node bigint, scale float, vec binary, along float")
        ranged = along.repartitionByRange("along").sortWithinPartitions("along", "node").drop("along")
        found.append(ranged.mapInArrow(block, "node bigint, ids array<bigint>, scores array<float>"))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every


def _merged(small: DataFrame, told: DataFrame, params: Descent, parts: int) -> DataFrame:
    """The graph with `told` (node, ids, scores) put into the nodes' lists; `changed` counts new entries. Settled."""

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "node"):
            node = table["node"].to_numpy()
            own = table["vec"].is_valid().to_numpy()
            nodes, row = np.unique(node, return_inverse=True)
            (ids, ends), (scores, _) = _lists(table["ids"].chunk(0)), _lists(table["scores"].chunk(0))
            count = np.diff(ends)
            group, old = np.repeat(row, count), np.repeat(own, count)
            best = _best(group, ids, scores, params.neighbours)
            # What a node had before comes first among equal ids only by score; so what is new is told by membership.
            known = set(zip(group[old].tolist(), ids[old].tolist(), strict=True))
            changed = np.zeros(len(nodes), np.int64)
            for g, i in zip(group[best].tolist(), ids[best].tolist(), strict=True):
                changed[g] += (g, i) not in known
            base = table.filter(pa.array(own)).combine_chunks()
            columns = [base[c].chunk(0) if base.num_rows else pa.array([]) for c in ("node", "scale", "vec")]
            columns += [*_rows_of(ids[best], scores[best], group[best], len(nodes)), pa.array(changed)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "scale", "vec", "ids", "scores", "changed"])

    none = "CAST(NULL AS FLOAT) AS scale", "CAST(NULL AS BINARY) AS vec"
    rows = small.unionByName(told.selectExpr("node", *none, "ids", "scores"))
    merged = rows.repartition("node").sortWithinPartitions("node", F.col("vec").isNull()).mapInArrow(merge, NODE + ", changed bigint")
    # Every round reads the graph several times, so it is kept in no more parts than its nodes need.
    return settled(merged.coalesce(parts))


def _members(graph: DataFrame, params: Descent, salt: int) -> DataFrame:
    """center, node, scale, vec, worst: each node in the lists of those that it lists and that list it; rows by center."""
    listed = graph.select("node", F.explode("ids").alias("other"))
    worst = F.when(F.size("ids") >= params.neighbours, F.array_min("scores")).otherwise(float("-inf")).cast("float")
    vectors = graph.select("node", "scale", "vec", worst.alias("worst"))
    # v lists u: u goes to v. This is the join of neighbour lists with the neighbours' vectors.
    forth = listed.select(F.col("node").alias("center"), F.col("other").alias("node")).join(vectors, "node")
    # u lists v: u goes to v, too.
    back = graph.select("node", "scale", "vec", worst.alias("worst"), F.explode("ids").alias("center"))
    columns = ["center", "node", "scale", "vec", "worst"]
    both = forth.select(*columns, F.lit(0).alias("kind")).unionByName(back.select(*columns, F.lit(1).alias("kind")))
    return both.repartition("center").sortWithinPartitions("center", "kind", F.xxhash64("node", F.lit(salt)))


def _limited(table: pa.Table, params: Descent) -> tuple[pa.Table, np.ndarray]:
    """The table without reverse members beyond the limit and those that are listed anyway; number of each row's center."""
    center, kind, node = (table[c].to_numpy() for c in ("center", "kind", "node"))
    _, group = np.unique(center, return_inverse=True)
    order = np.lexsort((kind, node, group))
    fresh = np.ones(len(order), bool)
    fresh[order[1:]] = (group[order][1:] != group[order][:-1]) | (node[order][1:] != node[order][:-1])
    starts = np.searchsorted(group, np.arange(group[-1] + 2))
    seen = np.concatenate([[0], np.cumsum(fresh & (kind == 1))])
    rank = seen[1:] - seen[starts[group]]
    use = fresh & ((kind == 0) | (rank <= params.reverse))
    return table.filter(pa.array(use)).combine_chunks(), group[use]


def _tell(params: Descent):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _groups(batches, "center", 8_000):
            table, group = _limited(whole, params)
            x, node, worst = _packed(table["vec"], table["scale"]), table["node"].to_numpy(), table["worst"].to_numpy()
            starts = np.searchsorted(group, np.arange(group[-1] + 2))
            widest = int(np.diff(starts).max())
            place = np.full((len(starts) - 1, widest), -1)
            place[group, np.arange(len(group)) - starts[group]] = np.arange(len(group))
            for at in range(0, len(place), 64):
                part = place[at : at + 64]
                gone = part < 0
                y = np.where(gone[:, :, None], 0, x[part])
                scores = np.matmul(y, y.transpose(0, 2, 1))
                scores[np.broadcast_to(gone[:, None, :], scores.shape)] = -np.inf
                scores[:, np.arange(widest), np.arange(widest)] = -np.inf
                k = min(params.told, widest)
                top = np.argpartition(-scores, k - 1, axis=2)[:, :, :k]
                value = np.take_along_axis(scores, top, 2)
                who, which = part[~gone], top[~gone]
                value = value[~gone]
                owner = np.broadcast_to(np.arange(len(part))[:, None], part.shape)[~gone]
                good = value > np.maximum(worst[who], np.finfo(np.float32).min)[:, None]
                count = good.sum(axis=1)
                some = count > 0
                offsets = pa.array(np.concatenate([[0], np.cumsum(count[some])]).astype(np.int32))
                other = node[part[owner[:, None], which]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node[who[some]]),
                        pa.ListArray.from_arrays(offsets, pa.array(other[good])),
                        pa.ListArray.from_arrays(offsets, pa.array(value[good])),
                    ],
                    ["node", "ids", "scores"],
                )

    return run


def neighbour_graph(small: DataFrame, params: Descent = Descent()) -> DataFrame:
    """The graph over quantised nodes: node, scale, vec, ids and scores (best first). Settled."""
    parts = max(1, small.count() // params.nodes_a_part)
    empty = "CAST(array() AS array<bigint>) AS ids", "CAST(array() AS array<float>) AS scores"
    graph = _merged(small.selectExpr("node", "scale", "vec", *empty), _first_lists(small, params), params, parts)
    for number in range(params.rounds):
        told = _members(graph, params, number).mapInArrow(_tell(params), "node bigint, ids array<bigint>, scores array<float>")
        graph = _merged(graph.drop("changed"), told, params, parts)
        moved, entries = graph.agg(F.sum("changed"), F.sum(F.size("ids"))).first()
        if not entries or moved <= params.settled_share * entries:
            break
    return graph.drop("changed")


def _adjacency(graph: DataFrame, params: Descent) -> DataFrame:
    """center, ids, scales, vecs: the members of each node's neighbourhood with their vectors. Settled, by center."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _groups(batches, "center"):
            table, group = _limited(whole, params)
            starts = np.searchsorted(group, np.arange(group[-1] + 2))
            offsets = pa.array(starts.astype(np.int32))
            vec = table["vec"].to_pylist()
            centers = np.unique(whole["center"].to_numpy())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(centers),
                    pa.ListArray.from_arrays(offsets, table["node"].chunk(0)),
                    pa.ListArray.from_arrays(offsets, table["scale"].chunk(0)),
                    pa.array([b"".join(vec[a:b]) for a, b in zip(starts, starts[1:], strict=False)], pa.binary()),
                ],
                ["center", "ids", "scales", "vecs"],
            )

    schema = "center bigint, ids array<bigint>, scales array<float>, vecs binary"
    return settled(_members(graph, params, -1).mapInArrow(rows, schema))


def _expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores the neighbourhood of an expanded node against its query; keeps what beats the query's worst."""
    for batch in batches:
        if not batch.num_rows:
            continue
        query = _packed(batch.column("vec"), batch.column("scale"))
        worst = batch.column("worst").to_numpy()
        (ids, ends), (scales, _) = _lists(batch.column("ids")), _lists(batch.column("scales"))
        raw = np.frombuffer(b"".join(batch.column("vecs").to_pylist()), np.int8).reshape(len(ids), -1)
        row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        scores = np.einsum("rd,rd->r", query[row], raw.astype(np.float32)) * scales
        good = scores > worst[row]
        offsets = pa.array(np.concatenate([[0], np.cumsum(good)])[ends].astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("query"),
                pa.ListArray.from_arrays(offsets, pa.array(ids[good])),
                pa.ListArray.from_arrays(offsets, pa.array(scores[good].astype(np.float32))),
            ],
            ["query", "ids", "scores"],
        )


def search(queries: DataFrame, graph: DataFrame, params: Descent = Descent()) -> DataFrame:
    """query, ids: the nodes found for each of `queries` (query, scale, vec, and start nodes `ids` with `scores`)."""
    adjacency = _adjacency(graph, params)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "query"):
            own = table["vec"].is_valid().to_numpy()
            queries_, row = np.unique(table["query"].to_numpy(), return_inverse=True)
            (ids, ends), (scores, _) = _lists(table["ids"].chunk(0)), _lists(table["scores"].chunk(0))
            group = np.repeat(row, np.diff(ends))
            best = _best(group, ids, scores, params.beam)
            base = table.filter(pa.array(own)).combine_chunks()
            done, done_ends = _lists(base["done"].chunk(0))
            # What the last round expanded: the best that had not been.
            gone = set(zip(np.repeat(np.arange(len(queries_)), np.diff(done_ends)).tolist(), done.tolist(), strict=True))
            fresh: list[list[int]] = [[] for _ in queries_]
            for g, i in zip(group[best].tolist(), ids[best].tolist(), strict=True):
                if len(fresh[g]) < params.expanded and (g, i) not in gone:
                    fresh[g].append(i)
            doing = [old + new for old, new in zip(base["done"].to_pylist(), fresh, strict=True)]
            columns = [base[c].chunk(0) for c in ("query", "scale", "vec")]
            columns += _rows_of(ids[best], scores[best], group[best], len(queries_))
            columns += [pa.array(doing, pa.list_(pa.int64())), pa.array(fresh, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["query", "scale", "vec", "ids", "scores", "done", "fresh"])

    schema = "query bigint, scale float, vec binary, ids array<bigint>, scores array<float>, done array<bigint>, fresh array<bigint>"

    def next_state(rows: DataFrame) -> DataFrame:
        return settled(rows.repartition("query").sortWithinPartitions("query", F.col("vec").isNull()).mapInArrow(merge, schema))

    nothing = "CAST(array() AS array<bigint>) AS done"
    state = next_state(queries.selectExpr("query", "scale", "vec", "ids", "scores", nothing))
    for _ in range(params.walks):
        if state.where(F.size("fresh") > 0).isEmpty():
            break
        worst = F.when(F.size("ids") >= params.beam, F.array_min("scores")).otherwise(float("-inf")).cast("float")
        frontier = state.select("query", "scale", "vec", worst.alias("worst"), F.explode("fresh").alias("center"))
        seen = frontier.join(adjacency, "center").select("query", "scale", "vec", "worst", "ids", "scales", "vecs")
        found = seen.mapInArrow(_expand, "query bigint, ids array<bigint>, scores array<float>")
        none = "CAST(NULL AS FLOAT) AS scale", "CAST(NULL AS BINARY) AS vec"
        rows = state.drop("fresh").unionByName(found.selectExpr("query", *none, "ids", "scores", nothing))
        state = next_state(rows)
    return state.select("query", "ids")


def nearest(vectors: DataFrame, every: int = 20, most: int = 20, params: Descent = Descent()) -> DataFrame:
    """query_id, rank, vec_id, score: the `most` nearest found for each row whose id is divisible by `every`."""
    rows = usable(vectors)
    nodes, members = nodes_of(rows, most)
    small = _quantised(nodes)
    graph = neighbour_graph(small, params)
    asked = rows.where(F.col("vec_id") % every == 0)
    # A query that is in the graph starts at its own node and the neighbours that the graph gives it.
    queries = (
        asked.join(nodes.withColumnRenamed("node", "own"), "vec")
        .select(F.col("vec_id").alias("query"), "own")
        .join(graph.withColumnRenamed("node", "own"), "own")
        .select(
            "query",
            "scale",
            "vec",
            F.concat(F.array("own"), "ids").alias("ids"),
            F.concat(F.array(F.lit(float("inf")).cast("float")), "scores").alias("scores"),
        )
    )
    found = search(queries, graph, params).select("query", F.explode(F.slice("ids", 1, params.exact)).alias("node"))
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    scored = (
        found.join(nodes.withColumnRenamed("vec", "v"), "node")
        .join(asked.select(F.col("vec_id").alias("query"), F.col("vec").alias("q")), "query")
        .select("query", "node", product.alias("score"))
    )
    named = scored.join(members, "node").where(F.col("vec_id") != F.col("query"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (
        named.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= most)
        .select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
