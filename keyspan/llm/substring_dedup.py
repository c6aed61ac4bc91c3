"""Removal of long repeated passages by compaction of a de Bruijn graph of token k-mers.

A window of `window` words is removed from a document if the same words stand in a document of smaller doc_id.

1. Each window chooses its k-mer of minimum hash, so equal windows choose equal k-mers at equal places. The chosen
   k-mers of a text are its path through the graph: each is an edge, with the words between it and its neighbours.
2. Spark groups the edges: the smallest and largest document of each, and whether all its occurrences come from the
   same neighbour and go to the same one (a text's beginning and end are neighbours too). Edges of one document are
   dropped, the others are joined back to their places in the texts.
3. Runs of edges without branches are compacted: as long as there is one way back (forth), every text that has an edge
   has all the words back to the run's beginning (forth to its end). A window inside the run of its own edge is in all
   documents that have this edge, so it is a repeat if the edge's smallest document is another one.
4. A window that reaches over a branch is verified at its coordinates: its own hash is compared with those of all such
   windows. Copies of whole texts or passages have no branches inside, so few windows take this way.

Hashes of windows have 128 bits, from two independent hashes of words. Defined cases: a NULL text has no words. Rows with one doc_id never remove words from
each other. A NULL doc_id neither removes nor loses words. Repeated rows give equal results. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import settled
from keyspan.llm.word_hashes import parts_of, range_hashes, windows, word_hashes


@dataclass(frozen=True)
class Repeats:
    """Length of the windows and of the k-mers, in words."""

    window: int = 50
    k: int = 16


BEGIN, END = np.uint64(0xB5297A4D3F84D5B5), np.uint64(0x68E31DA4A7C15F39)


@dataclass(frozen=True)
class Path:
    """Several texts' words end to end: where texts begin and end, their windows and the edges that these choose."""

    hashes: np.ndarray
    ends: np.ndarray  # of texts
    starts: np.ndarray  # of all windows, ascending
    text_of: np.ndarray  # text of each window
    edge_of: np.ndarray  # number of the edge that each window chooses
    places: np.ndarray  # of edges
    edge_text: np.ndarray  # text of each edge

    @staticmethod
    def of(texts: list[bytes], repeats: Repeats) -> Path:
        hashes, counts = word_hashes(texts)
        ends = np.cumsum(counts)
        span = repeats.window - repeats.k + 1
        kmers = windows(hashes, repeats.k)
        n = max(0, len(hashes) - repeats.window + 1)
        owner = np.repeat(np.arange(len(texts)), counts)[:n]
        starts = np.flatnonzero(np.arange(n) + repeats.window <= ends[owner]) if n else np.empty(0, np.int64)
        if not len(starts):
            none = np.empty(0, np.int64)
            return Path(hashes, ends, none, none, none, none, none)
        chosen = np.lib.stride_tricks.sliding_window_view(kmers, span).argmin(axis=1)[starts] + starts
        text_of = owner[starts]
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (chosen[1:] != chosen[:-1]) | (text_of[1:] != text_of[:-1])
        return Path(hashes, ends, starts, text_of, np.cumsum(fresh) - 1, chosen[fresh], text_of[fresh])

    @property
    def begins(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]])

    def neighbours(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each edge, the hash of the words back to the edge before it, or the text's beginning, and forth alike."""
        if not len(self.places):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        same = self.edge_text[1:] == self.edge_text[:-1]
        first, last = np.append(True, ~same), np.append(~same, True)
        back = np.where(first, self.begins[self.edge_text], np.append(0, self.places[:-1]))
        forth = np.where(last, self.ends[self.edge_text], np.append(self.places[1:], 0) + k)
        before = range_hashes(self.hashes, back, self.places)
        after = range_hashes(self.hashes, self.places + k, np.maximum(forth, self.places + k))
        return before ^ np.where(first, BEGIN, np.uint64(0)), after ^ np.where(last, END, np.uint64(0))

    def reach(self, marked: np.ndarray, one_back: np.ndarray, one_forth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each edge, from where to where all texts that have it have the same words."""
        n = len(self.places)
        number = np.arange(n)
        same = np.append(False, self.edge_text[1:] == self.edge_text[:-1])
        # The nearest edge before, itself included, from which there is no one way back; the same forth.
        stop = ~(marked & one_back)
        left = np.maximum.accumulate(np.where(stop | ~same, number, 0))
        low = np.where(stop[left], self.places[left], self.begins[self.edge_text[left]])
        stop = ~(marked & one_forth)
        last = np.append(~same[1:], True)
        right = np.minimum.accumulate(np.where(stop | last, number, n)[::-1])[::-1]
        high = np.where(stop[right], self.places[right] + k, self.ends[self.edge_text[right]])
        return low, high


def _paths(batches: Iterable[pa.RecordBatch], repeats: Repeats) -> Iterator[tuple[pa.RecordBatch, list[bytes], Path]]:
    for batch in batches:
        for first, part in parts_of(batch.column("text").to_pylist(), 1_000_000):
            yield batch.slice(first, len(part)), part, Path.of(part, repeats)


def _edges(docs: DataFrame, repeats: Repeats) -> DataFrame:
    """One row for each edge of each text: edge, before, after, doc_id, key (of the row), place in the text."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, path in _paths(batches, repeats):
            if not len(path.places):
                continue
            before, after = path.neighbours(repeats.k)
            kmers = windows(path.hashes, repeats.k)[path.places]
            columns = [pa.array(c.view(np.int64)) for c in (kmers, before, after)]
            columns += [batch.column(c).take(pa.array(path.edge_text)) for c in ("doc_id", "key")]
            columns.append(pa.array((path.places - path.begins[path.edge_text]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, ["edge", "before", "after", "doc_id", "key", "place"])

    schema = "edge bigint, before bigint, after bigint, doc_id bigint, key bigint, place int"
    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(rows, schema)


def _marks(docs: DataFrame, repeats: Repeats) -> DataFrame:
    """For each row that has an edge of two documents or more: these edges' places, first documents and ways. Settled."""
    edges = _edges(docs, repeats)
    shared = (
        edges.groupBy("edge")
        .agg(
            F.min("doc_id").alias("first"),
            F.max("doc_id").alias("last"),
            (F.min("before") == F.max("before")).alias("one_back"),
            (F.min("after") == F.max("after")).alias("one_forth"),
        )
        .where(F.col("first") < F.col("last"))
        .drop("last")
    )
    mark = F.struct("place", "first", "one_back", "one_forth")
    # An edge that very many texts share meets one row of the other side; its rows may be split over tasks.
    joined = edges.select("edge", "doc_id", "key", "place").join(shared, "edge")
    return settled(joined.groupBy("doc_id", "key").agg(F.collect_set(mark).alias("marks")))


def _decided(batch: pa.RecordBatch, path: Path, repeats: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """For each window: whether it is known to be a repeat, and whether it needs to be verified."""
    number = len(path.places)
    marked, back, forth = (np.zeros(number, bool) for _ in range(3))
    first = np.zeros(number, np.int64)
    doc = np.zeros(number, np.int64)
    bounds = np.searchsorted(path.edge_text, np.arange(batch.num_rows + 1))
    for text, (doc_id, marks) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("marks").to_pylist(), strict=True)):
        if not marks:
            continue
        own = path.places[bounds[text] : bounds[text + 1]] - path.begins[text]
        at = bounds[text] + np.searchsorted(own, [m["place"] for m in marks])
        marked[at] = True
        doc[at] = doc_id
        first[at] = [m["first"] for m in marks]
        back[at] = [m["one_back"] for m in marks]
        forth[at] = [m["one_forth"] for m in marks]
    if not marked.any():
        return np.zeros(len(path.starts), bool), np.zeros(len(path.starts), bool)
    low, high = path.reach(marked, back, forth, repeats.k)
    edge = path.edge_of
    inside = marked[edge] & (path.starts >= low[edge]) & (path.starts + repeats.window <= high[edge])
    return inside & (first[edge] < doc[edge]), marked[edge] & ~inside


def _verified(marked: DataFrame, repeats: Repeats) -> DataFrame:
    """For each row with windows over branches that repeat a smaller document's: where these windows begin."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part, path in _paths((b.filter(b.column("marks").is_valid()) for b in batches), repeats):
            if not len(path.starts):
                continue
            open_ = np.flatnonzero(_decided(batch, path, repeats)[1])
            if not len(open_):
                continue
            starts, text = path.starts[open_], path.text_of[open_]
            columns = [
                pa.array(windows(path.hashes, repeats.window)[starts].view(np.int64)),
                pa.array(windows(word_hashes(part, second=True)[0], repeats.window)[starts].view(np.int64)),
                *(batch.column(c).take(pa.array(text)) for c in ("doc_id", "key")),
                pa.array((starts - path.begins[text]).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "doc_id", "key", "start"])

    found = marked.mapInArrow(rows, "h1 bigint, h2 bigint, doc_id bigint, key bigint, start int")
    least = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    repeated = found.join(least, ["h1", "h2"]).where(F.col("doc_id") > F.col("first"))
    return repeated.groupBy("doc_id", "key").agg(F.collect_set("start").alias("starts"))


def without_repeats(docs: DataFrame, repeats: Repeats = Repeats()) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the other words, joined by spaces) for each row of `docs`."""
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    texts = docs.select("doc_id", "text", key.alias("key"))
    marks = _marks(texts, repeats)
    # Both uses of this join stand in one plan and are the same, so the texts are shuffled once.
    marked = texts.join(marks, ["doc_id", "key"], "left")
    verified = _verified(marked, repeats)
    joined = marked.join(verified, ["doc_id", "key"], "left").select("doc_id", "text", "marks", "starts")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, path in _paths(batches, repeats):
            repeat, _ = _decided(batch, path, repeats)
            starts = path.starts[repeat]
            more = [s for b, own in zip(path.begins, batch.column("starts").to_pylist(), strict=True) for s in (b + np.array(own or [], np.int64))]
            depth = np.zeros(len(path.hashes) + 1, np.int64)
            for begin in (starts, np.array(more, np.int64)):
                np.add.at(depth, begin, 1)
                np.add.at(depth, begin + repeats.window, -1)
            gone = np.cumsum(depth[:-1]) > 0
            n, removed, kept = [], [], []
            for raw, begin, end in zip(texts, path.begins.tolist(), path.ends.tolist(), strict=True):
                words, own = raw.split(), gone[begin:end]
                n.append(end - begin)
                removed.append(int(own.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~own)] if removed[-1] else words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.mapInArrow(rows, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def repeats_digest(docs: DataFrame, repeats: Repeats = Repeats()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of `docs`."""
    return without_repeats(docs, repeats).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
