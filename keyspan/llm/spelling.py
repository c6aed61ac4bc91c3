"""Grouping of spelling variants by k-d trees over letter counts.

Two words are near if one inserted, deleted or replaced letter makes them equal. Such a step changes the vector of a
word's letter counts by at most two in L1: a replacement takes one letter and adds another, an insertion adds one. So
near words are found by range searches among vectors, per pair of lengths (n, n) and (n, n + 1), and the order of their
letters is compared at last.

1. Runs of letters are counted in each task in a table of bounded size, then combined by Spark.
2. The upper levels of one k-d tree over lengths and letter counts deal the words to leaves. They are fitted to a bounded
   sample (about `sample` words, those of small hash); every word is dealt. A leaf whose words the tree cannot tell apart is cut
   by hash: words of equal counts are never near.
3. A word goes to its own leaf, and as a query to all leaves whose boxes its range touches.
4. A leaf's words become one k-d tree for each length; queries pass it in batches, cut by the boxes of its nodes. Pairs in
   range are verified letter by letter.
5. A word's form is its near word of largest count, if that is at least `ratio` times its own (ties: the smallest word).
   The root is found by pointer doubling along forms, whose counts only grow.

Each pair of near words is found once, from its shorter or smaller word. A word has no more near words than its length
times 181, so no join key is hot.

Defined cases: NULL and empty texts hold no words; a NULL doc_id reads as empty text. Words have letters A-Z, a-z and U+00C0
to U+00FF; only A-Z is lower-cased. Very long words are treated like others. No words: no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import settled

# Letters by their place: a-z, then U+00C0 to U+00FF. All of them are single bytes in Latin-1.
LETTERS = [*range(97, 123), *range(0xC0, 0x100)]
RUN = "[A-Za-zÀ-ÿ]"
# Queries look for words of their own length, or for words that are one letter longer.
ITEM, SAME, LONGER = 0, 1, 2


@dataclass(frozen=True)
class Spelling:
    """Shortest word and least count, how much commoner a form is, and sizes of the trees."""

    letters: int = 7
    occurrences: int = 2
    ratio: int = 10
    sample: int = 16_384
    leaf_words: int = 6_000
    leaves: int = 1_024
    bucket: int = 128
    counted_bytes: int = 32_000_000


# ---- words and their counts

Change = Callable[[bytes, str], str]


def _lowered(text: str) -> str:
    if text.isascii():
        return text.lower()
    # bytes.lower() changes A-Z alone.
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def word_counts(docs: DataFrame, params: Spelling = Spelling(), change: Change | None = None) -> DataFrame:
    """word, n: words of at least `letters` letters and `occurrences` occurrences over all texts. Settled.

    `change` may replace a run by another, given the document's id as bytes.
    """

    run = re.compile(f"{RUN}{{{params.letters},}}")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        held = 0

        def taken() -> pa.RecordBatch:
            out = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(out, ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                value = text.as_py()
                if not value:
                    continue
                own = Counter(run.findall(_lowered(value)))
                name = str(doc_id.as_py() if doc_id.is_valid else "").encode()
                for word, times in own.items():
                    found = change(name, word) if change else word
                    if len(found) >= params.letters:
                        if found not in counts:
                            held += len(found) + 100
                        counts[found] += times
                if held > params.counted_bytes:
                    yield taken()
                    held = 0
        yield taken()

    parts = docs.select("doc_id", "text").mapInArrow(rows, "word string, n bigint")
    return settled(parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= params.occurrences))


# ---- letter counts


def letter_counts(words: list[str]) -> np.ndarray:
    """One row for each word: its count of each letter."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    place = np.zeros(256, np.int64)
    place[LETTERS] = np.arange(len(LETTERS))
    codes = place[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    row = np.repeat(np.arange(len(words)), sizes)
    flat = np.bincount(row * len(LETTERS) + codes, minlength=len(words) * len(LETTERS))
    return flat.reshape(len(words), len(LETTERS)).astype(np.int16 if sizes.max(initial=0) < 2**15 else np.int32)


def _with_length(words: list[str]) -> np.ndarray:
    """Letter counts behind the length of each word."""
    counts = letter_counts(words)
    return np.column_stack([counts.sum(axis=1, dtype=np.int64), counts])


# ---- the upper tree, that deals words to leaves


@dataclass
class Leaf:
    """A leaf of the upper tree, or `chops` leaves if the tree could not tell its words apart."""

    number: int
    chops: int


@dataclass
class Split:
    """Vectors with at most `cut` in dimension `dim` go left."""

    dim: int
    cut: int
    left: Split | Leaf
    right: Split | Leaf


def _split_at(points: np.ndarray) -> tuple[int, int] | None:
    """The dimension and value that divide the points most evenly: by length first, then by a letter."""
    best = None
    for dims in ([0], range(1, points.shape[1])):
        for dim in dims:
            values, rows = np.unique(points[:, dim], return_counts=True)
            if len(values) > 1:
                left = np.cumsum(rows)[:-1]
                at = int(np.argmin(np.abs(2 * left - len(points))))
                uneven = abs(2 * int(left[at]) - len(points))
                if best is None or uneven < best[0]:
                    best = uneven, dim, int(values[at])
        if best is not None:
            return best[1:]
    return None


def upper_tree(points: np.ndarray, leaf_points: float) -> tuple[Split | Leaf, int]:
    """A tree with leaves of at most `leaf_points` sample points, and the number of leaves, chops included."""
    leaves = 0

    def leaf(chops: int) -> Leaf:
        nonlocal leaves
        leaves += chops
        return Leaf(leaves - chops, chops)

    def grow(points: np.ndarray) -> Split | Leaf:
        if len(points) <= max(leaf_points, 1):
            return leaf(1)
        found = _split_at(points)
        if found is None:
            return leaf(int(np.ceil(len(points) / max(leaf_points, 1))))
        left = points[:, found[0]] <= found[1]
        return Split(*found, grow(points[left]), grow(points[~left]))

    return grow(points), leaves


def leaves_of(tree: Split | Leaf, points: np.ndarray, kind: int) -> Iterator[tuple[Leaf, np.ndarray]]:
    """Leaves that the ranges of the points touch, each with the rows of the points.

    An ITEM has its own leaf alone. SAME may add one letter and take one, LONGER may add one.
    """
    aim = points.copy()
    aim[:, 0] += kind == LONGER
    adds, takes = int(kind != ITEM), int(kind == SAME)
    todo = [(tree, np.arange(len(points)), np.full(len(points), adds), np.full(len(points), takes))]
    while todo:
        node, rows, more, less = todo.pop()
        if not len(rows):
            continue
        if isinstance(node, Leaf):
            yield node, rows
            continue
        over = aim[rows, node.dim] - node.cut
        # The length is known; a letter's count may change by one step each way, if that step is left.
        slack = node.dim > 0
        left = (over <= 0) | ((over == 1) & (less > 0) & slack)
        todo.append((node.left, rows[left], more[left], (less - (over > 0))[left]))
        right = (over > 0) | ((over == 0) & (more > 0) & slack)
        todo.append((node.right, rows[right], (more - (over <= 0))[right], less[right]))


def _sample(words: DataFrame, total: int, params: Spelling) -> np.ndarray:
    """Vectors of about `sample` of the `total` words, those of small hash."""

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _with_length(batch.column("word").to_pylist()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in points], pa.binary())], ["vector"])

    share = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) * F.lit(total) < F.lit(params.sample << 30)
    found = words.where(share).select("word").mapInArrow(vectors, "vector binary").collect()
    return np.frombuffer(b"".join(r.vector for r in found), np.int32).reshape(-1, len(LETTERS) + 1)


def _dealt(words: DataFrame, params: Spelling) -> tuple[DataFrame, int]:
    """leaf, kind, word, n: every word as an item of one leaf and as a query of all that it may have near words in."""
    total = words.count()
    sample = _sample(words, total, params)
    per_leaf = max(params.leaf_words, total / params.leaves)
    tree, leaves = upper_tree(sample, len(sample) * per_leaf / max(total, 1))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("word").to_pylist()
            points = _with_length(names)
            chop = np.fromiter((zlib.crc32(w.encode()) for w in names), np.int64, len(names))
            for kind in (ITEM, SAME, LONGER):
                for leaf, own in leaves_of(tree, points, kind):
                    # An item has one chop, a query asks all.
                    for c in range(1) if kind == ITEM else range(leaf.chops):
                        number = leaf.number + (chop[own] % leaf.chops if kind == ITEM else np.full(len(own), c))
                        out = batch.take(pa.array(own))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(number.astype(np.int32)),
                                pa.array(np.full(len(own), kind, np.int32)),
                                out.column("word"),
                                out.column("n"),
                            ],
                            ["leaf", "kind", "word", "n"],
                        )

    return words.select("word", "n").mapInArrow(rows, "leaf int, kind int, word string, n bigint"), leaves


# ---- the trees of a leaf


class Tree:
    """K-d tree over the letter counts of words of one length, in buckets, with the box of every node."""

    def __init__(self, words: list[str], counts: list[int], params: Spelling):
        self.words, self.counts = words, counts
        points = letter_counts(words)
        self.used = np.flatnonzero(points.any(axis=0))
        self.points = points[:, self.used]
        # Sums of squares of counts are exact in these.
        self.exact = self.points.astype(np.float32 if len(words[0]) < 2_000 else np.float64)
        self.squares = np.square(self.exact).sum(axis=1)
        self.codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)
        self.root = self._grow(np.arange(len(words)), params.bucket)

    def _grow(self, rows: np.ndarray, bucket: int) -> tuple:
        points = self.points[rows]
        low, high = points.min(axis=0), points.max(axis=0)
        spread = high - low
        if len(rows) <= bucket or not spread.any():
            return low, high, rows, None
        # Of the letters that vary most, the one whose median divides the words best.
        widest = np.argsort(-spread, kind="stable")[:8]
        cuts = np.median(points[:, widest], axis=0)
        cuts = np.minimum(np.floor(cuts), high[widest] - 1)
        left = (points[:, widest] <= cuts).sum(axis=0)
        best = int(np.argmin(np.abs(2 * left - len(rows))))
        goes_left = points[:, widest[best]] <= cuts[best]
        if goes_left.all() or not goes_left.any():
            goes_left = points[:, widest[best]] == low[widest[best]]
        return low, high, None, (self._grow(rows[goes_left], bucket), self._grow(rows[~goes_left], bucket))

    def in_range(self, points: np.ndarray, takes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, word): exactly one letter more and `takes` letters less."""
        missing = points.sum(axis=1, dtype=np.int64)
        squares = np.square(points, dtype=self.exact.dtype).sum(axis=1)
        points = points[:, self.used]
        exact = points.astype(self.exact.dtype)
        # Letters that no word here has must be taken.
        missing = missing - points.sum(axis=1, dtype=np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            (low, high, rows, children), asked = todo.pop()
            q = points[asked]
            more = np.maximum(low - q, 0).sum(axis=1)
            less = np.maximum(q - high, 0).sum(axis=1) + missing[asked]
            asked = asked[(more <= 1) & (less <= takes)]
            if not len(asked):
                continue
            if children is not None:
                todo += [(child, asked) for child in children]
                continue
            # One letter more and `takes` less: so many squared steps in all, as the lengths are given.
            step = max(1, 2_000_000 // len(rows))
            for begin in range(0, len(asked), step):
                own = asked[begin : begin + step]
                apart = self.squares[rows] + squares[own][:, None] - 2 * (exact[own] @ self.exact[rows].T)
                a, b = np.nonzero(apart == 1 + takes)
                if len(a):
                    yield own[a], rows[b]


def replaced_once(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of two tables of letters that differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def inserted_once(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows where one more letter in `a` gives `b`: what is equal from the left and from the right covers `a`."""
    left = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    right = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return left + right >= a.shape[1]


def _near(tree: Tree, words: list[str], counts: list[int], kind: int) -> Iterator[pa.RecordBatch]:
    points = letter_counts(words)
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)
    step = max(1, 4_000_000 // codes.shape[1])
    for asked, found in tree.in_range(points, int(kind == SAME)):
        for begin in range(0, len(asked), step):
            a, b = asked[begin : begin + step], found[begin : begin + step]
            good = (replaced_once if kind == SAME else inserted_once)(codes[a], tree.codes[b])
            pairs = [(words[i], counts[i], tree.words[j], tree.counts[j]) for i, j in zip(a[good], b[good], strict=True)]
            if kind == SAME:
                pairs = [p for p in pairs if p[0] < p[2]]
            if pairs:
                columns = [pa.array(c) for c in zip(*pairs, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "a_n", "b", "b_n"])


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, list[str], list[int]]]:
    """Rows in runs of one (leaf, kind); a run may come in pieces."""
    for batch in batches:
        leaf, kind = batch.column("leaf").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero(np.diff(leaf * 3 + kind)) + 1
        for begin, end in zip([0, *edges], [*edges, len(leaf)], strict=True):
            if begin < end:
                part = batch.slice(begin, end - begin)
                yield int(leaf[begin]), int(kind[begin]), part.column("word").to_pylist(), part.column("n").to_pylist()


def _by_length(words: list[str], counts: list[int]) -> Iterator[tuple[int, list[str], list[int]]]:
    groups: dict[int, tuple[list[str], list[int]]] = {}
    for word, n in zip(words, counts, strict=True):
        own = groups.setdefault(len(word), ([], []))
        own[0].append(word)
        own[1].append(n)
    for length, (own_words, own_counts) in groups.items():
        yield length, own_words, own_counts


def near_pairs(words: DataFrame, params: Spelling = Spelling()) -> DataFrame:
    """a, a_n, b, b_n: every pair of near words of a settled table (word, n) once."""
    dealt, leaves = _dealt(words, params)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come by leaf, its items first, so a task holds the words of one leaf and one batch of queries.
        held, items, trees = -1, ([], []), None
        for leaf, kind, names, counts in _runs(batches):
            if leaf != held:
                held, items, trees = leaf, ([], []), None
            if kind == ITEM:
                items[0].extend(names)
                items[1].extend(counts)
                continue
            if trees is None:
                trees = {length: Tree(ws, ns, params) for length, ws, ns in _by_length(*items)}
            for length, ws, ns in _by_length(names, counts):
                tree = trees.get(length + (kind == LONGER))
                if tree is not None:
                    yield from _near(tree, ws, ns, kind)

    parts = max(leaves, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = dealt.repartition(parts, "leaf").sortWithinPartitions("leaf", "kind")
    return placed.mapInArrow(search, "a string, a_n bigint, b string, b_n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word along the forms of (word, form), by pointer doubling. Settled."""
    roots = settled(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("last")).where("root != last")
        longer = roots.join(onward, "root", "left")
        if longer.where(F.col("last").isNotNull()).isEmpty():
            return roots
        roots = settled(longer.select("word", F.coalesce("last", "root").alias("root")))


def spelling_groups(words: DataFrame, params: Spelling = Spelling()) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of a settled table (word, n)."""
    pairs = near_pairs(words, params)
    both = F.inline(
        F.array(
            F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
            F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
        )
    )
    commonest = F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    best = pairs.select(both).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), commonest)
    found = words.join(best, "word", "left")
    commoner = -F.col("best.minus") >= params.ratio * F.col("n")
    forms = settled(
        found.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(commoner, F.col("best.near")).alias("form"),
            F.when(commoner, -F.col("best.minus")).alias("form_n"),
        )
    )
    return forms.join(_roots(forms.select("word", "form")), "word").select("word", "form", "root", "n", "n_near", "form_n")


def slip(doc_id: bytes, run: str) -> str:
    """The run, or a misspelling of it: where 31 divides the checksum of id and run, one letter is left out."""
    h = zlib.crc32(doc_id + b":" + run.encode())
    place = h % len(run)
    return run if h % 31 else run[:place] + run[place + 1 :]


def document_spellings(docs: DataFrame, params: Spelling = Spelling()) -> DataFrame:
    """Spelling groups of the words of all texts, with slips."""
    return spelling_groups(word_counts(docs, params, slip), params)
