"""Exact Jaccard join of documents by their sets of word n-grams, as connected classes.

1. Each text becomes the sorted array of its n-gram hashes. Equal sets collapse into one.
2. Two sets can only reach the threshold if they share some of the first few n-grams of a common order (prefix
   filter; the larger the sets, the longer the prefixes and the more n-grams they must share). The order puts the most
   frequent n-grams last, so a passage that very many texts share is compared only for texts that consist of such
   passages. Any list of frequent n-grams gives right results.
3. Sets that share such an n-gram, in bands of similar size, form a tile. Within a tile, bit counts of hashed bitmap
   signatures bound each overlap from above; pairs that can't reach the threshold end here.
4. Pairs that share enough n-grams over all tiles are tested exactly, by intersecting the sorted arrays. A dense tile, with many more such pairs than
   sets, is cut into blocks by size; each pair of blocks whose sizes may match is a task, which tests pairs of sets
   that it has not yet found connected, and returns a spanning forest of its links. So a class costs links in
   proportion to its sets, and no link between classes is lost. A forest of the most similar pairs of a dense tile is
   tested first; where it connects the whole tile, no more is to be done.
5. Classes are the connected components.

Defined cases: a text without words (or NULL) has an empty set and no links; its component is its own id. With fewer
words than n, all of them are one n-gram. A NULL doc_id takes no part: its component is NULL. Rows with the same id
are one node. Repeated rows give equal results, one each. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyspan.llm.common import settled
from keyspan.llm.components import connected
from keyspan.llm.word_hashes import mixed, parts_of, windows, word_hashes


@dataclass(frozen=True)
class Join:
    """n-gram length, threshold in percent, and sizes that change the cost only, never the result."""

    n: int = 4
    percent: int = 85
    lower: bool = True
    frequent_share: float = 0.0001
    most_frequent: int = 100_000
    signature_words: int = 8
    tile: int = 512
    block: int = 1024
    dense: int = 32

    def need(self, size):
        """How many n-grams the prefixes of similar sets must share, if this is the size of the smaller one."""
        return 1 + size // 64

    def probe(self, size: int) -> int:
        """Length of the prefix that shares enough with the shorter prefix of every similar set that is not larger."""
        return min(size, size - (self.percent * size + 99) // 100 + self.need(size))

    def index(self, size: int) -> int:
        return min(size, size - -(-2 * self.percent * size // (100 + self.percent)) + self.need(size))

    def linked(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * common >= self.percent * (a + b - common)


@dataclass(frozen=True)
class Sets:
    """Sorted n-gram hashes of several texts, end to end."""

    flat: np.ndarray
    ends: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def __iter__(self) -> Iterator[np.ndarray]:
        begin = 0
        for end in self.ends.tolist():
            yield self.flat[begin:end]
            begin = end

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each set, as signed numbers."""
        begins = self.ends - self.sizes
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (mixed(self.flat), self.flat)]
        first, second = (s[self.ends] - s[begins] for s in sums)
        return mixed(first).view(np.int64), mixed(second + self.sizes.astype(np.uint64)).view(np.int64)

    def signatures(self, words: int) -> np.ndarray:
        """Bitmaps in which each n-gram sets one bit: a row of `words` numbers for each set."""
        bits = np.zeros((len(self.ends), words * 64), np.uint8)
        bits[np.repeat(np.arange(len(self.ends)), self.sizes), (mixed(self.flat) % np.uint64(words * 64)).astype(np.int64)] = 1
        return np.packbits(bits, axis=1).view(np.uint64)


def text_sets(texts: list[str | None], join: Join) -> Iterator[Sets]:
    """The sets of all texts, in parts of bounded size."""
    for _, part in parts_of(texts, 1_000_000):
        hashes, counts = word_hashes(part, join.lower)
        grams = windows(hashes, join.n)
        own, at = [], 0
        for k in counts.tolist():
            if k >= join.n:
                own.append(grams[at : at + k - join.n + 1])
                own[-1].sort()
            else:
                own.append(windows(hashes[at : at + k], k, salt=k) if k else grams[:0])
            at += k
        flat = np.concatenate(own)
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
        fresh = np.ones(len(flat), bool)
        fresh[1:] = flat[1:] != flat[:-1]
        fresh[(ends - np.diff(ends, prepend=0))[np.diff(ends, prepend=0) > 0]] = True
        yield Sets(flat[fresh], np.concatenate([[0], np.cumsum(fresh)])[ends])


def _bound(sizes: np.ndarray, other_sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most that sets with these sizes and bitmaps can have in common."""
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(sizes - only_a, other_sizes - only_b)


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def frequent_grams(docs: DataFrame, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the n-grams that a large share of documents has; at most `most_frequent`."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= 3
            return pa.RecordBatch.from_arrays(
                [pa.array(grams[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["gram", "n"]
            )

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for sets in text_sets(_column(batch, "text"), join):
                held.append(sets.flat)
                size += len(sets.flat)
                if size >= 4_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    total = docs.count()
    rows = (
        docs.select("text")
        .mapInArrow(count, "gram bigint, n bigint")
        .groupBy("gram")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= max(8, join.frequent_share * total))
        .orderBy(F.desc("n"), "gram")
        .limit(join.most_frequent)
        .toPandas()
    )
    order = np.argsort(rows["gram"].to_numpy(np.int64).view(np.uint64))
    return rows["gram"].to_numpy(np.int64).view(np.uint64)[order], rows["n"].to_numpy(np.int64)[order]


def _prefixes(sets: Sets, frequent: tuple[np.ndarray, np.ndarray], join: Join) -> list[np.ndarray]:
    """The prefix of each set in the common order: n-grams that aren't frequent, then the others by frequency."""
    hashes, counts = frequent
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, sets.flat), len(hashes) - 1)
        often = hashes[at] == sets.flat
    else:
        at, often = np.zeros(len(sets.flat), np.int64), np.zeros(len(sets.flat), bool)
    out, begin = [], 0
    for end in sets.ends.tolist():
        length = join.probe(end - begin) if end > begin else 0
        grams, late = sets.flat[begin:end], often[begin:end]
        first = grams[~late] if late.any() else grams
        if len(first) < length:
            rest = grams[late]
            first = np.concatenate([first, rest[np.lexsort((rest, counts[at[begin:end][late]]))]])
        out.append(first[:length])
        begin = end
    return out


def set_table(docs: DataFrame, join: Join) -> DataFrame:
    """doc_id, size, k1, k2 (hashes of the set) and its signature, for each row. Settled: a narrow table."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in text_sets(_column(batch, "text"), join):
                k1, k2 = sets.keys()
                bits = sets.signatures(join.signature_words)
                columns = [
                    batch.column("doc_id").slice(at, len(k1)),
                    pa.array(sets.sizes),
                    pa.array(k1),
                    pa.array(k2),
                    pa.array([row.tobytes() for row in bits], pa.binary()),
                ]
                at += len(k1)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "size", "k1", "k2", "bits"])

    schema = "doc_id bigint, size bigint, k1 bigint, k2 bigint, bits binary"
    return settled(docs.select("doc_id", "text").mapInArrow(rows, schema))


def _prefix_rows(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], join: Join) -> DataFrame:
    """gram, k1, size, short (whether the n-gram is in the shorter prefix): the prefixes of all sets."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets of this task, which copies repeat
        for batch in batches:
            for sets in text_sets(_column(batch, "text"), join):
                k1, k2 = sets.keys()
                fresh = np.zeros(len(k1), bool)
                for i, key in enumerate(zip(k1.tolist(), k2.tolist(), strict=True)):
                    if key not in seen:
                        seen.add(key)
                        fresh[i] = True
                prefixes = [p for p, f in zip(_prefixes(sets, shared.value, join), fresh, strict=True) if f]
                if not any(map(len, prefixes)):
                    continue
                lengths = np.fromiter(map(len, prefixes), np.int64, len(prefixes))
                places = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                sizes = sets.sizes[fresh]
                short = np.fromiter((join.index(n) if n else 0 for n in sizes.tolist()), np.int64, len(sizes))
                columns = [
                    np.concatenate(prefixes).view(np.int64),
                    np.repeat(k1[fresh], lengths),
                    np.repeat(sizes, lengths),
                    places < np.repeat(short, lengths),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "k1", "size", "short"])

    return docs.select("text").mapInArrow(rows, "gram bigint, k1 bigint, size bigint, short boolean")


def _shared_prefix_rows(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], join: Join) -> DataFrame:
    """The prefix rows whose n-gram two sets or more share, one of them in the shorter prefix."""
    rows = _prefix_rows(docs.where(F.col("doc_id").isNotNull()), frequent, join)
    rows = rows.repartition("gram").groupBy("gram", "k1", "size").agg(F.max("short").alias("short"))
    group = Window.partitionBy("gram")
    return (
        rows.withColumn("members", F.count("*").over(group))
        .withColumn("any_short", F.max("short").over(group))
        .where((F.col("members") > 1) & F.col("any_short"))
        .drop("any_short")
    )


def _forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Which of the allowed pairs form a spanning forest of largest weight: every part takes its best pair, again and again."""
    chosen = np.zeros(len(a), bool)
    order = np.flatnonzero(allowed)
    order = order[np.argsort(-weight[order], kind="stable")]
    if not len(order):
        return chosen
    nodes, ends = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    x, y = ends[: len(order)], ends[len(order) :]
    label = np.arange(len(nodes))
    while True:
        cross = np.flatnonzero(label[x] != label[y])
        if not len(cross):
            return chosen
        # The first pair of each part in the one order of all pairs: such choices form no cycle.
        both = np.full(len(nodes), len(order))
        np.minimum.at(both, label[x[cross]], cross)
        np.minimum.at(both, label[y[cross]], cross)
        best = np.unique(both[both < len(order)])
        chosen[order[best]] = True
        # Join the parts that the chosen pairs connect: labels fall to the least until nothing changes.
        u, v = label[x[best]], label[y[best]]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[u], root[v])
            before = root.copy()
            np.minimum.at(root, u, low)
            np.minimum.at(root, v, low)
            root = root[root]
            if (root == before).all():
                break
        label = root[label]


def _dense_columns(size: np.ndarray) -> list[pa.Array]:
    none = pa.nulls(len(size), pa.int64())
    return [none, pa.array(size), none, none]


def _tile_pairs(join: Join):
    """Function for rows sorted by n-gram and size: pairs (a, b) that may be linked, and the members of dense tiles."""

    def pairs(table: dict[str, np.ndarray]) -> Iterator[list[pa.Array]]:
        gram, size, key, short, bits = (table[c] for c in ("gram", "size", "k1", "short", "bits"))
        starts = np.flatnonzero(np.diff(gram, prepend=gram[0] - 1))
        lengths = np.diff(np.append(starts, len(gram)))
        group = np.repeat(np.arange(len(starts)), lengths)
        big = lengths > join.tile
        found = [[], []]
        step = 1
        live = np.flatnonzero(~big[group])
        while len(live):
            live = live[live + step < len(gram)]
            live = live[group[live + step] == group[live]]
            if not len(live):
                break
            other = live + step
            # Sizes ascend within a tile, so the smaller set comes first.
            fits = 100 * size[live] >= join.percent * size[other]
            live, other = live[fits], other[fits]
            use = short[live] & (key[live] != key[other])
            a, b = live[use], other[use]
            common = _bound(size[a], size[b], bits[a], bits[b])
            may = join.linked(common, size[a], size[b])
            found[0].append(a[may])
            found[1].append(b[may])
            step += 1
        a = np.concatenate(found[0]) if found[0] else np.empty(0, np.int64)
        b = np.concatenate(found[1]) if found[1] else np.empty(0, np.int64)
        per_group = np.bincount(group[a], minlength=len(starts))
        dense = big | (per_group > join.dense * lengths)
        # Of a dense tile, the pairs of a spanning forest that takes the most similar first; these are tested anyway.
        use = ~dense[group[a]]
        common = _bound(size[a], size[b], bits[a], bits[b])
        forest = _forest(a, b, common / (size[a] + size[b] - common), ~use)
        every = use | forest
        need = join.need(size[a])
        pair = np.sort(np.stack([key[a], key[b]], axis=1)[every], axis=1)
        pair, first, inverse = np.unique(pair, axis=0, return_index=True, return_inverse=True)
        votes = np.bincount(inverse.ravel(), weights=np.where(forest, need, 1)[every], minlength=len(pair)).astype(np.int64)
        none = pa.nulls(len(pair), pa.int64())
        yield [none, pa.array(pair[:, 0]), pa.array(pair[:, 1]), none, pa.array(votes), pa.array(need[every][first])]
        rows = dense[group]
        yield [pa.array(gram[rows]), pa.array(key[rows]), *_dense_columns(size[rows])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        names = ["gram", "a", "b", "size", "votes", "need"]

        def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
            columns = {c: table.column(c).to_numpy() for c in ("gram", "size", "k1", "short")}
            raw = b"".join(table.column("bits").to_pylist())
            columns["bits"] = np.frombuffer(raw, np.uint64).reshape(-1, join.signature_words)
            for out in pairs(columns):
                yield pa.RecordBatch.from_arrays(out, names)

        for batch in batches:
            # Tiles above the limit are dense: their rows pass by. A smaller one that the batch's end may cut waits.
            large = pc.greater(batch.column("members"), join.tile)
            passed = batch.filter(large)
            if passed.num_rows:
                columns = [passed.column("gram"), passed.column("k1"), *_dense_columns(passed.column("size").to_numpy())]
                yield pa.RecordBatch.from_arrays(columns, names)
            batch = batch.filter(pc.invert(large))
            if not batch.num_rows:
                continue
            gram = batch.column("gram").to_numpy()
            last = int(np.searchsorted(gram, gram[-1]))
            whole = [*held, batch.slice(0, last)] if last else []
            if not last and held and held[-1].column("gram")[0].as_py() != gram[0]:
                whole = held
            if whole:
                yield from emit(pa.Table.from_batches(whole).combine_chunks())
                held = []
            held.append(batch.slice(last))
        if held:
            yield from emit(pa.Table.from_batches(held).combine_chunks())

    return run


def _texts(docs: DataFrame, wanted: DataFrame, reps: DataFrame, join: Join) -> DataFrame:
    """k1 and the packed text of one document of each wanted set. Settled."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = _column(batch, "text")
            keys = [key for sets in text_sets(texts, join) for key in sets.keys()[0].tolist()]
            packed = [packer.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            columns = [
                batch.column("doc_id"),
                pa.array(keys, pa.int64()),
                pa.array(packed, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "packed"])

    chosen = reps.join(wanted.select("k1").distinct(), "k1", "left_semi").select("doc_id", "k1")
    packed = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(
        pack, "doc_id bigint, k1 bigint, packed binary"
    )
    return settled(packed.join(chosen, ["doc_id", "k1"], "left_semi").groupBy("k1").agg(F.min("packed").alias("packed")))


def _unpacked(packed: list[bytes], join: Join) -> list[np.ndarray]:
    unpacker = zstandard.ZstdDecompressor()
    texts = [unpacker.decompress(p).decode("utf-8", "surrogatepass") for p in packed]
    return [grams for sets in text_sets(texts, join) for grams in sets]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _verify(join: Join):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keep = []
                first, second = (_unpacked(_column(part, c), join) for c in ("packed_a", "packed_b"))
                for i, (x, y) in enumerate(zip(first, second, strict=True)):
                    if join.linked(np.int64(_common(x, y)), len(x), len(y)):
                        keep.append(i)
                yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _dense_links(join: Join):
    """Links of one pair of blocks: a spanning forest of all links between its sets."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "k1"], ignore_index=True).drop_duplicates("k1", ignore_index=True)
        keys, sizes = frame["k1"].to_numpy(), frame["size"].to_numpy()
        sets = _unpacked(frame["packed"].tolist(), join)
        words = max(8, 1 << int(np.ceil(np.log2(max(1, sizes.max()) * 8 / 64))))
        whole = Sets(np.concatenate(sets), np.cumsum([len(x) for x in sets]))
        bits = whole.signatures(words)
        # Sets of one part begin under the part's first set.
        _, first, number = np.unique(frame["part"].to_numpy(), return_index=True, return_inverse=True)
        parent = first[number]

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        links: list[tuple[int, int]] = []
        for i in range(len(keys)):
            upto = int(np.searchsorted(sizes, sizes[i] * 100 // join.percent, side="right"))
            others = np.arange(i + 1, upto)
            if not len(others):
                continue
            common = _bound(sizes[i], sizes[others], bits[i], bits[others])
            for j in others[join.linked(common, sizes[i], sizes[others])].tolist():
                a, b = root(i), root(j)
                if a != b and join.linked(np.int64(_common(sets[i], sets[j])), sizes[i], sizes[j]):
                    parent[max(a, b)] = min(a, b)
                    links.append((i, j))
        ends = np.array(links, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": keys[ends[:, 0]], "b": keys[ends[:, 1]]})

    return run


def set_links(docs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """Links (a, b) between sets by k1: enough of them that the connected classes are those of all links."""
    named = sets.where(F.col("doc_id").isNotNull() & (F.col("size") > 0))
    reps = settled(named.groupBy("k1").agg(F.min("doc_id").alias("doc_id"), F.min("bits").alias("bits"), F.min("k2").alias("low"), F.max("k2").alias("high")))
    if not reps.where("low <> high").isEmpty():
        raise RuntimeError("two sets share a 64-bit key; change the hash constants")
    frequent = frequent_grams(docs, join)
    shared = _shared_prefix_rows(docs, frequent, join)
    tiles = settled(
        shared.join(reps.select("k1", "bits"), "k1")
        .select("gram", "size", "k1", "short", "members", "bits")
        .repartition("gram")
        .sortWithinPartitions("gram", "size", "k1")
        .mapInArrow(_tile_pairs(join), "gram bigint, a bigint, b bigint, size bigint, votes bigint, need bigint")
        .groupBy("gram", "a", "b", "size")
        .agg(F.sum("votes").alias("votes"), F.max("need").alias("need"))
        # A pair with too few votes has none, or shares a dense tile besides, which sees to it.
        .where(F.col("b").isNull() | (F.col("votes") >= F.col("need")))
        .drop("votes", "need")
    )
    pairs = tiles.where(F.col("b").isNotNull()).select("a", "b")
    dense = tiles.where(F.col("b").isNull()).select("gram", F.col("a").alias("k1"), "size")
    wanted = tiles.select(F.explode(F.array_compact(F.array("a", "b"))).alias("k1"))
    texts = _texts(docs, wanted, reps, join)

    first = texts.select(F.col("k1").alias("a"), F.col("packed").alias("packed_a"))
    second = texts.select(F.col("k1").alias("b"), F.col("packed").alias("packed_b"))
    checked = settled(pairs.join(second, "b").join(first, "a").mapInArrow(_verify(join), "a bigint, b bigint"))

    # Dense tiles whose sets are all in one class by now are done. In the others, what is connected stays so.
    parts = connected(checked).withColumnRenamed("node", "k1")
    part = F.coalesce("component", "k1")
    dense = dense.join(parts, "k1", "left").select("gram", "k1", "size", part.alias("part"))
    split = dense.groupBy("gram").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    dense = dense.join(split.select("gram"), "gram", "left_semi")

    # Blocks of neighbouring sizes; two blocks meet only if some of their sizes may match.
    rank = F.row_number().over(Window.partitionBy("gram").orderBy("size", "k1")) - 1
    placed = settled(dense.withColumn("block", F.floor(rank / join.block)))
    blocks = placed.groupBy("gram", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    left, right = (blocks.select("gram", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "low", "high"))) for s in "ij")
    met = (
        left.join(right, "gram")
        .where((F.col("block_i") <= F.col("block_j")) & (100 * F.col("high_i") >= join.percent * F.col("low_j")))
        .select("gram", "block_i", "block_j", F.explode(F.array_distinct(F.array("block_i", "block_j"))).alias("block"))
    )
    tasks = placed.join(met, ["gram", "block"]).select("gram", "block_i", "block_j", "k1", "size", "part")
    found = (
        tasks.join(texts, "k1")
        .groupBy("gram", "block_i", "block_j")
        .applyInPandas(_dense_links(join), "a bigint, b bigint")
    )
    return checked.union(found)


def similar_classes(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs`."""
    sets = set_table(docs, join)
    classes = connected(set_links(docs, sets, join))
    filled = sets.where(F.col("doc_id").isNotNull() & (F.col("size") > 0))
    keyed = filled.join(classes.withColumnRenamed("node", "k1"), "k1", "left").select(
        "doc_id", F.coalesce("component", "k1").alias("class")
    )
    # A document links all classes that rows with its id belong to (one, unless ids repeat).
    least = keyed.groupBy("class").agg(F.min("doc_id").alias("first"))
    ids = keyed.join(least, "class").groupBy("doc_id").agg(F.min("first").alias("low"), F.max("first").alias("high"))
    ids = settled(ids)
    split = ids.where("low <> high")
    if split.isEmpty():
        component = ids.select("doc_id", F.col("low").alias("component_id"))
    else:
        more = connected(
            ids.select(F.col("doc_id").alias("a"), F.col("low").alias("b")).union(
                keyed.join(least, "class").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
            )
        )
        component = ids.join(more.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
            "doc_id", F.coalesce("component", "low").alias("component_id")
        )
    return sets.join(component, "doc_id", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each_class(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """The rows of `docs` but those whose class has a smaller doc_id; of rows with one id, all stay."""
    classes = similar_classes(docs, join)
    gone = classes.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
