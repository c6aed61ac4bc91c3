"""Byte-level BPE: encoding by DuckDB recursive queries inside each partition, decoding by ordered aggregation.

A batch of texts is split by the tokenizer's pattern. Each different piece becomes a row with the list of its pairs; a
recursive query contracts the leftmost pair of minimum rank and looks up its two new pairs in the merge table, until no
pair is left. Pieces that are tokens as they stand need no contraction. Long pieces become token-position rows (piece,
place, token) and take a query that contracts, in one step, all places that the one-by-one order would contract next:
those of the minimum rank, from the left, up to the first whose result forms a pair of lower rank with a neighbour.

The vocabulary is of fixed size and goes to the tasks once. Each task holds one batch and its pieces, no more.

Defined cases: a NULL or empty text has no tokens and decodes to an empty text. Repeated rows give equal results.
Input columns with the name of an output column are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from keyspan.llm.common import give_back, without

# Pieces above this many bytes take the query for long pieces.
LONG_PIECE = 48
BYTES_A_QUERY = 300_000
STEPS_A_QUERY = 48
CHARS_A_BATCH = 2_000_000
# A worker remembers the ids of about this many pieces from batch to batch, then forgets them all.
MOST_KNOWN = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """All pairs of tokens (a, b) whose bytes together are a token m."""
    rows = [
        (ranks[token[:cut]], ranks[token[cut:]], rank)
        for token, rank in ranks.items()
        for cut in range(1, len(token))
        if token[:cut] in ranks and token[cut:] in ranks
    ]
    columns = np.array(rows, np.int32).reshape(-1, 3)
    return pa.table({name: columns[:, i] for i, name in enumerate(("a", "b", "m"))})


# White space before a space, or a space at the end (RE2's own \s is ASCII only).
BLANK_AT_SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}] | \z"

# A list item stands for a token and the pair it forms with its right neighbour: rank of the pair, place, token, from
# the highest bits down. So the least item of a word is its leftmost pair of minimum rank.
TOKEN_BITS, PLACE_BITS = 24, 8
NO_PAIR = 2**31 - 1
# The first item of each list is no token and forms no pair.
EDGE = NO_PAIR << TOKEN_BITS + PLACE_BITS | (1 << TOKEN_BITS) - 1
# A step contracts the least item of each word: its token becomes the merged one, the next item goes, and the pairs that
# it and the item before it form now are looked up in the merge table.
SHORT_QUERY = f"""
WITH RECURSIVE step AS (
    SELECT w, items, list_min(items) AS least FROM start
    UNION ALL
    (
        WITH site AS (
            SELECT w, items, least, least >> {TOKEN_BITS + PLACE_BITS} AS m, list_position(items, least)::INTEGER AS i
            FROM step WHERE least < {NO_PAIR << TOKEN_BITS + PLACE_BITS}
        ),
        moved AS (
            SELECT s.w, flatten([
                items[:i - 2],
                [
                    (coalesce(x.m, {NO_PAIR})::BIGINT << {TOKEN_BITS + PLACE_BITS}) | (items[i - 1] & {(1 << TOKEN_BITS + PLACE_BITS) - 1}),
                    (coalesce(y.m, {NO_PAIR})::BIGINT << {TOKEN_BITS + PLACE_BITS}) | (least & {(1 << PLACE_BITS) - 1 << TOKEN_BITS}) | s.m
                ],
                items[i + 2:]
            ]) AS items
            FROM site AS s
            LEFT JOIN merges AS x ON x.ab = ((items[i - 1] & {(1 << TOKEN_BITS) - 1}) << {TOKEN_BITS}) | s.m
            LEFT JOIN merges AS y ON y.ab = (s.m << {TOKEN_BITS}) | (items[i + 2] & {(1 << TOKEN_BITS) - 1})
        )
        SELECT w, items, list_min(items) FROM moved
    )
)
SELECT items FROM step WHERE least >= {NO_PAIR << TOKEN_BITS + PLACE_BITS} ORDER BY w
"""

LONG_QUERY = """
WITH RECURSIVE step AS (
    SELECT 0 AS i, w, p, t, false AS done FROM start
    UNION ALL
    (
        WITH paired AS (
            SELECT i, w, p, t, m, m = min(m) OVER (PARTITION BY w) AS least, n, after
            FROM (
                SELECT i, w, p, t, lead(t) OVER place AS n, lead(t, 2) OVER place AS after
                FROM step WHERE i < {steps} WINDOW place AS (PARTITION BY w ORDER BY p)
            ) AS x
            LEFT JOIN merges ON a = t AND b = n
        ),
        numbered AS (
            SELECT *, row_number() OVER (PARTITION BY w ORDER BY p) AS k, coalesce(least, false) AS hit FROM paired
        ),
        runs AS (
            SELECT *, k - coalesce(max(CASE WHEN NOT hit THEN k END) OVER (PARTITION BY w ORDER BY p), 0) AS inrun
            FROM numbered
        ),
        chosen AS (
            -- of overlapping pairs every other one, from the left
            SELECT *, hit AND inrun % 2 = 1 AS take FROM runs
        ),
        sided AS (
            SELECT *, CASE WHEN lag(take, 2) OVER place THEN lag(m, 2) OVER place ELSE lag(t) OVER place END AS before
            FROM chosen WINDOW place AS (PARTITION BY w ORDER BY p)
        ),
        checked AS (
            SELECT s.*, take AND (coalesce(l.m < s.m, false) OR coalesce(r.m < s.m, false)) AS unsafe
            FROM sided AS s
            LEFT JOIN merges AS l ON s.take AND l.a = s.before AND l.b = s.m
            LEFT JOIN merges AS r ON s.take AND r.a = s.m AND r.b = s.after
        ),
        limited AS (
            SELECT *, take AND p <= coalesce(min(CASE WHEN unsafe THEN p END) OVER (PARTITION BY w), 9223372036854775807) AS go,
                count(m) OVER (PARTITION BY w) AS pairs
            FROM checked
        )
        SELECT i + 1, w, p, CASE WHEN go THEN m ELSE t END, false
        FROM (SELECT *, lag(go, 1, false) OVER (PARTITION BY w ORDER BY p) AS gone FROM limited WHERE pairs > 0)
        WHERE NOT gone
    )
)
SELECT w, p, t, i
FROM (SELECT *, i = max(i) OVER (PARTITION BY w) AS last FROM step)
WHERE last
"""

DECODE_QUERY = """
SELECT d, list(id ORDER BY pos) AS ids
FROM (SELECT d, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM encoded)
GROUP BY d
"""


def gather(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of `values` that begin at `first` and have `counts` items, end to end."""
    return values[np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]


class Tokenizer:
    """A rank file and its splitting pattern; holds a DuckDB connection, made where it is used."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self._connection = ranks, pattern, None
        self._forget()

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "pattern": self.pattern}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["ranks"], state["pattern"])

    def _forget(self) -> None:
        # The known pieces' numbers; the ids of all of them, end to end, and how many each has, by number.
        self._known: dict[str, int] = {}
        self._ids, self._counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    @property
    def connection(self) -> duckdb.DuckDBPyConnection:
        if self._connection is None:
            own = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
            own.execute("SET preserve_insertion_order = false")
            own.register("merge_rows", merge_table(self.ranks))
            own.execute(f"CREATE TABLE merges AS SELECT *, (a::BIGINT << {TOKEN_BITS}) | b AS ab FROM merge_rows")
            # Bytes of the tokens by id.
            tokens = [b""] * (max(self.ranks.values()) + 1)
            for token, rank in self.ranks.items():
                tokens[rank] = token
            self._vocabulary = pa.array(tokens, pa.large_binary())
            self._bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
            pairs = [self.ranks.get(bytes([a, b]), NO_PAIR) for a in range(256) for b in range(256)]
            self._byte_pairs = np.array(pairs, np.int64).reshape(256, 256)
            # White space is the Unicode property, as in the pattern's own dialect.
            space = self.pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
            self._split = regex.compile(space)
            self._connection = own
        return self._connection

    def release(self) -> None:
        """Gives back what has been made of the vocabulary; it is made again where it is needed."""
        if self._connection is not None:
            self._connection.close()
        self._connection = None
        self._forget()

    def _contract_short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of these pieces, end to end, and how many each has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        pairs = np.append(self._byte_pairs[raw[:-1], raw[1:]], NO_PAIR)
        pairs[ends - 1] = NO_PAIR
        places = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
        items = pairs << TOKEN_BITS + PLACE_BITS | places << TOKEN_BITS | self._bytes[raw]
        items = np.insert(items, ends - lengths, EDGE)
        offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(items))
        self.connection.register("start", pa.table({"w": np.arange(len(pieces), dtype=np.int32), "items": lists}))
        found = self.connection.sql(SHORT_QUERY).to_arrow_table()["items"].combine_chunks()
        counts = pc.list_value_length(found).to_numpy().astype(np.int64) - 1
        tokens = found.flatten().to_numpy() & (1 << TOKEN_BITS) - 1
        return np.delete(tokens, np.cumsum(counts + 1) - counts - 1).astype(np.int32), counts

    def _start(self, piece: bytes) -> pa.Table:
        tokens = self._bytes[np.frombuffer(piece, np.uint8)]
        return pa.table({"w": np.zeros(len(tokens), np.int32), "p": np.arange(len(tokens), dtype=np.int32), "t": tokens})

    def _contract_long(self, piece: bytes) -> list[int]:
        state, steps = self._start(piece), STEPS_A_QUERY
        while True:
            self.connection.register("start", state)
            rows = self.connection.sql(LONG_QUERY.format(steps=steps)).to_arrow_table().sort_by("p")
            if rows["i"][0].as_py() < steps:
                return rows["t"].to_pylist()
            state = rows.select(["w", "p", "t"])

    def _learn(self, pieces: list[str]) -> None:
        """Puts the ids of these pieces where they can be looked up."""
        tokens: list[str] = []
        short: list[str] = []
        long: list[str] = []
        ranks: list[int] = []
        for piece in pieces:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                tokens.append(piece)
                ranks.append(rank)
            elif len(raw) > LONG_PIECE:
                long.append(piece)
            else:
                short.append(piece)
        ids, counts = [self._ids, np.array(ranks, np.int32)], [self._counts, np.ones(len(ranks), np.int64)]
        raws = [p.encode() for p in short]
        ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))
        begin = 0
        while begin < len(raws):
            before = ends[begin - 1] if begin else 0
            end = int(np.searchsorted(ends, before + BYTES_A_QUERY)) + 1
            for own, more in zip((ids, counts), self._contract_short(raws[begin:end]), strict=True):
                own.append(more)
            begin = end
        for piece in long:
            ids.append(np.array(self._contract_long(piece.encode()), np.int32))
            counts.append(np.array([len(ids[-1])]))
        self._known.update(zip([*tokens, *short, *long], range(len(self._counts), len(self._counts) + len(pieces)), strict=True))
        self._ids, self._counts = np.concatenate(ids), np.concatenate(counts)

    def _cut(self, texts: list[str]) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
        """Different segments behind a space, different other ones, the segments of each text in order, how many it has.

        Texts are cut before spaces. A cut is safe after a character that isn't white space, as no piece goes across;
        a text where white space stands before a space, or a space at the end, is one segment.
        """
        column = pa.array(texts, pa.large_string())
        whole = pc.match_substring_regex(column, BLANK_AT_SPACE)
        parts = pc.split_pattern(pc.if_else(whole, "", column), " ")
        coded = parts.flatten().dictionary_encode()
        order = coded.indices.to_numpy().astype(np.int64)
        offsets = parts.offsets.to_numpy()
        # The first segment of a text has no space before it, so it is another segment than the same word elsewhere.
        begins = pc.if_else(whole, column, parts.flatten().take(pa.array(offsets[:-1]))).dictionary_encode()
        order[offsets[:-1]] = len(coded.dictionary) + begins.indices.to_numpy()
        used = np.bincount(order, minlength=len(coded.dictionary) + len(begins.dictionary)) > 0
        inner = coded.dictionary.to_numpy(zero_copy_only=False)[used[: len(coded.dictionary)]].tolist()
        return inner, begins.dictionary.to_pylist(), (np.cumsum(used) - 1)[order], np.diff(offsets)

    def _pieces(self, inner: list[str], begins: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Pieces of all segments, the first one of each segment, and how many it has; `inner` stand behind a space."""
        first, count = np.zeros((2, len(inner) + len(begins)), np.int64)
        # Segments without white space at their ends are split as one text, as it is safe to cut that before each space.
        bare = [len(s.strip()) == len(s) > 0 for s in inner]
        pieces = self._split.findall("".join([" " + s for s, b in zip(inner, bare, strict=True) if b]))
        starts = np.flatnonzero(np.fromiter((p.startswith(" ") for p in pieces), bool, len(pieces)))
        if len(starts) == sum(bare):
            first[: len(inner)][bare] = starts
            count[: len(inner)][bare] = np.diff(np.append(starts, len(pieces)))
        else:
            # Another pattern's pieces, which don't begin at each space.
            pieces, bare = [], [False] * len(inner)
        rest = [(k, " " + s) for k, s in enumerate(inner) if not bare[k]]
        for k, segment in [*rest, *enumerate(begins, len(inner))]:
            own = self._split.findall(segment)
            first[k], count[k] = len(pieces), len(own)
            pieces += own
        return pieces, first, count

    def encode(self, texts: list[str]) -> pa.ListArray:
        """Token ids of each text, as one column of lists."""
        _ = self.connection
        inner, begins, every, per_text = self._cut(texts)
        pieces, first, count = self._pieces(inner, begins)
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self._known) > MOST_KNOWN:
            self._forget()
        self._learn([p for p in different if p not in self._known])
        number = np.array([self._known[p] for p in different], np.int64)[coded.indices.to_numpy()]
        counts = self._counts[number]
        ids = gather(self._ids, (np.cumsum(self._counts) - self._counts)[number], counts)
        # Where the ids of each segment lie, and those of each text.
        places = np.concatenate([[0], np.cumsum(counts)])
        lengths = (places[first + count] - places[first])[every]
        flat = gather(ids, places[first][every], lengths)
        ends = np.concatenate([[0], np.cumsum(per_text)])
        offsets = np.concatenate([[0], np.cumsum(lengths)])[ends]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))

    def decode(self, ids: pa.ListArray) -> list[bytes]:
        """The bytes that each list of ids stands for."""
        self.connection.register("encoded", pa.table({"d": np.arange(len(ids)), "ids": ids}))
        rows = self.connection.sql(DECODE_QUERY).to_arrow_table().combine_chunks()
        if not rows.num_rows:
            return [b""] * len(ids)
        column = rows["ids"].chunk(0)
        tokens = self._vocabulary.take(column.flatten())
        places = np.frombuffer(tokens.buffers()[1], np.int64, len(tokens) + 1, tokens.offset * 8)
        data = tokens.buffers()[2].to_pybytes() if len(tokens) else b""
        limits = places[column.offsets.to_numpy() - column.offsets[0].as_py()].tolist()
        out = [b""] * len(ids)
        for d, x, y in zip(rows["d"].to_pylist(), limits, limits[1:], strict=False):
            out[d] = data[x:y]
        return out


def sized_parts(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of text or list items in `column`, one row at least."""
    values = batch.column(batch.schema.get_field_index(column))
    length = pc.binary_length if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else pc.list_value_length
    sizes = np.cumsum(pc.fill_null(length(values), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        before = sizes[begin - 1] if begin else 0
        end = min(batch.num_rows, int(np.searchsorted(sizes, before + limit)) + 1)
        yield batch.slice(begin, end - begin)
        begin = end


def _schema(df: DataFrame, more: str) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema) + more


Batches = Iterable[pa.RecordBatch]


def _encoder(shared: Broadcast) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    def encode(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized_parts(batch, "text", CHARS_A_BATCH):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                ids = shared.value.encode([t or "" for t in texts])
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, "ids"])

    return encode


def _decoder(shared: Broadcast) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    def decode(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized_parts(batch, "ids", CHARS_A_BATCH // 2):
                column = part.column(part.schema.get_field_index("ids")).fill_null([])
                decoded = pa.array(shared.value.decode(column), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], [*part.schema.names, "decoded"])

    return decode


# The broadcasts of an application, by its id, the rank file and the pattern.
_SHARED: dict[tuple[str, str, str], Broadcast] = {}


def _share(df: DataFrame, path: str, pattern: str) -> Broadcast:
    # One vocabulary, whose size the tokenizer fixes; a worker keeps what it has made of it from task to task. Further
    # calls share it, so that workers don't gather a copy for each of them.
    context = df.sparkSession.sparkContext
    key = (context.applicationId, path, pattern)
    if key not in _SHARED:
        _SHARED[key] = context.broadcast(Tokenizer(read_ranks(path), pattern))
    return _SHARED[key]


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """`docs` and `ids`, the token ids of `text`."""
    kept = without(docs, ["ids"])
    return kept.mapInArrow(_encoder(_share(docs, path, pattern)), _schema(kept, "ids array<int>"))


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """`encoded` and `decoded`, the bytes that `ids` stand for."""
    kept = without(encoded, ["decoded"])
    return kept.mapInArrow(_decoder(_share(encoded, path, pattern)), _schema(kept, "decoded binary"))


def _compared(batches: Batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "").cast(pa.binary())
        columns = [batch.column(n) for n in batch.schema.names if n != "decoded"]
        names = [n for n in batch.schema.names if n != "decoded"]
        same = pc.equal(texts, batch.column("decoded"))
        yield pa.RecordBatch.from_arrays([*columns, same], [*names, "round_trip"])


def encode_and_compare(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """`docs`, `ids`, and `round_trip`: whether the ids decode to the text. One worker does both, batch by batch."""
    kept = without(docs, ["ids", "decoded", "round_trip"])
    shared = _share(docs, path, pattern)
    encode, decode = _encoder(shared), _decoder(shared)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        # After other stages the workers' memory is dear: what a task has learnt goes with it.
        try:
            yield from _compared(decode(encode(batches)))
        finally:
            shared.value.release()
            give_back()

    return kept.mapInArrow(run, _schema(kept, "ids array<int>, round_trip boolean"))


def _digests(batches: Batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        shown = pa.ListArray.from_arrays(pa.array(ids.offsets.to_numpy() - ids.offsets[0].as_py(), pa.int32()), ids.flatten().cast(pa.string()))
        listed = [hashlib.sha256(x.as_buffer()).hexdigest() for x in pc.binary_join(shown, ",").cast(pa.binary())]
        decoded = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("decoded")]
        columns = [batch.column("doc_id"), pc.list_value_length(ids).cast(pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encoding_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: its text encoded, and the ids decoded.

    The steps of `encode_texts` and `decode_ids` follow one another in one worker, batch by batch.
    """
    shared = _share(docs, path, pattern)
    encode, decode = _encoder(shared), _decoder(shared)
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _digests(decode(encode(batches))),
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )
