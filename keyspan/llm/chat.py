"""Chat formatting by columnar byte assembly, and the reading back of what was formatted.

A turn becomes `<|im_start|>role\\ntext<|im_end|>\\n`. Backslashes in roles and texts are doubled, and a backslash goes
between the two characters of `<|`, so no control string can come from a text and the original can be restored; a line
feed in a role becomes a backslash and `n`.

For a batch of turns, segment lengths, cumulative offsets and scatter indices are computed in numpy, and the bytes of
headers, roles and texts are copied into one preallocated Arrow buffer. The loss mask covers the texts of assistant
turns, as character positions of the formatted conversation.

A conversation may be larger than a task's memory, so it is formatted as pieces, in order: its text is their
concatenation, and the positions of the mask count from the conversation's start. Turns are shuffled by conversation
and sorted; only one batch of a conversation is in memory at a time.

Defined cases: NULL roles and texts are empty. Turns go by `turn`, role and text, NULL first; repeated rows are turns
of their own. A NULL conv_id is a conversation of its own. Further input columns are ignored. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "\n"
LEARNT_ROLE = "assistant"
TURNS_A_PIECE = 4096
BYTES_A_PIECE = 8_000_000

PIECES = "conv_id bigint, piece bigint, first_turn bigint, n_turns bigint, formatted string, mask array<struct<start:bigint,end:bigint>>"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(texts, "\\", "\\\\"), "<|", "<\\|")


def unescape(texts: pa.Array) -> pa.Array:
    # Every backslash of an escaped text begins a pair.
    return pc.replace_substring_regex(texts, r"\\(\\|\|)", r"\1")


def escape_role(roles: pa.Array) -> pa.Array:
    return pc.replace_substring(escape(roles), "\n", "\\n")


def unescape_role(roles: pa.Array) -> pa.Array:
    marked = pc.replace_substring_regex(roles, r"\\(\\|\||n)", "\x00\\1")
    for code, plain in (("\x00\\", "\\"), ("\x00|", "|"), ("\x00n", "\n")):
        marked = pc.replace_substring(marked, code, plain)
    return marked


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large_string column without nulls."""
    column = pa.concat_arrays([column])  # starts at its buffers' beginning
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
    return offsets, np.frombuffer(column.buffers()[2] or b"", np.uint8)


def assemble(segments: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the columns `segments` joined across, all in one buffer: its bytes, and the rows' offsets.

    The place of each segment follows from the cumulative lengths; all bytes of a column are scattered at once.
    """
    parts = [_bytes_of(s) for s in segments]
    lengths = np.stack([np.diff(offsets) for offsets, _ in parts], axis=1)
    ends = np.cumsum(lengths.ravel())
    begins = (ends - lengths.ravel()).reshape(lengths.shape)
    buffer = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i, (offsets, data) in enumerate(parts):
        if not len(data):
            continue
        scatter = np.repeat(begins[:, i] - offsets[:-1], lengths[:, i]) + np.arange(offsets[0], offsets[-1])
        buffer[scatter] = data[offsets[0] : offsets[-1]]
    rows = np.concatenate([[0], np.cumsum(lengths.sum(axis=1))])
    return buffer, rows


def _large(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.large_string()), "")


def format_turns(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and row offsets of the formatted turns, and where each text begins and ends, in characters of its turn."""
    role, text = escape_role(_large(roles)), escape(_large(texts))
    fixed = lambda s: pa.array([s] * len(role), pa.large_string())
    buffer, rows = assemble([fixed(START), role, fixed(NEWLINE), text, fixed(END + NEWLINE)])
    begin = len(START) + 1 + pc.utf8_length(role).to_numpy(zero_copy_only=False).astype(np.int64)
    return buffer, rows, begin, begin + pc.utf8_length(text).to_numpy(zero_copy_only=False)


def _cuts(ids: pa.Array, sizes: np.ndarray) -> list[int]:
    """First rows of pieces: where the conversation changes or a piece has grown to its limits."""
    null = pc.is_null(ids).to_numpy(zero_copy_only=False)
    value = pc.fill_null(ids, 0).to_numpy()
    change = set((np.flatnonzero((value[1:] != value[:-1]) | (null[1:] != null[:-1])) + 1).tolist())
    cuts, at, held = [0], 0, 0
    for row in range(len(ids)):
        if row and (row in change or row - at >= TURNS_A_PIECE or held + sizes[row] > BYTES_A_PIECE):
            cuts.append(row)
            at, held = row, 0
        held += int(sizes[row])
    return [*cuts, len(ids)]


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: object = ()  # no conversation yet
    piece = turns = chars = 0
    for whole in batches:
        for at in range(0, whole.num_rows, TURNS_A_PIECE):
            batch = whole.slice(at, TURNS_A_PIECE)
            buffer, rows, begin, end = format_turns(batch.column("role"), batch.column("text"))
            # Characters before each turn: the bytes that begin one.
            starts = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])[rows]
            learnt = pc.equal(pc.fill_null(batch.column("role"), ""), LEARNT_ROLE).to_numpy(zero_copy_only=False)
            cuts = _cuts(batch.column("conv_id"), np.diff(rows))
            out = []
            for first, last in zip(cuts, cuts[1:], strict=False):
                conv = batch.column("conv_id")[first].as_py()
                if (conv,) != now:
                    now, piece, turns, chars = (conv,), 0, 0, 0
                shift = starts[first:last] - starts[first] + chars
                own = learnt[first:last]
                mask = [
                    {"start": a, "end": b}
                    for a, b in zip(
                        (shift + begin[first:last])[own].tolist(), (shift + end[first:last])[own].tolist(), strict=True
                    )
                ]
                text = buffer[rows[first] : rows[last]].tobytes().decode()
                out.append((conv, piece, turns, last - first, text, mask))
                piece, turns, chars = piece + 1, turns + last - first, int(chars + starts[last] - starts[first])
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("conv_id", "piece", "first_turn", "n_turns", "formatted", "mask"), r, strict=True)) for r in out],
                pa.schema(
                    [(n, pa.int64()) for n in ("conv_id", "piece", "first_turn", "n_turns")]
                    + [("formatted", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                ),
            )


def format_conversations(turns: DataFrame) -> DataFrame:
    """Pieces of the formatted conversations, with their part of the loss mask; partitions hold whole conversations,
    their pieces in order."""
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id")
    return rows.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format, PIECES)


class _Digest:
    """What is read back from one conversation's pieces, piece by piece."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.chars, self.learnt = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, mask: list[dict]) -> None:
        turns = formatted.split(START)[1:]
        heads, bodies = [], []
        for turn in turns:
            head, _, body = turn.partition(NEWLINE)
            heads.append(head)
            bodies.append(body.removesuffix(END + NEWLINE))
        roles = unescape_role(pa.array(heads, pa.large_string())).to_pylist()
        texts = unescape(pa.array(bodies, pa.large_string())).to_pylist()
        for role, text in zip(roles, texts, strict=True):
            self.all.update(f"{role}\n{text}\n".encode())
        masked = [formatted[m["start"] - self.chars : m["end"] - self.chars] for m in mask]
        for text in unescape(pa.array(masked, pa.large_string())).to_pylist():
            self.learnt += len(text)
            self.loss.update(text.encode())
        self.turns += len(turns)
        self.chars += len(formatted)

    def row(self) -> dict:
        return {
            "conv_id": self.conv,
            "n_turns": self.turns,
            "turns_sha256": self.all.hexdigest(),
            "loss_chars": self.learnt,
            "loss_sha256": self.loss.hexdigest(),
            "formatted_chars": self.chars,
        }


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in (c.split()[0] for c in DIGESTS.split(", "))]
    )
    now: _Digest | None = None
    for batch in batches:
        done = []
        for i in range(batch.num_rows):
            if batch.column("piece")[i].as_py() == 0:
                if now is not None:
                    done.append(now.row())
                now = _Digest(batch.column("conv_id")[i].as_py())
            now.add(batch.column("formatted")[i].as_py(), batch.column("mask")[i].as_py())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.row()], schema)


def conversation_digest(turns: DataFrame) -> DataFrame:
    """For each conversation, what its formatted text gives when it is read back."""
    return format_conversations(turns).mapInArrow(_read_back, DIGESTS)
