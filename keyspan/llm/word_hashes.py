"""Hashes of all words of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

# Bytes with A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Longer words are hashed one by one.
LONG_WORD = 64
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


class _Powers:
    """Powers of BASE and of its inverse, mod 2**64, as far as they have been needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            cls.up, cls.down = (np.full(size, f, np.uint64) for f in (BASE, INVERSE))
            cls.up[0] = cls.down[0] = 1
            np.cumprod(cls.up, out=cls.up)
            np.cumprod(cls.down, out=cls.down)
        return cls.up[:n], cls.down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _of_words(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit states of each word, which take its bytes in blocks of eight.

    Each step mixes all bits, so no arithmetic between places of a word cancels. Words of up to eight bytes and equal
    length never share a state. `data` needs eight further bytes at its end.
    """
    blocks = np.ndarray(len(data) - 7, np.dtype("<u8"), data, strides=(1,))
    one = mixed(lengths.astype(np.uint64) + np.uint64(1))
    two = mixed(one ^ np.uint64(BASE))
    open_ = np.flatnonzero(lengths <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        if at:
            open_ = open_[lengths[open_] > at]
        if not len(open_):
            break
        left = np.minimum(lengths[open_] - at, 8).astype(np.uint64)
        block = blocks[begins[open_] + at] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left))
        one[open_] = mixed(one[open_] ^ block)
        two[open_] = mixed(two[open_] * np.uint64(BASE) + block)
    for word in np.flatnonzero(lengths > LONG_WORD).tolist():
        digest = xxhash.xxh3_128_intdigest(data[begins[word] : begins[word] + lengths[word]].tobytes())
        one[word], two[word] = digest >> 64, digest & (2**64 - 1)
    return one, two


def word_hashes(texts: list[bytes], lower: bool = False, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and the number of words of each text.

    The `second` hashes are independent of the others.
    """
    data = np.frombuffer(b" ".join(texts) + b" " * 9, np.uint8)
    if lower:
        data = LOWER[data]
    solid = ~BLANK[data]
    edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    begins, ends = edges[::2], edges[1::2]
    one, two = _of_words(data, begins, ends - begins)
    hashes = mixed(two ^ (one >> np.uint64(32)) ^ (one << np.uint64(32))) if second else mixed(one + two * np.uint64(BASE))
    limits = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    upto = np.searchsorted(begins, limits)
    return hashes, np.diff(upto, prepend=0)


def windows(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of `size` neighbouring words (those that go beyond one text included)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # Prefix sums again, over words: the cost does not depend on the size.
    up, down = _Powers.upto(len(hashes) + 1)
    sums = np.empty(len(hashes) + 1, np.uint64)
    sums[0] = 0
    own = mixed(hashes ^ np.uint64(salt)) if salt else hashes
    np.cumsum(own * up[:-1], out=sums[1:])
    return mixed((sums[size:] - sums[:n]) * down[:n] + np.uint64(size))


def parts_of(texts: list[str | None], limit: int = 2_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as bytes in parts of about `limit` bytes, each with the number of its first text."""
    part: list[bytes] = []
    first = size = 0
    for row, text in enumerate(texts):
        part.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(part[-1])
        if size >= limit:
            yield first, part
            part, first, size = [], row + 1, 0
    if part:
        yield first, part


def range_hashes(hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words from each of `begins` up to (not with) each of `ends`."""
    up, down = _Powers.upto(len(hashes) + 1)
    sums = np.empty(len(hashes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(hashes * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))
