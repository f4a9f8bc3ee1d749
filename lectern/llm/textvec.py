"""Vectorised text primitives over Arrow string columns.

A batch of texts is handled as one byte buffer: word borders, ASCII lower
case and hashes are computed for the whole batch by array arithmetic, so no
Python code runs per word.  Words are maximal runs of bytes outside
``\\x20`` and ``\\x09-\\x0D``; as those are ASCII, byte borders are character
borders in UTF-8.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply); changes a copy."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _tables(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03) + U64(seed))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACES: dict[int, np.ndarray] = {}


def _places(n: int, seed: int) -> np.ndarray:
    """An odd random factor for each of the first n places of a part."""
    have = _PLACES.get(seed)
    if have is None or len(have) < n:
        size = max(1024, 1 << max(n - 1, 1).bit_length())
        have = mix(np.arange(1, size + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + mix(np.full(1, seed + 1, U64))) | U64(1)
        if len(_PLACES) > 64:
            _PLACES.clear()
        _PLACES[seed] = have
    return have


@dataclass
class Bytes:
    """The texts of a batch: one buffer, and each text's first and last byte."""

    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, n + 1

    @classmethod
    def of(cls, column: pa.Array) -> "Bytes":
        """From an Arrow string array; null counts as the empty text."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        column = column.cast(pa.large_string())
        n = len(column)
        _, offs, data = column.buffers()
        if n == 0:
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        return cls(raw[offsets[0] : offsets[-1]], offsets - offsets[0])


@dataclass
class Spans:
    """Parts of each text: byte borders in the batch, and the first part of each text."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n + 1, index of each text's first part


def words(b: Bytes) -> Spans:
    """Borders of all words of all texts."""
    if not len(b.data):
        z = np.zeros(0, np.int64)
        return Spans(z, z, np.zeros(len(b.offsets), np.int64))
    inside = ~_SPACE[b.data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cuts = b.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(b.data))]  # a text's end also ends a word
    start[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    return Spans(s, e, np.searchsorted(s, b.offsets))


def lines(b: Bytes) -> Spans:
    """Borders of the parts between line feeds; an empty text has none."""
    feed = np.flatnonzero(b.data == 10)
    n = len(b.offsets) - 1
    filled = np.flatnonzero(b.offsets[1:] > b.offsets[:-1])
    start = np.union1d(b.offsets[:-1][filled], feed[:] + 1)
    # a feed that ends the text opens one more, empty, part
    opens = np.concatenate([b.offsets[:-1][filled], feed + 1])
    owner = np.concatenate([filled, np.searchsorted(b.offsets, feed, side="right") - 1])
    order = np.lexsort((opens, owner))
    start, owner = opens[order], owner[order]
    close = np.concatenate([b.offsets[1:][filled], feed])
    close_owner = np.concatenate([filled, np.searchsorted(b.offsets, feed, side="right") - 1])
    end = close[np.lexsort((close, close_owner))]
    return Spans(start, end, np.searchsorted(owner, np.arange(n + 1)))


#: Bytes that are hashed at once: bounds the memory of very long batches.
BLOCK = 1 << 18


def hashes(b: Bytes, parts: Spans, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each part, the same wherever it stands.

    Every place of a part has a random factor of its own (multilinear hashing),
    so no pattern of repetition makes different parts meet, as it would in sums
    over the powers of a base.  The parts' ends ascend; parts may overlap.
    """
    out = np.empty(len(parts.start), dtype=U64)
    table = _tables(seed)
    if lower:
        table = table[_LOWER]
    size = parts.end - parts.start
    i = 0
    while i < len(out):
        base = int(parts.start[i])
        j = int(np.searchsorted(parts.end, base + BLOCK, side="right"))
        j = max(j, i + 1)
        n = size[i:j]
        ends = np.cumsum(n)
        starts = ends - n
        at = np.arange(int(ends[-1])) - np.repeat(starts, n)
        factors = _places(int(n.max(initial=0)), seed)
        terms = table[b.data[at + np.repeat(parts.start[i:j], n)]] * factors[at]
        total = np.zeros(len(terms) + 1, dtype=U64)
        np.cumsum(terms, out=total[1:])
        out[i:j] = mix(total[ends] - total[starts] + n.astype(U64))
        i = j
    return out


def grams(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of k following parts for each first part; len(h) - k + 1 of them.

    Grams that reach over a text's end are meaningless; see ``inside``.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    mixed = mix(h + U64(salt))
    factors = _places(k, salt + 1000)
    total = np.zeros(n, dtype=U64)
    for j in range(k):
        total += mixed[j : j + n] * factors[j]
    return mix(total)


def counts(parts: Spans) -> np.ndarray:
    """Number of parts of each text."""
    return np.diff(parts.first)


def owners(parts: Spans) -> np.ndarray:
    """The text of each part."""
    return np.repeat(np.arange(len(parts.first) - 1), counts(parts))


def inside(parts: Spans, k: int) -> np.ndarray:
    """For each gram of k parts: whether it ends in the text in which it starts."""
    own = owners(parts)
    n = len(own) - k + 1
    return own[:n] == own[k - 1 :] if n > 0 else np.zeros(0, dtype=bool)
