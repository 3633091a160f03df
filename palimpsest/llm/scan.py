"""Numpy primitives on batches of texts: bytes, words, rolling hashes, window minima.

All work on a whole block of texts at once; a word or window never crosses from one text to the next.
Hashes are polynomials over 64-bit values modulo 2**64 with an odd base, so that the hash of any stretch comes from two
prefix sums; `mix` then spreads the bits. Two bases give independent hashes. Such a polynomial has collisions of stretches
of 1,024 bytes or more whatever its base, so words of over `LONG` bytes are hashed by XXH64 instead; the windows and
runs that the passage operators hash are shorter than that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Bytes beyond which a word isn't hashed by a polynomial.
LONG = 256
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            for name, value in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, value, U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


@cache
def powers(which: int) -> _Powers:
    return _Powers(_BASES[which])


@cache
def byte_values(which: int) -> np.ndarray:
    """A fixed odd 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=U) * U(_BASES[which])) | U(1)


class Rolling:
    """Hash of any stretch of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        up, self.down = powers(which)(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, U)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def windows(self, n: int) -> np.ndarray:
        """Of every window of n symbols, by its start."""
        count = len(self.sums) - n
        if count <= 0:
            return np.zeros(0, U)
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[:count])


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and each text's bounds; a null text has none."""
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(texts: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, bounds) for runs of texts of about `limit` bytes, one text at least."""
    data, bounds = utf8(texts)
    n, row = len(bounds) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        yield row, end, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


@cache
def class_table(letters: bytes, inside: bool) -> np.ndarray:
    """True for the bytes that belong to words: those in `letters`, or those not in it."""
    table = np.full(256, not inside)
    table[list(letters)] = inside
    return table


@cache
def lower_table() -> np.ndarray:
    """Lower case for A-Z, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


class Words:
    """Words of a block: byte starts and ends, and for each text the bounds of its words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, table: np.ndarray):
        self.data, self.text_bounds = data, bounds
        inside = table[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        before = np.zeros(len(data), bool)
        after = np.zeros(len(data), bool)
        if len(data):
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & ~(before & ~edge[:-1]))
        self.ends = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
        self.bounds = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, which: int = 0, data: np.ndarray | None = None) -> np.ndarray:
        data = self.data if data is None else data
        h = Rolling(byte_values(which)[data], which).of(self.starts, self.ends)
        for i in np.flatnonzero(self.ends - self.starts > LONG).tolist():
            h[i] = xxhash.xxh64_intdigest(data[self.starts[i] : self.ends[i]].tobytes(), which)
        return h

    def owner(self) -> np.ndarray:
        """For each word, its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def within(self, n: int) -> np.ndarray:
        """True where a window of n words starts that ends in the same text."""
        if len(self) < n:
            return np.zeros(0, bool)
        own = self.owner()
        return own[: len(own) - n + 1] == own[n - 1 :]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values in each stretch between bounds."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def slide_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` values (van Herk and Gil-Werman)."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, U(2**64 - 1), U)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Anchors:
    """Winnowed phrases of a block of sequences: every window of n symbols belongs to one phrase.

    A window's phrase is its k-gram of least hash, the leftmost of equals. That depends on the window's content alone, so
    equal windows have equal phrases at equal distance. A run is a maximal stretch of windows with one phrase occurrence:
    `phrase` (hash), `at` (its position), `first` and `last` (window starts), `owner` (its sequence).
    """

    def __init__(self, roll: Rolling, bounds: np.ndarray, n: int, k: int):
        length = len(roll.sums) - 1
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        starts = np.flatnonzero(owner[: length - n + 1] == owner[n - 1 :]) if length >= n else np.zeros(0, np.int64)
        if not len(starts):
            self.phrase, self.at = np.zeros(0, U), starts
            self.first = self.last = self.owner = starts
            return
        h = roll.windows(k)
        bits = U(max(21, int(length).bit_length()))
        least = slide_min((h >> bits << bits) | np.arange(len(h), dtype=U), n - k + 1)[starts]
        at = (least & ((U(1) << bits) - U(1))).astype(np.int64)
        turns = np.flatnonzero((np.diff(at) != 0) | (np.diff(starts) != 1)) + 1
        self.first = starts[np.r_[0, turns]]
        self.last = starts[np.r_[turns, len(starts)] - 1]
        self.at = at[np.r_[0, turns]]
        self.phrase = h[self.at]
        self.owner = owner[self.first]

    def __len__(self) -> int:
        return len(self.at)

    def keep(self, mask: np.ndarray) -> "Anchors":
        out = object.__new__(Anchors)
        for name in ("phrase", "at", "first", "last", "owner"):
            setattr(out, name, getattr(self, name)[mask])
        return out


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers from each first to its last, and for each the pair it comes from."""
    n = last - first + 1
    pair = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[pair], pair


def covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """True for the places within n of a start."""
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + n, length), -1)
    return np.cumsum(change)[:-1] > 0


def join_words(words: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text joined by one space: bytes, and each text's bounds."""
    mask = np.zeros(len(words.data) + 1, np.int8)
    starts, ends = words.starts[kept], words.ends[kept]
    mask[starts] += 1
    np.add.at(mask, ends, -1)
    mask = np.cumsum(mask[:-1], dtype=np.int8) > 0 if len(words.data) else np.zeros(0, bool)
    out = words.data.copy()
    owner = words.owner()[kept]
    # A word but the first that its text keeps has a byte before it that is no part of a word.
    gaps = starts[1:][owner[1:] == owner[:-1]] - 1
    mask[gaps] = True
    out[gaps] = 32
    place = np.r_[0, np.cumsum(mask)]
    return out[mask], place[words.text_bounds]


def string_array(data: np.ndarray, bounds: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow array of the stretches of data between bounds."""
    kind = kind or pa.string()
    return pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def as_list(values: pa.Array, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of True."""
    edge = np.diff(np.r_[np.int8(0), mask.view(np.int8), np.int8(0)])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
