"""Burrows-Wheeler transform and common prefixes of a collection, built column by column.

Each sequence is bytes, one marker, bytes: left, MARK, right. In every round each sequence that has come so far inserts
one symbol, from its end to its start; the transform and the common prefixes of neighbouring suffixes are read from two
files one after the other and written to two new ones. Sequences are aligned at the marker, so that all markers are
inserted in one round; markers are ordered by the group of their sequence, so those of different groups differ.

An entry of the transform is the symbol before a suffix. WAIT stands before suffixes of sequences that haven't come or
have ended. All other entries, in order of (symbol, place), are the suffixes that start with that symbol, in order: so
the place of a new suffix is the rank of its entry, and its common prefix with the suffix before is one more than the
least common prefix between their entries.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: UTF-8 has neither of these bytes.
WAIT, MARK = 0xFE, 0xFF


class Collection:
    """The transform of sequences left[i] + MARK + right[i]; `groups` are whole numbers."""

    def __init__(self, left: list[bytes], right: list[bytes], groups: np.ndarray):
        self.n = len(left)
        self.groups = np.asarray(groups)
        self.left_size = np.fromiter(map(len, left), np.int64, self.n)
        self.right_size = np.fromiter(map(len, right), np.int64, self.n)
        longest = int((self.left_size + self.right_size).max()) + 2 if self.n else 1
        self.kind = np.uint8 if longest < 256 else np.uint16 if longest < 65536 else np.uint32
        self.left, self.right = _grid([x[::-1] for x in left], self.left_size), _grid([x[::-1] for x in right], self.right_size)
        with tempfile.TemporaryDirectory() as folder:
            self.folder, self.turn = folder, 0
            self._build()

    def _write(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        """Over the older of the two generations of files, which only grow."""
        self.turn ^= 1
        for name, values in (("bwt", bwt), ("lcp", lcp)):
            path = f"{self.folder}/{name}{self.turn}"
            with open(path, "r+b" if os.path.exists(path) else "wb", buffering=0) as f:
                f.write(memoryview(values).cast("B"))

    def _read(self) -> tuple[np.ndarray, np.ndarray]:
        return np.fromfile(f"{self.folder}/bwt{self.turn}", np.uint8), np.fromfile(f"{self.folder}/lcp{self.turn}", self.kind)

    def _symbol(self, step: int, rows: np.ndarray) -> np.ndarray:
        """What each of rows inserts in round `step`; the marker comes in round `most`."""
        most = self.right.shape[1]
        if step < most:
            return self.right[rows, step - (most - self.right_size[rows])]
        if step == most:
            return np.full(len(rows), MARK, np.uint8)
        out = np.full(len(rows), WAIT, np.uint8)
        some = self.left_size[rows] > step - most - 1
        out[some] = self.left[rows[some], step - most - 1]
        return out

    def _build(self) -> None:
        most, n = self.right.shape[1], self.n
        # The empty suffixes come first, in order of the sequences; each waits until its sequence comes.
        bwt, lcp = np.full(n, WAIT, np.uint8), np.zeros(n, self.kind)
        self._write(bwt, lcp)
        rows = np.zeros(0, np.int64)  # sequences that have come, and the place of their last suffix
        places = np.zeros(0, np.int64)
        arrive = most - self.right_size
        for step in range(most + self.left.shape[1] + 1):
            bwt, lcp = self._read()
            new = np.flatnonzero(arrive == step)
            rows, places = np.r_[rows, new], np.r_[places, new]
            symbols = self._symbol(step, rows)
            bwt[places] = symbols
            going = symbols != WAIT
            rows, places = rows[going], places[going]
            order = np.argsort(places, kind="stable")
            rows, places = rows[order], places[order]
            if step == most:
                places, rows, values, after, after_values = self._markers(bwt, lcp, rows, places)
            else:
                places, rows, values, after, after_values = self._bytes(bwt, lcp, rows, places)
            # after: old suffixes right behind a new one, whose common prefix with what is before them has changed.
            lcp[after] = after_values
            total = len(bwt) + len(places)
            old = np.ones(total, bool)
            old[places] = False
            next_bwt, next_lcp = np.empty(total, np.uint8), np.empty(total, self.kind)
            next_bwt[old], next_lcp[old] = bwt, lcp
            next_bwt[places], next_lcp[places] = WAIT, values
            self._write(next_bwt, next_lcp)
        bwt, self.lcp = self._read()
        self._walk(bwt)

    def _bytes(self, bwt, lcp, rows, places):
        order = _by_symbol(bwt)
        fresh = np.zeros(len(bwt), bool)
        fresh[places] = True
        ranks = np.flatnonzero(fresh[order])
        # Each fresh entry, and the entry after it: common prefix with the entry before in the order of suffixes.
        follow = ranks + 1
        follow = follow[(follow < len(order)) & ~fresh[order[np.minimum(follow, len(order) - 1)]]]
        values = _one_more(bwt, lcp, order, ranks)
        at = order[ranks]
        by_place = np.argsort(at)
        owner = np.empty(len(at), np.int64)
        owner[by_place] = rows  # rows are sorted by place
        # Old suffixes keep their order; one's index among the old is its rank less the fresh ones before it.
        old_index = self.n + follow - np.searchsorted(ranks, follow)
        return self.n + ranks, owner, values, old_index, _one_more(bwt, lcp, order, follow)

    def _markers(self, bwt, lcp, rows, places):
        """All markers at once: by group, then by place; they come after every other suffix."""
        order = np.lexsort((places, self.groups[rows]))
        rows, places = rows[order], places[order]
        same = np.r_[False, self.groups[rows][1:] == self.groups[rows][:-1]]
        values = np.zeros(len(rows), self.kind)
        at = np.flatnonzero(same)
        values[at] = 1 + _range_min(lcp, places[at - 1] + 1, places[at])
        start = len(bwt)
        self.mark_order = rows
        none = np.zeros(0, np.int64)
        return start + np.arange(len(rows)), rows, values, none, none.astype(self.kind)

    def _walk(self, bwt: np.ndarray) -> None:
        """Place of every suffix that starts left of the marker or at it: (sequence, bytes left of the marker, place)."""
        order = _by_symbol(bwt)
        to = np.zeros(len(bwt), np.int64)
        to[order] = self.n + np.arange(len(order))
        rows, places = self.mark_order, len(bwt) - self.n + np.arange(self.n)
        out, offset = [], 0
        while len(rows):
            out.append((rows, np.full(len(rows), offset), places))
            going = bwt[places] != WAIT
            rows, places = rows[going], to[places[going]]
            offset += 1
        self.sequence, self.offset, self.place = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def repeated(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, bytes left of the marker) of suffixes that share `length` symbols with another suffix."""
        near = np.r_[self.lcp, self.kind(0)]
        long = np.maximum(near[self.place], near[self.place + 1]) >= length
        return self.sequence[long], self.offset[long]


def _by_symbol(bwt: np.ndarray) -> np.ndarray:
    """Entries that stand for a suffix, by (symbol, place); the marker is above all bytes, WAIT stands for none."""
    key = np.where(bwt == MARK, np.uint8(WAIT), np.where(bwt == WAIT, np.uint8(MARK), bwt))
    return np.argsort(key, kind="stable")[: len(bwt) - np.count_nonzero(bwt == WAIT)]


def _grid(parts: list[bytes], sizes: np.ndarray) -> np.ndarray:
    width = int(sizes.max()) if len(sizes) else 0
    out = np.full((len(parts), max(width, 1)), WAIT, np.uint8)
    flat = np.frombuffer(b"".join(parts), np.uint8)
    row = np.repeat(np.arange(len(parts)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out[:, :width]


def _one_more(bwt: np.ndarray, lcp: np.ndarray, order: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes at `ranks` with those one rank before: 0 if the symbols differ."""
    out = np.zeros(len(ranks), lcp.dtype)
    here = order[ranks]
    before = order[np.maximum(ranks - 1, 0)]
    same = np.flatnonzero((ranks > 0) & (bwt[here] == bwt[before]))
    if len(same):
        by_place = same[np.argsort(here[same])]
        a, b = before[by_place] + 1, here[by_place] + 1
        pairs = np.stack([a, b], axis=1).ravel()
        closed = np.r_[lcp, lcp.dtype.type(0)]
        out[by_place] = 1 + np.minimum.reduceat(closed, pairs)[::2]
    return out


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of values[first..last] for each pair, by tables of doubling width."""
    out = np.zeros(len(first), values.dtype)
    width = (last - first + 1).astype(np.int64)
    level = np.floor(np.log2(np.maximum(width, 1))).astype(int)
    table, size = values, 1
    for depth in range(int(level.max()) + 1 if len(level) else 0):
        mine = np.flatnonzero(level == depth)
        out[mine] = np.minimum(table[first[mine]], table[last[mine] - size + 1])
        if 2 * size <= len(values):
            table = np.minimum(table[:-size], table[size:])
            size *= 2
    return out
