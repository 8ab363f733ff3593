"""Vectorised word hashing over Arrow string columns.

Words are runs of bytes other than space and 0x09-0x0D. A word's hash takes in eight bytes at a time, each through a
bijective mixer, so different words of at most eight bytes and equal length never meet. A run of words is hashed from
halves, again through the mixer. Nothing is linear in the bytes, so no text can be built of repeated patterns (such as
the Thue-Morse words) that all hash alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
CHUNK_BYTES = 1 << 19
#: Longer words are hashed one by one.
LONG_WORD = 64
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    h = h ^ U((salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xA0761D6478BD642F)
    return h ^ (h >> U(32))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two parts in their order; one to one in either part when the other is fixed."""
    return mix((a ^ U(0x9E3779B97F4A7C15)) * U(0xC2B2AE3D27D4EB4F) + b, 9)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes; other salts give independent hashes."""
    size = end - start
    h = mix(size.astype(U), salt)
    blocks = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    todo = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at = 0
    while len(todo):
        left = np.minimum(size[todo] - at, 8)
        h[todo] = mix(h[todo] ^ (blocks[start[todo] + at] & _TAIL[left]), salt + 1)
        at += 8
        todo = todo[size[todo] > at]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed=salt)
    return h


@dataclass
class Words:
    """The words of rows ``first`` to ``first + len(bounds) - 2`` of a column; ``bounds`` cuts them by row."""

    first: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    def second(self) -> np.ndarray:
        """Another hash of the words, independent of ``hash``."""
        return hash_words(self.data, self.start, self.end, 77)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def windows(self, width: int, salt: int = 0, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of each run of ``width`` words inside one row."""
        n = len(self.hash)
        if n < width:
            return np.empty(0, np.int64), np.empty(0, U)
        row = self.row_of()
        at = np.flatnonzero(row[: n - width + 1] == row[width - 1 :])
        return at, run_hashes(self.hash if hashes is None else hashes, width, salt)[at]

    def whole(self, most: int, salt: int = 0) -> np.ndarray:
        """A hash of each row's whole sequence, right for rows of at most ``most`` words."""
        low, size = self.bounds[:-1], np.diff(self.bounds)
        h = mix(size.astype(U), salt)
        for k in range(most):
            rows = np.flatnonzero(size > k)
            h[rows] = join(h[rows], self.hash[low[rows] + k])
        return h


def run_hashes(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A hash of each ``width`` consecutive values, by doubling: hashes of 1, 2, 4, ... values, joined to ``width``."""
    level, size = mix(hashes, salt), 1
    out, done = None, 0
    while True:
        if width & size:
            out = level if out is None else join(out[: len(level) - done], level[done:])
            done += size
        if 2 * size > width:
            return out
        level, size = join(level[:-size], level[size:]), 2 * size


def _column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and row offsets; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) or pa.types.is_string_view(column.type) else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets


def words_of(column: pa.Array, lower: bool = False, drop: bytes = b"", chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of the column in chunks of about ``chunk_bytes``; a row is never cut.

    ``lower`` maps A-Z to a-z before hashing. ``drop`` lists ASCII bytes that count as spaces.
    """
    if not len(column):
        return
    data, offsets = _column_bytes(column)
    space = _SPACE.copy()
    space[list(drop)] = True
    cuts = [0]
    while cuts[-1] < len(column):
        nxt = int(np.searchsorted(offsets, offsets[cuts[-1]] + chunk_bytes, side="right")) - 1
        cuts.append(min(len(column), max(nxt, cuts[-1] + 1)))
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = data[offsets[a] : offsets[b]]
        row = offsets[a : b + 1] - offsets[a]
        n = len(part)
        part = _LOWER[part] if lower else part
        solid = ~space[part]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        inner = row[1:-1]
        before[inner[inner < n]] = False
        after[inner[(inner > 0)] - 1] = False
        start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        yield Words(a, part, start, end, hash_words(part, start, end), np.searchsorted(start, row, side="left"))
