"""Bytes, words and rolling fingerprints of Arrow text columns, vectorised with numpy.

All functions work on blocks: runs of whole documents of about `BLOCK_BYTES` bytes, so that the arrays of a block stay in
the cache and in a small part of a worker's memory. A longer document is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z only
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, one after another, and the bounds of the rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of each block."""
    at, n = 0, len(bounds) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK_BYTES, "right")) - 1)
        yield at, end, data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


class Rolling:
    """Fingerprints of any byte range of a block, from running sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        powers, self.inverse = _grown_powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        """Fingerprint of the `size` bytes that start at each position that has so many."""
        n = max(0, len(self.sums) - size)
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n] + np.uint64(size))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the block, start byte, end byte) of each word; words never cross rows."""
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return np.searchsorted(bounds, starts, "right") - 1, starts, np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`words` with A-Z in lower case, and the fingerprint of each word."""
    row, start, end = words(data, bounds)
    return row, start, end, Rolling(LOWER[data]).of(start, end)


def gram_hashes(row: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, fingerprint) of each run of `size` words of one row."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += word[k : k + n] * _GRAM[k]
    whole = np.flatnonzero(row[:n] == row[size - 1 :])
    return whole, mix(total[whole] + np.uint64(size))


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint), sorted and distinct, of the runs of `size` words; a row with fewer words has its whole sequence as one."""
    row, _, _, word = word_hashes(data, bounds)
    at, gram = gram_hashes(row, word, size)
    owner = row[at]
    counts = np.bincount(row, minlength=len(bounds) - 1)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        ends = np.cumsum(counts)
        pieces = [np.sum(word[ends[r] - counts[r] : ends[r]] * _GRAM[: counts[r]], dtype=np.uint64) + np.uint64(counts[r]) for r in short]
        owner = np.concatenate([owner, short])
        gram = np.concatenate([gram, mix(np.array(pieces, np.uint64))])
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    keep = np.ones(len(gram), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
    return owner[keep], gram[keep]


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` keys, by block prefixes and suffixes."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    rows = -(-len(keys) // width)
    padded = np.full(rows * width, np.iinfo(keys.dtype).max, keys.dtype)
    padded[: len(keys)] = keys
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
