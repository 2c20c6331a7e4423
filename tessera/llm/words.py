"""Vectorised words, word hashes and window hashes over Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which for UTF-8 is the regular expression [^\\x20\\x09-\\x0D]+.
Texts are handled in slices of about SLICE bytes, so memory follows the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_B, _B_INV = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 2**64))
_W, _W_INV = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; one slice's worth is kept."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 2 * SLICE:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that near values end far apart."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Slice:
    """Some whole texts: their bytes, and the byte range and text number of each word."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~separators[data]
        starts = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        borders = offsets[1:-1][np.diff(offsets[1:]) > 0] if len(offsets) > 2 else offsets[:0]
        borders = borders[(borders > 0) & (borders < len(data))]
        starts[borders] |= inside[1:-1][borders]
        ends[borders - 1] |= inside[1:-1][borders - 1]
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        #: word k of text t: bounds[t] + k
        self.bounds = np.searchsorted(self.starts, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))

    def hashes(self, fold: np.ndarray | None = None, first: int | None = None) -> np.ndarray:
        """64 bits for each word, or for its first bytes, after the byte mapping fold."""
        n, ends = len(self.data), self.ends if first is None else np.minimum(self.ends, self.starts + first)
        values = _BYTE if fold is None else _BYTE[fold]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values[self.data] * _power(_B, n), out=total[1:])
        at = _power(_B_INV, n + 1)[self.starts]
        return mix((total[ends] - total[self.starts]) * at + (ends - self.starts).astype(np.uint64))

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of all windows of k words inside one text, and 64 bits for each window."""
        n = len(hashes)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _power(_W, n), out=total[1:])
        first = np.flatnonzero(self.text[: n - k + 1] == self.text[k - 1 :])
        return first, mix((total[first + k] - total[first]) * _power(_W_INV, n)[first])


def plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def slices(column: pa.Array, separators: np.ndarray = _SPACE) -> Iterator[Slice]:
    """The column in slices of whole texts, each of SLICE bytes or one longer text."""
    offsets, data = plain(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield Slice(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], separators)
        at = to
