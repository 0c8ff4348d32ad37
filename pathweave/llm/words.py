"""Words of whole texts as arrays: byte-level, vectorised over Arrow batches inside Spark tasks.

A word is a maximal run of bytes other than space and \\x09-\\x0D. All separators are ASCII, so words of UTF-8 bytes are
words of code points. Hashes are 64 bits wide; equal words have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHUNK = 1 << 20
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _CHUNK + 4096)
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


class Words:
    """Words of consecutive texts. ``bounds[i]:bounds[i + 1]`` are the words of text i; starts and ends are byte offsets in ``data``,
    as are ``offsets``, where the texts begin and the last one ends."""

    __slots__ = ("data", "offsets", "starts", "ends", "bounds")

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.offsets = offsets
        separator = _SEPARATOR[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = True
            before[1:] = separator[:-1]
            after = np.empty(len(data), bool)
            after[-1] = True
            after[:-1] = separator[1:]
            self.starts = np.flatnonzero(~separator & (before | edge[:-1]))
            self.ends = np.flatnonzero(~separator & (after | edge[1:])) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """One 64-bit hash a word; ``lower`` maps A-Z to a-z first."""
        return span_hashes(self.data, self.starts, self.ends, lower)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans stand in order and apart. Works in blocks of about a megabyte, whatever their length."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _CHUNK)))
        base, end = int(starts[at]), int(ends[to - 1])
        block = data[base:end]
        power, inverse = _power_tables(end - base + 1)
        total = np.zeros(end - base + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[block] if lower else block] * power[: end - base], out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return out


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words, without regard to text bounds."""
    count = max(0, len(words) - n + 1)
    total = np.full(count, _ODD[n % len(_ODD)], np.uint64)
    for j in range(n):
        total += words[j : j + count] * _ODD[j]
    return mix(total)


def whole(words: np.ndarray) -> np.uint64:
    """Hash of one whole word sequence of any length; equals ``grams`` of that length."""
    n = len(words)
    weights = _ODD[np.arange(n) % len(_ODD)]
    return mix((words * weights).sum(dtype=np.uint64, keepdims=True) + _ODD[n % len(_ODD)])[0]


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct ``n``-word shingles of one text; the whole sequence as one where it is shorter; empty without words."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([whole(words)], np.uint64)
    return np.unique(grams(words, n))


def texts(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """Cut a column of strings into runs of about a megabyte: (first row, row after the last, words). Nulls have no words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, side="right")) - 1)
        to = min(to, n)
        yield at, to, Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
