"""Vectorised text primitives on Arrow string buffers.

Everything works on one *chunk*: the concatenated UTF-8 bytes of some rows and the
``n + 1`` byte offsets of those rows.  Hashes are polynomials modulo 2**64 with an odd
base, so the hash of any stretch comes from two prefix sums; a finaliser spreads bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD6E8FEB86659FD93 | 1
_M64 = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The same separators, for SQL and regular expressions.
SPACE_CLASS = r"[ \t\n\r\f\x0B]+"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        size += size // 4
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        have = _POWERS[base] = (both[0], both[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place on a fresh array)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    if len(values):
        np.cumsum(values * _powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


class Stretch:
    """Hashes of stretches of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int = _WORD_BASE):
        self._base = base
        self._prefix = _prefix(values, base)
        _powers(base, len(values) + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = _powers(self._base, len(self._prefix))[1]
        return mix((self._prefix[end] - self._prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of an Arrow string column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
        if not pa.types.is_string(column.type):
            column = column.cast(pa.string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about ``limit`` bytes; one long row is one run."""
    data, offs = string_buffers(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """The words of a chunk: byte starts and ends, hashes, and word bounds of each row."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False, separators: np.ndarray = SPACE):
        if lower:
            data = LOWER[data]
        self.data = data
        inside = ~separators[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        n = len(data)
        if n:
            cut = offs[(offs > 0) & (offs < n)]
            begins[cut] = inside[cut]
            ends[cut - 1] = inside[cut - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.start, offs)
        self.row = np.repeat(np.arange(len(offs) - 1), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        return Stretch(self.data.astype(np.uint64) + np.uint64(1), _BYTE_BASE).hash(self.start, self.end)


def sliding(values: np.ndarray, width: int, low: bool) -> np.ndarray:
    """Minimum (``low``) or maximum of every run of ``width`` values, by doubling."""
    pick = np.minimum if low else np.maximum
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``start .. start + length - 1`` of every pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    steps = np.ones(total, np.int64)
    at = np.cumsum(lengths)[:-1]
    steps[0] = starts[0]
    steps[at] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(steps)
