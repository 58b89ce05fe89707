"""Word hashes of whole Arrow batches with numpy: no Python string is made per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 2**62, size=2, dtype=np.uint64) * np.uint64(4) + np.uint64(3)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_groups(at: np.ndarray, piece: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``piece`` bytes; a longer row is a run of its own."""
    first = 0
    while first < len(at) - 1:
        last = int(np.searchsorted(at, at[first] + piece, "right")) - 1
        last = min(max(last, first + 1), len(at) - 1)
        yield first, last
        first = last


def _hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    length = ends - starts
    inner = np.arange(int(length.sum()), dtype=np.int64)
    base = np.repeat(np.cumsum(length) - length, length)
    place = inner - base
    byte = raw[np.repeat(starts, length) + place]
    power = powers(_STEP[which], int(length.max()) if len(length) else 1)
    terms = _BYTE[which][byte] * power[place]
    return mix(np.add.reduceat(terms, np.cumsum(length) - length) + length.astype(np.uint64))


def words(raw: np.ndarray, at: np.ndarray, hashes: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of the words ``[^\\x20\\x09-\\x0D]+`` in all rows: byte starts, byte ends,
    first word of each row (one more entry at the end), and 64-bit hashes."""
    solid = ~SPACE[raw]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edges = at[:-1][at[:-1] < len(raw)]
    begin[edges] |= solid[edges]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    inner = at[1:-1]
    inner = inner[inner > 0] - 1
    stop[inner] |= solid[inner]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    rows = np.searchsorted(starts, at)
    out = []
    for which in range(hashes):
        h = np.empty(len(starts), np.uint64)
        first = 0
        while first < len(starts):
            last = max(int(np.searchsorted(ends, starts[first] + PIECE, "right")), first + 1)
            h[first:last] = _hash(raw, starts[first:last], ends[first:last], which)
            first = last
        out.append(h)
    return starts, ends, rows, out


_WINDOW = _rng.integers(1, 2**62, size=2, dtype=np.uint64) * np.uint64(8) + np.uint64(5)


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class Rolling:
    """Hashes of any run of consecutive words, from prefix sums modulo 2^64."""

    def __init__(self, h: np.ndarray, which: int = 0):
        self.base = _WINDOW[which]
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(self.base, len(h)), out=self.sums[1:])
        self.back = powers(inverse(self.base), len(h) + 1)

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of words ``first .. last - 1``; equal runs hash alike wherever they stand."""
        return mix((self.sums[last] - self.sums[first]) * self.back[first] + (last - first).astype(np.uint64))
