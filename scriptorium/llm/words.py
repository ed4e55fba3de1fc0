"""Words of a batch of texts, as positions and 64-bit hashes, without a Python loop over words.

A word is a run of bytes other than space and the five ASCII control characters from tab to carriage return; A-Z count
as a-z. Used inside mapInArrow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are hashed at a time; one longer text is a chunk of its own.
CHUNK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = [np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _factors(n: int) -> np.ndarray:
    """A factor for each place in a word. Powers of one number won't do: under them long words of two letters, made as the Thue-Morse sequence is, are all equal."""
    if len(_FACTORS[0]) < n:
        _FACTORS[0] = mix(np.arange(1, max(n, 256) + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    return _FACTORS[0]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - (offsets[0] if len(offsets) else 0)


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many bytes."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) and hashes of the words, and for each row the place of its first word, with one more."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~SPACES[data]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ~solid[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    first[cuts] = True
    first &= solid
    starts = np.flatnonzero(first)
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = ~solid[1:]
    last[cuts[cuts > 0] - 1] = True
    ends = np.flatnonzero(last & solid) + 1
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    lengths = ends - starts
    place = np.arange(starts[0], n, dtype=np.int64) - np.repeat(starts, np.diff(np.append(starts, n)))
    solid = solid[starts[0] :]
    place[~solid] = 0
    part = (LOWER[data[starts[0] :]].astype(np.uint64) + np.uint64(1)) * _factors(int(lengths.max()) + 1)[place]
    part *= solid
    hashes = mix(np.add.reduceat(part, starts - starts[0]) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def shingled(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By chunks of rows: first row, shingles() of all its rows one after the other, in text order, and how many each row has."""
    data, offsets = texts(column)
    for lo, hi in chunks(offsets):
        _, _, hashes, at = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        n = np.diff(at)
        counts = np.where(n >= k, n - k + 1, n > 0)
        starts = np.cumsum(counts) - counts
        first = np.repeat(at[:-1] - starts, counts) + np.arange(counts.sum())
        out = np.full(len(first), np.uint64(k))
        for i in range(k):
            out = (out + hashes[np.minimum(first + i, max(len(hashes) - 1, 0))]) * np.uint64(0xC2B2AE3D27D4EB4F)
            out ^= out >> np.uint64(29)
        out = mix(out)
        for r in np.flatnonzero((n > 0) & (n < k)):
            out[starts[r]] = shingles(hashes[at[r] : at[r + 1]], k)[0]
        yield lo, out, counts


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of one text; of all its words if there are fewer than k; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(n, k)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out = (out + hashes[i : n - k + 1 + i]) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
    return mix(out)
