"""Words and hashes of many texts at once, on the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import ship

ship(__name__)
#: Bytes of text that are worked on at once; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20

_rng = np.random.default_rng(20250117)
BYTE_CODES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Whitespace of `[^\x20\x09-\x0D]+`; for words of letters and digits, all of ASCII but those is a gap.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[128:] = NON_ALNUM[48:58] = NON_ALNUM[97:123] = NON_ALNUM[65:91] = False


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def byte_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first row, end row, the rows' bytes, offsets of the rows in them (one more than rows); a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words_of(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end (in bytes) of the words of all rows, and the place of each row's first word (one more than rows)."""
    word = ~gaps[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    if len(data):
        edge[0], edge[-1] = word[0], word[-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    extra = np.unique(cut[word[cut] & word[cut - 1]])  # a row ends in a word and the next begins with one
    places = np.flatnonzero(edge)
    starts, ends = places[::2], places[1::2]
    if len(extra):
        starts, ends = np.sort(np.concatenate([starts, extra])), np.sort(np.concatenate([ends, extra]))
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int | None = None, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lower-cased if `fold`; with `most`, of its first bytes only."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts if most is None else np.minimum(ends - starts, most)
    heads = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=heads[1:])
    inside = np.arange(heads[-1]) - np.repeat(heads[:-1], lengths)
    powers = np.full(int(lengths.max()), _POWER, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    letters = data[np.repeat(starts, lengths) + inside]
    values = BYTE_CODES[LOWER[letters] if fold else letters] * powers[inside]
    return mix64(np.add.reduceat(values, heads[:-1]) + lengths.astype(np.uint64))
