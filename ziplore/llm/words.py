"""Words of many texts at once, as 64-bit hashes, in numpy.

Works on the bytes of an Arrow string column: words are runs of bytes that are
not white space (0x20 and 0x09 to 0x0D), which is the same in UTF-8 as in code
points. A word's hash is a sum over its bytes times powers by their place,
mixed; two words are taken as equal if their hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_SEPARATES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.full(65536, 0x9E3779B97F4A7C15, np.uint64)
_POWERS[0] = 1
_POWERS = np.cumprod(_POWERS)
#: Bytes of text whose words are hashed at a time, and so many that the arrays stay in a core's cache.
CHUNK = 1 << 20
SMALL_CHUNK = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all places."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, a number for each word's last two bytes, and where each text's words end."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    if not len(data):
        return none
    gap = _SEPARATES[data]
    starts = ~gap
    after = gap[:-1].copy()
    after[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))] - 1] = True
    starts[1:] &= after
    starts = np.flatnonzero(starts)
    if not len(starts):
        return none
    place = np.arange(starts[0], len(data))
    place -= np.repeat(starts, np.diff(np.r_[starts, len(data)]))
    # Each byte times a power by its place in the word; gaps count nothing.
    value = (data[starts[0] :].astype(np.uint64) + _U(1)) * _POWERS[place & 65535]
    value[gap[starts[0] :]] = 0
    ends = np.searchsorted(starts, offsets[1:], "left")
    # A word ends before the next gap or at the end of its text.
    stops = np.flatnonzero(~gap & np.r_[gap[1:], True] | _lasts(offsets, len(data)) & ~gap)
    before = np.where(stops > starts, data[stops - 1], 0).astype(np.uint64)
    return mixed(np.add.reduceat(value, starts - starts[0])), before * _U(256) + data[stops], ends


def _lasts(offsets: np.ndarray, n: int) -> np.ndarray:
    """Marks the last byte of every text."""
    mark = np.zeros(n, bool)
    inner = offsets[1:]
    mark[inner[inner > 0] - 1] = True
    return mark


def hashed_texts(column: pa.Array, lower: bool = False, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``hashed`` for a string column, some texts at a time; a null text has no words.

    ``lower`` takes A-Z as a-z; ``chunk`` is the bytes of text at a time.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk, "right")) - 1)
        part = data[offsets[row] : offsets[last]]
        yield hashed(_LOWER[part] if lower else part, offsets[row : last + 1] - offsets[row])
        row = last


def bags(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    for words, _, ends in hashed_texts(column, chunk=SMALL_CHUNK):
        begin = 0
        for end in ends:
            yield words[begin:end]
            begin = end
