"""Arrow batches of texts as numpy arrays: word hashes, shingles and code points, all vectorised and in bounded pieces.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of non-ASCII characters; everything else separates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PIECE = 1 << 18
_U = np.uint64
MULTIPLIER = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(MULTIPLIER), -1, 1 << 64))

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True

_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(name: str, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        step = np.full(max(n, PIECE + 1), MULTIPLIER if name == "up" else _INVERSE, dtype=np.uint64)
        step[0] = 1
        _powers[name] = np.multiply.accumulate(step)
    return _powers[name][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def small_batches(df: DataFrame) -> DataFrame:
    """Keep the Arrow batches that Python tasks receive small, whatever the length of the rows."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return df


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans_of_rows(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``most`` bytes together; a longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _word_piece(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start positions, hashes) of the words of a piece; a word also ends where a text ends."""
    word = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[1:-1] = word[1:] != word[:-1]
    edge[0] = edge[-1] = True
    edge[breaks] = True
    at = np.flatnonzero(edge)
    at = at[at < len(data)]
    ends = np.append(at[1:], len(data))
    keep = word[at]
    starts, ends = at[keep], ends[keep]
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((_LOW[data].astype(np.uint64) + _U(1)) * _power("up", len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power("down", len(data))[starts]
    return starts, mix(h + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of the texts, in order.  Works through pieces that end between words."""
    found_at, found_h, start, n = [], [], 0, len(data)
    while start < n:
        stop = min(start + PIECE, n)
        while stop < n and _IS_WORD[data[stop]] and _IS_WORD[data[stop - 1]]:
            near = np.flatnonzero(~_IS_WORD[data[stop : stop + PIECE]])
            stop = stop + (int(near[0]) if len(near) else min(PIECE, n - stop))
        inside = offsets[(offsets > start) & (offsets < stop)] - start
        at, h = _word_piece(data[start:stop], inside)
        found_at.append(at + start)
        found_h.append(h)
        start = stop
    if not found_at:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.concatenate(found_at)
    return np.searchsorted(offsets, at, side="right") - 1, np.concatenate(found_h)


def shingles(row: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of k words within a text; a text of fewer words, but not none, is one shorter run."""
    n = len(h)
    if n == 0:
        return row, h
    factors = mix(np.arange(1, k + 1, dtype=np.uint64)) | _U(1)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    sizes = np.diff(np.append(first, n))
    total = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        total += h[j : n - k + 1 + j] * factors[j] if n >= k else total
    whole = row[: n - k + 1] == row[k - 1 :] if n >= k else np.zeros(0, dtype=bool)
    rows, out = row[: max(n - k + 1, 0)][whole], mix(total[whole])
    short = sizes < k
    if short.any():
        s, size = first[short], sizes[short]
        part = np.zeros(len(s), dtype=np.uint64)
        for j in range(k - 1):
            on = size > j
            part[on] += h[s[on] + j] * factors[j]
        rows, out = np.concatenate([rows, row[s]]), np.concatenate([out, mix(part + size.astype(np.uint64))])
        order = np.argsort(rows, kind="stable")
        rows, out = rows[order], out[order]
    return rows, out


def distinct_per_row(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted by row and hash."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, dtype=bool)
    return row[new], h[new]
