"""Hashed text features from Arrow batches: words, punctuation and shapes as sparse indicators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from paperloom.llm import textbatch as tb

_U = np.uint64
BITS = 19
DIMS = 1 << BITS
BEGINNINGS = (4, 5, 6)

# Classes of bytes: 0 blank or control, 1 word (letter, digit, non-ASCII), 2 punctuation.
_CLASS = np.full(256, 2, dtype=np.uint8)
_CLASS[:33] = _CLASS[127] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1


def runs(data: np.ndarray, offsets: np.ndarray, beginnings: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(row, class, hash of the lower-cased bytes, shape) of every run of word or punctuation bytes.

    For each length in ``beginnings`` follows the hash of the first bytes of the run, or 0 where it is not longer.

    The shape tells a lower-case word from one that begins with, or consists of, capitals, and words with digits.
    Works through pieces that end between runs, so a long text needs bounded memory beyond its result.
    """
    found: list[tuple] = []
    start, n = 0, len(data)
    while start < n:
        stop = min(start + tb.PIECE, n)
        while stop < n and _CLASS[data[stop]] == _CLASS[data[stop - 1]]:
            near = np.flatnonzero(_CLASS[data[stop : stop + tb.PIECE]] != _CLASS[data[stop - 1]])
            stop += int(near[0]) if len(near) else min(tb.PIECE, n - stop)
        piece = data[start:stop]
        kind = _CLASS[piece]
        edge = np.zeros(len(piece) + 1, dtype=bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[0] = edge[-1] = True
        edge[offsets[(offsets > start) & (offsets < stop)] - start] = True
        at = np.flatnonzero(edge)[:-1]
        ends = np.append(at[1:], len(piece))
        keep = kind[at] > 0
        at, ends = at[keep], ends[keep]
        size = ends - at
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum((_LOW[piece].astype(np.uint64) + _U(1)) * tb._power("up", len(piece)), out=sums[1:])
        h = tb.mix((sums[ends] - sums[at]) * tb._power("down", len(piece))[at] + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        capitals = np.append(0, np.cumsum(_UPPER[piece]))
        digits = np.append(0, np.cumsum(_DIGIT[piece]))
        upper = capitals[ends] - capitals[at]
        shape = (upper > 0) + 2 * ((upper == size) & (size > 1)) + 4 * (digits[ends] > digits[at]) + 8 * np.minimum(size // 4, 4)
        heads = []
        for k in beginnings:
            longer = size > k
            head = np.zeros(len(at), dtype=np.uint64)
            head[longer] = tb.mix((sums[at[longer] + k] - sums[at[longer]]) * tb._power("down", len(piece))[at[longer]] + _U(k))
            heads.append(head)
        found.append((at + start, kind[at], h, shape, *heads))
        start = stop
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=np.uint64), none, *[np.zeros(0, dtype=np.uint64) for _ in beginnings]
    at, *rest = (np.concatenate(c) for c in zip(*found))
    return np.searchsorted(offsets, at, side="right") - 1, *rest


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - BITS)).astype(np.int64)


def _grams(row: np.ndarray, h: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    if len(h) < n:
        return row[:0], row[:0]
    total = np.full(len(h) - n + 1, salt, dtype=np.uint64)
    for j in range(n):
        total = tb.mix(total + h[j : len(h) - n + 1 + j])
    same = row[: len(h) - n + 1] == row[n - 1 :]
    return row[: len(h) - n + 1][same], _bucket(total[same])


def _distinct(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(np.concatenate([(r << BITS) | b for r, b in parts]))
    return key >> BITS, key & (DIMS - 1)


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature): words and their beginnings of four to six bytes, so inflected forms share features."""
    row, kind, h, _, *heads = runs(data, offsets, BEGINNINGS)
    word = kind == 1
    parts = [(row[word], _bucket(h[word]))]
    for head in heads:
        on = word & (head != 0)
        parts.append((row[on], _bucket(head[on])))
    return _distinct(parts)


def style_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature): words and word pairs, and runs of one to three shapes with the punctuation as it is."""
    row, kind, h, shape = runs(data, offsets)
    word = kind == 1
    form = np.where(word, tb.mix(shape.astype(np.uint64) + _U(77)), h)
    parts = [_grams(row[word], h[word], n, 10 + n) for n in (1, 2)] + [_grams(row, form, n, 20 + n) for n in (1, 2, 3)]
    return _distinct(parts)


def pieces(column, features) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, row within, feature) for groups of rows of bounded text."""
    data, offsets = tb.text_bytes(column)
    for i, j in tb.spans_of_rows(offsets):
        row, feature = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, j, row, feature
