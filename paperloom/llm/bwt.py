"""Burrows-Wheeler transforms of shards of strings, merged by refining their interleave.

A shard sorts the suffixes of its own strings once, by doubling, and keeps for every suffix the byte before it and the
place of the suffix that is one byte longer (LF).  A merge starts with the shards one behind the other and refines: a pass
takes the suffixes in the order found so far, deals them stably by the byte before them and steps to the suffixes that are
one byte longer.  After k passes the interleave is right for the first k bytes; nothing is sorted anew, and no shard's text
is read.  Blocks of suffixes that agree so far are carried along: a block that splits in pass k tells a longest common
prefix of k - 1 bytes, and blocks left after ``depth`` passes are the repeated intervals of that depth.

Every string ends with a terminator of its own, so no common prefix crosses an end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SHARD_BYTES = 1 << 18


@dataclass
class Shard:
    """Suffixes in order: string, offset in it, the byte before (0 at a string's begin) and the place of the longer one (-1)."""

    string: np.ndarray
    offset: np.ndarray
    size: np.ndarray  # of the suffix's string
    before: np.ndarray
    lf: np.ndarray


def shard(data: np.ndarray, bounds: np.ndarray) -> Shard:
    """Sort the suffixes, the empty ones included, of strings laid end to end."""
    sizes = np.diff(bounds)
    strings = len(sizes)
    text = np.zeros(len(data) + strings, dtype=np.int64)
    string = np.repeat(np.arange(strings), sizes + 1)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    left = sizes[string] - offset
    text[left > 0] = data.astype(np.int64) + 1
    symbol, n = np.zeros(len(text), dtype=np.int64), len(text)
    for j in range(7):
        symbol *= 257
        m = max(n - j, 0)
        symbol[:m] += np.where(left[:m] > j, text[j:], 0)
    rank = _ranks(symbol)
    h, longest = 7, int(sizes.max(initial=0)) + 1
    while h < longest and int(rank.max(initial=0)) < n - 1:
        behind = np.zeros(n, dtype=np.int64)
        on = np.flatnonzero(left >= h)
        behind[on] = rank[on + h] + 1
        rank = _ranks(rank * (n + 1) + behind)
        h *= 2
    order = np.argsort(rank, kind="stable")
    place = np.empty(n, dtype=np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    first = offset[order] == 0
    lf = np.where(first, -1, place[order - 1])
    before = np.where(first, 0, text[order - 1] - 1).astype(np.uint8)
    return Shard(string[order], offset[order], sizes[string[order]], before, lf)


def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    sorted_ = key[order]
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.cumsum(np.append(0, sorted_[1:] != sorted_[:-1])) if len(key) else 0
    return rank


def shards(data: np.ndarray, bounds: np.ndarray, most: int = SHARD_BYTES) -> list[Shard]:
    """Shards of at most about ``most`` bytes; their strings are numbered through."""
    out, i, n = [], 0, len(bounds) - 1
    while i < n:
        j = min(max(int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1, i + 1), n)
        made = shard(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        made.string += i
        out.append(made)
        i = j
    return out


def _laid(parts: list[Shard]) -> tuple[np.ndarray, ...]:
    base = np.cumsum([0, *[len(p.lf) for p in parts]])
    lf = np.concatenate([np.where(p.lf < 0, -1, p.lf + b) for p, b in zip(parts, base)]).astype(np.int32)
    return tuple(np.concatenate([getattr(p, c) for p in parts]) for c in ("string", "offset", "size", "before")) + (lf,)


def _pass(at: np.ndarray, block: np.ndarray, before: np.ndarray, lf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One refinement: (places, blocks) of the suffixes that are one byte longer, dealt stably by that byte."""
    byte = before[at]
    order = np.argsort(byte, kind="stable")
    byte, block = byte[order], block[order]
    new = np.zeros(len(at), dtype=bool)
    new[1:] = (byte[1:] != byte[:-1]) | (block[1:] != block[:-1])
    return lf[at[order]], np.cumsum(new, dtype=np.int32)


def merge(parts: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, lcp) of all suffixes of all shards, right for ``depth`` bytes.

    ``lcp`` is the number of bytes in common with the suffix before, ``depth`` if they agree that far.
    """
    string, offset, size, before, lf = _laid(parts)
    ends = np.flatnonzero(offset == size)
    inner = lf >= 0
    at = np.concatenate([ends, np.flatnonzero(offset < size)])
    block = np.zeros(len(at), dtype=np.int32)
    lcp = np.full(len(at), depth, dtype=np.int64)
    lcp[:1] = 0
    for k in range(1, depth + 1):
        on = inner[at]
        longer, split = _pass(at[on], block[on], before, lf)
        at = np.concatenate([ends, longer])
        # from one symbol on, terminators differ from each other and from all bytes
        block = np.concatenate([np.arange(len(ends)), split + len(ends)]).astype(np.int32)
        edge = np.append(False, block[1:] != block[:-1]) & (lcp == depth)
        if not edge.any() and k > 1:
            break
        lcp[edge] = k - 1
    return string[at], offset[at], lcp


def repeated(parts: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, interval) of all stretches of ``depth`` bytes; equal stretches, and no others, share an interval.

    The same refinement over those suffixes only that can still grow into such a stretch: after k passes, those with k
    bytes left and ``depth`` - k bytes before them.
    """
    string, offset, size, before, lf = _laid(parts)
    at = np.flatnonzero((offset >= depth) & (offset <= size))
    block = np.zeros(len(at), dtype=np.int32)
    if depth % 2:
        at, block = _pass(at, block, before, lf)
    # two passes in one: dealt by the two bytes before
    two = np.maximum(lf, 0)
    pair, lf = before[two].astype(np.uint16) << 8 | before, np.where(lf < 0, -1, lf[two])
    for _ in range(depth // 2):
        at, block = _pass(at, block, pair, lf)
    return string[at], offset[at], block
