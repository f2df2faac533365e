"""Recompression of token sequences: a run-length grammar whose nodes answer longest common extensions.

Levels alternate two steps.  *Block* compression replaces every maximal run of one symbol by a symbol for (symbol, length);
*pair* compression deals the symbols into two sides by a fixed hash and replaces every (left, right) neighbourhood by a
symbol for the pair.  Equal neighbourhoods get equal symbols wherever they stand, so two equal stretches are parsed alike
but for a few symbols at their ends.  An extension climbs while both sides stand at the beginning of equal symbols,
skips equal symbols, jumps through blocks by their lengths and climbs down where symbols differ: logarithmically many
steps, exact since a symbol stands for one sequence only.

Many sequences share one grammar; a separator that equals nothing stands before, between and behind them, so no symbol
and no extension crosses it.  All steps are numpy over whole levels, all queries of a call move in lockstep.
"""

from __future__ import annotations

import numpy as np

from paperloom.llm import textbatch as tb

LONE = 4
MOST_LEVELS = 200


def _numbered(key: np.ndarray, first: int) -> tuple[np.ndarray, int]:
    """A number from ``first`` on for every distinct key, and the next free one."""
    names, which = np.unique(key, return_inverse=True)
    return which.astype(np.int64) + first, first + len(names)


class Grammar:
    """The grammar of sequences laid end to end; ``symbols`` are non-negative, separators are negative and all different."""

    def __init__(self, symbols: np.ndarray):
        level = np.asarray(symbols, dtype=np.int64)
        free = int(level.max(initial=0)) + 1
        texts = int((level < 0).sum())
        self._symbols, self._firsts = [level], [np.zeros(0, dtype=np.int64)]
        for n in range(MOST_LEVELS):
            if len(level) <= LONE * texts:
                break
            first, made, free = (self._blocks if n % 2 == 0 else self._pairs)(level, free, n)
            if len(first) == len(level):
                continue
            level = made
            self._symbols.append(level)
            self._firsts.append(first)
        self._flatten()

    @staticmethod
    def _blocks(level: np.ndarray, free: int, n: int) -> tuple[np.ndarray, np.ndarray, int]:
        first = np.flatnonzero(np.append(True, level[1:] != level[:-1]))
        size = np.diff(np.append(first, len(level)))
        made, long = level[first], size > 1
        if long.any():
            made[long], free = _numbered(made[long] * (int(size.max()) + 1) + size[long], free)
        return first, made, free

    @staticmethod
    def _pairs(level: np.ndarray, free: int, n: int) -> tuple[np.ndarray, np.ndarray, int]:
        side = (tb.mix(level.astype(np.uint64) * np.uint64(2 * n + 1)) >> np.uint64(40)) & np.uint64(1)
        joined = np.append((side[:-1] == 0) & (side[1:] == 1) & (level[:-1] >= 0) & (level[1:] >= 0), False)
        first = np.flatnonzero(~np.append(False, joined[:-1]))
        made, two = level[first], joined[first]
        if two.any():
            left = first[two]
            made[two], free = _numbered(level[left] * free + level[left + 1], free)
        return first, made, free

    def _flatten(self) -> None:
        """All levels in one array each: symbol, parent, first child; a level's end is the begin of the next."""
        sizes = [len(s) for s in self._symbols]
        at = np.concatenate([[0], np.cumsum(sizes)])
        self.symbol = np.concatenate(self._symbols)
        self.child = np.append(np.zeros(sizes[0], dtype=np.int64), np.concatenate([f + a for f, a in zip(self._firsts[1:], at)] or [np.zeros(0, dtype=np.int64)]))
        parents = []
        for k in range(1, len(sizes)):
            width = np.diff(np.append(self._firsts[k], sizes[k - 1]))
            parents.append(np.repeat(np.arange(sizes[k]), width) + at[k])
        top = np.full(sizes[-1], -1, dtype=np.int64)
        self.parent = np.concatenate([*parents, top])
        # the place behind a node's last child
        self.behind = np.zeros(len(self.symbol), dtype=np.int64)
        for k in range(1, len(sizes)):
            self.behind[at[k] : at[k + 1]] = np.append(self._firsts[k][1:], sizes[k - 1]) + at[k - 1]
        self.ground = sizes[0]
        del self._symbols, self._firsts

    def extension(self, i: np.ndarray, j: np.ndarray, step: int = 1) -> np.ndarray:
        """How many symbols agree from positions i and j on (step 1) or back from them (step -1), i and j included.

        A position that is a separator has extension 0; i and j must differ.
        """
        out = np.zeros(len(i), dtype=np.int64)
        which, a, b = np.arange(len(i)), np.array(i, dtype=np.int64), np.array(j, dtype=np.int64)
        up = np.ones(len(i), dtype=bool)
        edge = (lambda p: self.child[p]) if step > 0 else (lambda p: self.behind[p] - 1)
        while len(which):
            same = self.symbol[a] == self.symbol[b]
            done = ~same & (a < self.ground) & (b < self.ground)
            if done.any():
                out[which[done]] = np.abs(b[done] - j[which[done]])
                left = ~done
                which, a, b, up, same = which[left], a[left], b[left], up[left], same[left]
            down = ~same
            up &= same
            a[down], b[down] = edge(a[down]), edge(b[down])
            pa, pb = self.parent[a], self.parent[b]
            rise = up & (pa >= 0) & (pb >= 0)
            rise[rise] = (edge(pa[rise]) == a[rise]) & (edge(pb[rise]) == b[rise])
            go = same & ~rise
            if go.any():
                x, y, px, py = a[go], b[go], pa[go], pb[go]
                jump = np.ones(len(x), dtype=np.int64)
                inner = (px >= 0) & (py >= 0)
                inner[inner] = self._is_block(px[inner]) & self._is_block(py[inner])
                if inner.any():
                    u, v, pu, pv = x[inner], y[inner], px[inner], py[inner]
                    if step > 0:
                        jump[inner] = np.minimum(self.behind[pu] - u, self.behind[pv] - v)
                    else:
                        jump[inner] = np.minimum(u - self.child[pu], v - self.child[pv]) + 1
                a[go], b[go] = x + step * jump, y + step * jump
            a[rise], b[rise] = pa[rise], pb[rise]
        return out

    def _is_block(self, node: np.ndarray) -> np.ndarray:
        first, last = self.child[node], self.behind[node] - 1
        return self.symbol[first] == self.symbol[last]
