"""Signature trees: nodes hold OR-combined token bitmaps and size ranges.

A leaf is a set of tokens: its size and a bitmap with the bit of every token.
A node covers up to ``FAN`` children: the OR of their bitmaps, the range of
their sizes, and the most tokens that share a bit with another of their set
(the excess). Of two nodes, sets a and b can have at most

    bits in both bitmaps + the smaller excess

tokens in common, and at most the size of the smaller set. A dual traversal
goes down from the roots and drops a pair of nodes when this is less than the
overlap that the least sizes in them need.

Bitmaps are as wide as the sets are large (a power of two of bits), so sets of
similar size share a width; of neighbouring widths the wider is folded. Sets
two widths apart differ by more than the threshold allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN = 8
#: Pairs of nodes looked at together.
STEP = 1 << 16


def width(size: int, bits_per_token: int) -> int:
    """64-bit words of the bitmap for a set."""
    return max(1, (1 << (max(size, 1) - 1).bit_length()) * bits_per_token // 64)


def bitmap(tokens: np.ndarray, words: int) -> np.ndarray:
    bit = tokens & np.uint64(words * 64 - 1)
    out = np.zeros(words, np.uint64)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of half the width: the low bits of a token choose its bit, so the halves are ORed."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


class Tree:
    """Levels from the leaves up to at most ``FAN`` roots; ``ids`` are the callers' numbers of the leaves."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, maps: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        self.ids = ids[order]
        low, maps = sizes[order], maps[order]
        excess = low - np.bitwise_count(maps).sum(1)
        self.levels = [(maps, low, low, excess)]
        while len(low) > FAN:
            at = np.arange(0, len(low), FAN)
            maps, low, high, excess = self.levels[-1]
            maps, low = np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at)
            self.levels.append((maps, low, np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))


def possible(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs may hold a pair of sets whose Jaccard similarity is at least percent / 100."""
    most = np.minimum(x[2][i], y[2][j])
    most = np.minimum(most, np.bitwise_count(x[0][i] & y[0][j]).sum(1) + np.minimum(x[3][i], y[3][j]))
    apart = (100 * x[2][i] < percent * y[1][j]) | (100 * y[2][j] < percent * x[1][i])
    return ~apart & (most * (100 + percent) >= percent * (x[1][i] + y[1][j]))


def possible_leaves(sizes: np.ndarray, maps: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """``possible`` for pairs of sets with bitmaps of any width."""
    near = (100 * sizes[i] >= percent * sizes[j]) & (100 * sizes[j] >= percent * sizes[i])
    out = np.zeros(len(i), bool)
    out[near] = shared_leaves(sizes, maps, i[near], j[near]) * (100 + percent) >= percent * (sizes[i[near]] + sizes[j[near]])
    return out


def shared_leaves(sizes: np.ndarray, maps: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The most tokens that pairs of sets can have in common; 0 if their widths are two steps apart."""
    out = np.zeros(len(i), np.int64)
    words = np.array([len(m) for m in maps], np.int64)
    swap = words[i] > words[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    for w in np.unique(words[i]).tolist():
        for v in (w, 2 * w):
            every = np.flatnonzero((words[i] == w) & (words[j] == v))
            step = pairs_at_once(w)
            for at in (every[k:k + step] for k in range(0, len(every), step)):
                sides = []
                for k in (i[at], j[at]):
                    rows, place = np.unique(k, return_inverse=True)
                    m = fold(np.stack([maps[r] for r in rows.tolist()]), w)
                    sides.append((m, sizes[rows], sizes[rows] - np.bitwise_count(m).sum(1), place))
                (x, nx, ex, p), (y, ny, ey, q) = sides
                most = np.bitwise_count(x[p] & y[q]).sum(1) + np.minimum(ex[p], ey[q])
                out[at] = np.minimum(most, np.minimum(nx[p], ny[q]))
    return out


def pairs_at_once(words: int) -> int:
    """So many pairs of bitmaps take some ten MB."""
    return max(16, min(STEP, (1 << 20) // words))


def meet(x: Tree, y: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal: blocks of pairs (ids of x, ids of y) that the bitmaps allow; of a tree with itself each pair once."""
    same, step = x is y, pairs_at_once(x.levels[0][0].shape[1])
    top = max(len(x.levels), len(y.levels)) - 1
    roots_x, roots_y = (len(t.levels[min(top, len(t.levels) - 1)][1]) for t in (x, y))
    i, j = (a.ravel() for a in np.meshgrid(np.arange(roots_x), np.arange(roots_y), indexing="ij"))
    if same:
        i, j = i[i <= j], j[i <= j]
    todo = [(top, i, j)]
    while todo:
        level, i, j = todo.pop()
        if len(i) > step:
            todo += [(level, i[k:k + step], j[k:k + step]) for k in range(0, len(i), step)][::-1]
            continue
        a, b = min(level, len(x.levels) - 1), min(level, len(y.levels) - 1)
        ok = possible(x.levels[a], i, y.levels[b], j, percent)
        i, j = i[ok], j[ok]
        if level == 0:
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield x.ids[i], y.ids[j]
            continue
        # a tree that has no such level stays at its roots until the other has come down to them
        i, owner_i = _children(i, len(x.levels[a - 1][1])) if a == level else (i, np.arange(len(i)))
        j = j[owner_i]
        j, owner_j = _children(j, len(y.levels[b - 1][1])) if b == level else (j, np.arange(len(j)))
        i = i[owner_j]
        if same:
            i, j = i[i <= j], j[i <= j]
        if len(i):
            todo.append((level - 1, i, j))


def _children(nodes: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    child = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
    keep = child < below
    return child[keep], np.repeat(np.arange(len(nodes)), FAN)[keep]


def candidate_pairs(sizes: np.ndarray, maps: list[np.ndarray], percent: int,
                    side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs of sets that may be similar. With ``side``, only pairs of sets on different sides (0 and 1)."""
    by_width: dict[int, np.ndarray] = {}
    words = np.array([len(m) for m in maps])
    for w in np.unique(words):
        by_width[int(w)] = np.flatnonzero(words == w)

    def tree(ids: np.ndarray, w: int) -> Tree:
        return Tree(ids, sizes[ids], fold(np.stack([maps[k] for k in ids]), w))

    for w, ids in by_width.items():
        wider = by_width.get(2 * w, ids[:0])
        if side is None:
            own = tree(ids, w)
            yield from meet(own, own, percent)
            if len(wider):
                yield from meet(own, tree(wider, w), percent)
            continue
        parts = [(ids[side[ids] == s], wider[side[wider] == s]) for s in (0, 1)]
        for left, right in ((parts[0][0], parts[1][0]), (parts[0][0], parts[1][1]), (parts[1][0], parts[0][1])):
            if len(left) and len(right):
                yield from meet(tree(left, w), tree(right, w), percent)
