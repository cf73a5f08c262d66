"""Two tries walked together, as tasks do it that hold one node of a large trie and the nodes near it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Pairs of nodes, and pairs of rows, that a walk holds at once.
AT_ONCE = 1 << 17


def spread(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges low, low + 1, ... of the given sizes: the range's place, and its number, one after another."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - (np.cumsum(size) - size)[which] + low[which]


class Trie:
    """Rows of digits, sorted: the nodes of a level are the ranges of rows that agree in all digits up to there."""

    def __init__(self, digits: np.ndarray):
        self.digits = digits
        n, levels = digits.shape
        parted = np.zeros(max(0, n - 1), bool)
        self.starts = [np.array([0] * min(n, 1), np.int64)]
        for level in range(levels):
            parted |= digits[1:, level] != digits[:-1, level]
            self.starts.append(np.concatenate([[0], np.flatnonzero(parted) + 1]) if n else np.zeros(0, np.int64))
        self.ends = [np.append(s[1:], n) for s in self.starts]

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first child of each node of a level, and how many it has."""
        below = self.starts[level + 1]
        first = np.searchsorted(below, self.starts[level][nodes])
        return first, np.searchsorted(below, self.ends[level][nodes]) - first


def _rows(a: Trie, b: Trie, level: int, left: np.ndarray, right: np.ndarray, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All rows under the pairs of nodes, AT_ONCE or so at a time; of a node with itself each pair once."""
    which, i = spread(a.starts[level][left], a.ends[level][left] - a.starts[level][left])
    low, size = b.starts[level][right][which], (b.ends[level][right] - b.starts[level][right])[which]
    cuts = np.searchsorted(np.cumsum(size), np.arange(AT_ONCE, size.sum() + AT_ONCE, AT_ONCE), side="left") + 1
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)], strict=True):
        if begin < min(end, len(i)):
            place, j = spread(low[begin:end], size[begin:end])
            k = i[begin:end][place]
            once = k < j if own else np.ones(len(j), bool)
            yield k[once], j[once]


def meeting(a: Trie, b: Trie | None, fits: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (i of a, j of b; i < j of a alone where b is None) whose digits differ by one at most on each level.

    up and down count the levels on which b's digit is the larger and the smaller. fits(levels walked, up, down) says which pairs of nodes may go on; what it
    refuses isn't entered. It must refuse no pair that it would accept further down. A pair of nodes of one row each is given out as it stands, so what
    comes out is to be verified.
    """
    own = b is None
    b = a if own else b
    if not len(a.digits) or not len(b.digits):
        return
    levels = a.digits.shape[1]
    zero = np.zeros(1, np.int64)
    waiting = [(0, zero, zero, zero, zero)]
    while waiting:
        level, left, right, up, down = waiting.pop()
        if level == levels:
            yield from _rows(a, b, level, left, right, own)
            continue
        first_a, n_a = a.children(level, left)
        first_b, n_b = b.children(level, right)
        # The children of the left nodes, and with each of them those of the right one.
        which, x = spread(first_a, n_a)
        place, y = spread(first_b[which], n_b[which])
        x, which = x[place], which[place]
        apart = b.digits[b.starts[level + 1][y], level].astype(np.int64) - a.digits[a.starts[level + 1][x], level]
        up, down = up[which] + (apart > 0), down[which] + (apart < 0)
        good = (np.abs(apart) <= 1) & fits(level + 1, up, down)
        if own:
            good &= x <= y
        x, y, up, down = x[good], y[good], up[good], down[good]
        single = (a.ends[level + 1][x] - a.starts[level + 1][x] == 1) & (b.ends[level + 1][y] - b.starts[level + 1][y] == 1)
        if single.any():
            yield from _rows(a, b, level + 1, x[single], y[single], own)
            x, y, up, down = x[~single], y[~single], up[~single], down[~single]
        waiting += [(level + 1, x[k : k + AT_ONCE], y[k : k + AT_ONCE], up[k : k + AT_ONCE], down[k : k + AT_ONCE]) for k in range(0, len(x), AT_ONCE)]
