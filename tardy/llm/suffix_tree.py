"""Suffix trees with constant-time longest common extensions.

:class:`SuffixTree` is built online (Ukkonen) over a sequence of integer
symbols whose last one is unique.  An Euler tour gives the leaves in suffix
order and, between neighbouring leaves, the string depth of the shallowest node
that the tour passes, which is the depth of their lowest common ancestor; a
sparse table of minima over those depths answers any longest common extension
with two look-ups.
"""

from __future__ import annotations

import numpy as np


class SuffixTree:
    """``rank``: place of each suffix in symbol order; ``lce``: longest common
    extensions.  The edges are dropped once the tour is done; while they are
    built, a symbol takes about 600 bytes."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        order, depth = _tour(*_ukkonen(symbols.tolist()), self.n)
        self.rank = np.empty(self.n, np.int64)
        self.rank[order] = np.arange(self.n)
        # level k: least depth between leaves i .. i + 2^k
        self.least = [depth]
        width = 1
        while 2 * width <= len(depth):
            last = self.least[-1]
            self.least.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes ``i`` and ``j``."""
        a, b = np.minimum(self.rank[i], self.rank[j]), np.maximum(self.rank[i], self.rank[j])
        out = np.where(i == j, self.n - i, 0)
        for k, table in enumerate(self.least):
            at = np.flatnonzero((b - a >= 1 << k) & (b - a < 2 << k))
            out[at] = np.minimum(table[a[at]], table[b[at] - (1 << k)])
        return out


def _ukkonen(s: list[int]) -> tuple[dict[int, int], list[int], list[int], int]:
    """(edges, first symbol of each node's edge, end of it, symbol range); an
    edge is keyed by node * range + first symbol, node 0 is the root, and a
    leaf's edge ends with the text."""
    n, span = len(s), max(s, default=0) + 1
    edge: dict[int, int] = {}
    begin, end, link = [0], [0], [0]
    node = at = length = open_ = 0
    for i in range(n):
        c = s[i]
        open_ += 1
        waiting = 0
        while open_:
            if not length:
                at = i
            key = node * span + s[at]
            child = edge.get(key)
            if child is None:
                edge[key] = len(begin)
                begin.append(i)
                end.append(n)
                link.append(0)
                if waiting:
                    link[waiting] = node
                    waiting = 0
            else:
                b = begin[child]
                size = end[child] - b
                if length >= size:
                    at += size
                    length -= size
                    node = child
                    continue
                if s[b + length] == c:
                    if waiting:
                        link[waiting] = node
                    length += 1
                    break
                split = len(begin)
                edge[key] = split
                begin += [b, i]
                end += [b + length, n]
                link += [0, 0]
                begin[child] = b + length
                edge[split * span + s[b + length]] = child
                edge[split * span + c] = split + 1
                if waiting:
                    link[waiting] = split
                waiting = split
            open_ -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - open_ + 1
    return edge, begin, end, span


def _tour(edge: dict[int, int], begin: list[int], end: list[int], span: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Euler tour with children in symbol order: the suffix of each leaf, and
    the least string depth on the way from each leaf to the next."""
    keys = np.fromiter(edge.keys(), np.int64, len(edge))
    child = np.fromiter(edge.values(), np.int64, len(edge))
    edge.clear()
    order = np.argsort(keys)
    parent, child = keys[order] // span, child[order]
    first = np.searchsorted(parent, np.arange(len(begin) + 1)).tolist()
    size = np.subtract(end, begin)
    down, size = child.tolist(), size.tolist()
    suffix, least = [], []
    low = 0
    # (node, string depth of its parent, whether the tour comes back to the parent for it)
    stack = [(0, 0, False)]
    while stack:
        node, above, back = stack.pop()
        if back:
            low = above
        depth = above + size[node]
        a, b = first[node], first[node + 1]
        if a == b:
            suffix.append(n - depth)
            least.append(low)
        else:
            for k in range(b - 1, a, -1):
                stack.append((down[k], depth, True))
            stack.append((down[a], depth, False))
    return np.array(suffix, np.int64), np.array(least[1:], np.int64)
