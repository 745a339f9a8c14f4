"""Burkhard-Keller trees over 64-bit fingerprints, as arrays, many at once.

A node's children hang on edges labelled with the child's Hamming distance to
the node, one child a label. By the triangle inequality a search of radius r
from a node at distance d needs only the edges labelled d - r to d + r. A
forest holds one tree per shard; trees are built and searched level by level,
all shards together, so the work is array arithmetic.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """BK-trees of distinct values, one a shard; shard ids need not be dense."""

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        n = len(value)
        self.value = value.astype(U)
        self.parent = np.full(n, -1, np.int64)
        self.label = np.zeros(n, np.int64)
        _, first, group = np.unique(shard, return_index=True, return_inverse=True)
        self.root_of = first[group]  # each value's root: the first of its shard
        waiting = np.flatnonzero(np.arange(n) != self.root_of)
        at = self.root_of[waiting]
        while len(waiting):
            d = distance(self.value[waiting], self.value[at])
            # Of those that reach one edge together, the first becomes its node and the others go on below it.
            _, lead, edge = np.unique(at * 65 + d, return_index=True, return_inverse=True)
            node = waiting[lead]
            self.parent[node], self.label[node] = at[lead], d[lead]
            below = np.ones(len(waiting), bool)
            below[lead] = False
            at, waiting = node[edge][below], waiting[below]
        order = np.lexsort((self.label, self.parent))
        order = order[np.searchsorted(self.parent[order], 0) :]
        self.child = order
        self.edges = self.parent[order] * 65 + self.label[order]

    def links(self, radius: int, rows: int = 200_000):
        """Yield arrays (i, j), i > j in place, of values of one shard within the radius.

        Searches run in blocks of rows; a block's frontier is split when it grows.
        """
        for start in range(0, len(self.value), rows):
            query = np.arange(start, min(start + rows, len(self.value)))
            yield from self._search(query, self.root_of[query], radius)

    def _search(self, query: np.ndarray, node: np.ndarray, radius: int):
        stack = [(query, node)]
        while stack:
            query, node = stack.pop()
            d = distance(self.value[query], self.value[node])
            near = (d <= radius) & (query > node)
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.edges, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.edges, node * 65 + np.minimum(d + radius, 64), side="right")
            n = high - low
            # Blocks of at most two million steps keep memory flat.
            cuts = np.searchsorted(np.cumsum(n), np.arange(2_000_000, int(n.sum()) + 2_000_000, 2_000_000))
            for a, b in zip([0, *cuts[:-1] + 1], cuts + 1) if n.sum() else ():
                m = n[a:b]
                step = np.repeat(low[a:b] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(int(m.sum()))
                if len(step):
                    stack.append((np.repeat(query[a:b], m), self.child[step]))


def roots(n: int, pairs) -> np.ndarray:
    """Smallest reachable place for each of n places, over batches of (i, j) links."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            split = a != b
            if not split.any():
                break
            i, j, a, b = i[split], j[split], a[split], b[split]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root
