"""Exact nearest entries of integer vectors through a geometric near-neighbour access tree (GNAT).

A node has a few split points; every other entry belongs to the child of its nearest split point. For each split point
and child the node stores the least and the greatest distance from the point to the child's entries. A query measures
its distances to the split points; by the triangle inequality a child whose range lies farther from the query's distance
than the best distance so far holds nothing as near, and its whole subtree is left out, strictly: never one that may tie.

Distances that prune are square roots in double precision; SLACK makes every comparison err towards visiting. What
decides is compared in integers: the squared distance, and between equal ones the lower index.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Split points of a node; entries of a leaf at most.
DEGREE, LEAF = 6, 6
#: Above the relative error of a converted, rooted, added and scaled distance.
SLACK = 1e-15


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y, in 64-bit integers; the caller bounds the components."""
    gap = x[:, None, :] - y[None, :, :]
    return (gap * gap).sum(2)


@dataclass
class Node:
    entries: np.ndarray
    children: list[Node] = field(default_factory=list)
    near: np.ndarray | None = None
    far: np.ndarray | None = None


class Gnat:
    def __init__(self, entries: np.ndarray, degree: int = DEGREE, leaf: int = LEAF):
        self.entries = np.ascontiguousarray(entries, np.int64)
        self.degree, self.leaf = degree, leaf
        self.measured = 0
        self.root = self._build(np.arange(len(entries)))

    def _build(self, own: np.ndarray) -> Node:
        if len(own) <= max(self.leaf, self.degree):
            return Node(own)
        splits = [0]  # the first, then the farthest from those taken
        least = squared(self.entries[own], self.entries[own[:1]])[:, 0]
        while len(splits) < self.degree and least.max() > 0:
            splits.append(int(least.argmax()))
            least = np.minimum(least, squared(self.entries[own], self.entries[own[splits[-1:]]])[:, 0])
        if len(splits) == 1:  # all entries are equal: the lowest index wins every tie
            return Node(own[:1])
        points = own[splits]
        rest = np.delete(own, splits)
        d = squared(self.entries[rest], self.entries[points])
        home = d.argmin(1)
        root = np.sqrt(d.astype(np.float64))
        node = Node(points, [], np.full((len(points),) * 2, np.inf), np.full((len(points),) * 2, -np.inf))
        for k in range(len(points)):
            at = home == k
            if at.any():
                node.near[:, k], node.far[:, k] = root[at].min(0), root[at].max(0)
            node.children.append(self._build(rest[at]))
        return node

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each query's nearest entry, the lower index where two are as near."""
        queries = np.ascontiguousarray(queries, np.int64)
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.full(len(queries), len(self.entries))
        if len(queries) and len(self.entries):
            self._visit(self.root, queries, np.arange(len(queries)), best, index)
        return index, best

    def _visit(self, node: Node, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if not len(rows) or not len(node.entries):
            return
        d = squared(queries[rows], self.entries[node.entries])
        self.measured += d.size
        for k, entry in enumerate(node.entries.tolist()):
            better = (d[:, k] < best[rows]) | ((d[:, k] == best[rows]) & (entry < index[rows]))
            best[rows[better]], index[rows[better]] = d[better, k], entry
        if not node.children:
            return
        reach, first = np.sqrt(d.astype(np.float64)), d.argmin(1)
        for k, child in enumerate(node.children):  # the nearest split point's child first: it lowers the best distance
            self._visit(child, queries, rows[first == k], best, index)
        for k, child in enumerate(node.children):
            if not len(child.entries):
                continue
            now = np.sqrt(best[rows].astype(np.float64))[:, None]
            out = reach * (1 - SLACK) > (node.far[None, :, k] + now) * (1 + SLACK)
            out |= node.near[None, :, k] * (1 - SLACK) > (reach + now) * (1 + SLACK)
            self._visit(child, queries, rows[(first != k) & ~out.any(1)], best, index)
