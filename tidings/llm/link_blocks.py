"""Links found within a block of rows, summed up: counts per row and a spanning forest.

A block of n rows can hold n * n links; what leaves it is one row per linked row at most.
"""

from __future__ import annotations

import numpy as np


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the least row reachable by the links (a[k], b[k])."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


class Links:
    """Gathers links of a block whose rows have ids and weights (the copies they stand for)."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        self.ids, self.weights = ids, weights
        self.links = np.zeros(len(ids), dtype=np.int64)
        self.linked = np.zeros(len(ids), dtype=np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links between different rows, each once in either direction."""
        if not len(a):
            return
        n = len(self.ids)
        self.links += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        for x, y in ((a, b), (b, a)):
            self.linked += np.bincount(x, weights=self.weights[y], minlength=n).astype(np.int64)
        rows, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = forest(len(rows), where[: len(a)], where[len(a) :])
        self.edges.append((rows, rows[root]))

    def columns(self) -> dict:
        """A row for each linked row; ``root`` is a row of the same component."""
        found = np.flatnonzero(self.links)
        root = np.arange(len(self.ids))
        if self.edges:
            root = forest(len(self.ids), *(np.concatenate(side) for side in zip(*self.edges)))
        return {
            "rep": self.ids[found],
            "links": self.links[found],
            "linked": self.linked[found],
            "root": self.ids[root[found]],
        }


COLUMNS = "rep bigint, links bigint, linked bigint, root bigint"
