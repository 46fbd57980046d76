"""Exact top-k inner products by a dual-tree search over cover trees.

Components become whole numbers, floor(256 x). A cover tree holds nested balls: at each level the centres lie more than
half the parent's scale apart and each point belongs to the first centre that covers it; a node knows the largest distance
from its centre to any of its points. Queries of a group and rows of a block get a tree each. A pair of nodes with centres
p and q and covering radii r and s holds no inner product above q.p + |q| r + |p| s + r s; where that is below the worst
kth score among the node's queries, the pair is passed over. At leaves all products are formed, exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.vectors import best_in_blocks, top_rows, usable

LEAF = 512
FANOUT = 48
BLOCK = 16_384
GROUP = 2_048


@dataclass
class Node:
    rows: np.ndarray
    centre: np.ndarray
    radius: float
    children: list["Node"] = field(default_factory=list)


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, centre: np.ndarray | None = None) -> Node:
    """The tree of the rows of x. A level that would need more than `FANOUT` centres gathers what they leave in one node."""
    rows = np.arange(len(x)) if rows is None else rows
    centre = x[rows].mean(0) if centre is None else centre
    far = np.sqrt(((x[rows] - centre) ** 2).sum(1))
    node = Node(rows, centre, float(far.max()))
    if len(rows) <= LEAF or node.radius == 0:
        return node
    scale, left, parts = node.radius / 2, rows, []
    distance = far
    while len(left) and len(parts) < FANOUT:
        c = x[left[int(distance.argmax())]]
        near = np.sqrt(((x[left] - c) ** 2).sum(1)) <= scale
        parts.append((left[near], c))
        left, distance = left[~near], distance[~near]
    if len(left) > len(rows) // 2:  # balls of this scale hold next to nothing: halve by the widest direction instead
        wide = x[rows] @ (x[rows[int(far.argmax())]] - centre)
        order = rows[np.argsort(wide, kind="stable")]
        parts, left = [(order[: len(order) // 2], None), (order[len(order) // 2 :], None)], left[:0]
    if len(left):
        parts.append((left, None))
    node.children = [cover_tree(x, part, c) for part, c in parts]
    return node


class Search:
    """The best k rows for each query, kept while pairs of nodes are visited."""

    def __init__(self, queries: np.ndarray, x: np.ndarray, own: np.ndarray, k: int):
        self.q, self.x, self.own, self.k = queries, x, own, k
        self.worst = np.full(len(queries), -np.inf)
        self.n, self.at, self.scores = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        bound = np.abs(queries).sum(1).max(initial=0) * np.abs(x).max(initial=0)
        self.kind = np.float64 if bound < 2**52 else object  # beyond, Python's whole numbers
        self.visited = 0

    def bound(self, a: Node, b: Node) -> float:
        p, q = np.linalg.norm(b.centre), np.linalg.norm(a.centre)
        most = float(a.centre @ b.centre) + q * b.radius + p * a.radius + a.radius * b.radius
        return most + 1e-9 * abs(most) + 1e-6 * (1 + p * q)

    def visit(self, a: Node, b: Node) -> None:
        if self.bound(a, b) < self.worst[a.rows].min():
            return
        if not a.children and not b.children:
            self.leaf(a.rows, b.rows)
        elif not a.children or (b.children and b.radius >= a.radius):
            for child in sorted(b.children, key=lambda c: -self.bound(a, c)):
                self.visit(a, child)
        else:
            for child in a.children:
                self.visit(child, b)

    def leaf(self, queries: np.ndarray, rows: np.ndarray) -> None:
        self.visited += 1
        rows = np.sort(rows)
        scores = self.q[queries].astype(self.kind) @ self.x[rows].astype(self.kind).T
        scores = np.where(self.own[queries][:, None] == self.own_rows[rows][None, :], -np.inf, scores)
        if len(rows) > self.k and self.kind is np.float64:
            cut = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
        else:
            cut = np.full(len(queries), -np.inf)
        i, j = np.nonzero((scores >= np.maximum(cut, self.worst[queries])[:, None]) & (scores > -np.inf))
        touched = np.isin(self.n, queries)
        n, at, found = (np.concatenate(x) for x in ((self.n[touched], queries[i]), (self.at[touched], rows[j]), (self.scores[touched], scores[i, j])))
        n, at, found = top_rows(n, at, found, self.k)
        self.n, self.at, self.scores = (np.concatenate(x) for x in ((self.n[~touched], n), (self.at[~touched], at), (self.scores[~touched], found)))
        full = np.bincount(n, minlength=len(self.q)) >= self.k
        least = np.full(len(self.q), np.inf)
        np.minimum.at(least, n, found.astype(float))
        self.worst[full] = least[full]

    def run(self, own_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.own_rows = own_rows
        self.visit(cover_tree(self.q), cover_tree(self.x))
        whole = [max(-(2**63), min(2**63 - 1, int(s))) for s in self.scores]
        return self.n, self.at, np.array(whole, np.int64)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k largest whole-number inner products, ties to smaller ids.

    `is_query` is a condition on the column `id`. Rows without id, or whose vector is null or holds null or non-finite
    components, take no part; vectors of different widths do not meet, an empty one has product 0 with other empty ones.
    Rows that share a query's id are its own and no candidates; other repeated rows are candidates each. Scores beyond 64
    bits are cut to the largest or smallest. With fewer than k candidates all are returned, for an empty table none.
    """
    rows = usable(vectors, vec_id, vector)

    def search(query_ids, queries, ids, x):
        return Search(np.floor(256 * queries), np.floor(256 * x), query_ids, k).run(ids)

    return best_in_blocks(rows, is_query, k, block, group, search, "bigint")
