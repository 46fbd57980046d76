"""Approximate nearest neighbours by a permutation index.

Nearness is the inner product, so length counts: every row gets one more component that brings it to the greatest length of its
block, and a query a zero there, after which the largest inner product is the smallest angle. A vector is represented by its nearest pivots in order. Pivots are a bounded sample of the rows of each width, those
with the smallest hashed ids; every row is indexed. In each block of rows a pivot's inverted file lists the rows that have it among their
nearest, with its place there. For a query the files of its own nearest pivots are read; a row's footrule distance, with a
missing pivot counted as last, is a constant less twice the sum of (kept - the later of both places) over common pivots. The
rows with the smallest distance are ranked again by inner product on the original vectors. Copies of a vector are indexed once
per block and all stand behind it, so copies neither crowd out other rows nor are cut themselves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.vectors import best_in_blocks, matrix, usable

PIVOTS = 256
#: With fewer pivots the order says too little, and all rows of the width are ranked again.
LEAST_PIVOTS = 64
KEPT = 64
#: Share of a block that is ranked again, and the least number of rows.
RERANKED = 0.15
AT_LEAST = 400
BLOCK = 16_384
GROUP = 2_048


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, kept: int) -> np.ndarray:
    """For each row the numbers of its nearest pivots, nearest first; ties to the smaller number."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.argsort(-(x / np.maximum(length, 1e-300)) @ pivots.T, axis=1, kind="stable")[:, :kept]


def lifted(x: np.ndarray) -> np.ndarray:
    """The rows with one more component, so that all are of length 1 with the longest row as the unit."""
    longest = max(np.abs(x).max(initial=0.0), 1e-300)
    x = x / longest  # no overflow in the squares
    squares = np.einsum("ij,ij->i", x, x)
    most = squares.max(initial=1e-300)
    return np.column_stack([x / np.sqrt(most), np.sqrt(np.maximum(1 - squares / most, 0))])


class InvertedFiles:
    """For each pivot the rows that keep it, and its place there."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, kept: int):
        near = nearest_pivots(x, pivots, kept)
        self.kept = near.shape[1]
        order = np.argsort(near.ravel(), kind="stable")
        bounds = np.searchsorted(near.ravel()[order], np.arange(len(pivots) + 1))
        rows, places = order // self.kept, (order % self.kept).astype(np.int32)
        self.files = [(rows[a:b], places[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        self.count = len(x)

    def agreement(self, order: np.ndarray) -> np.ndarray:
        """A constant less half the footrule distance of every row."""
        out = np.zeros(self.count, np.int32)
        for place, pivot in enumerate(order):
            rows, places = self.files[pivot]
            out[rows] += self.kept - np.maximum(places, place)
        return out


class Copies:
    """The distinct vectors of a block, in order of their first rows, and the rows that hold each, in order."""

    def __init__(self, x: np.ndarray):
        whole = np.ascontiguousarray(x + 0.0)  # no negative zeros
        _, first, of = np.unique(whole.view(np.dtype((np.void, whole.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        order = np.argsort(first)
        self.vectors = whole[first[order]]
        self.of = np.argsort(order)[of.ravel()]
        self.rows = np.argsort(self.of, kind="stable")
        self.sizes = np.bincount(self.of)
        self.begin = np.cumsum(self.sizes) - self.sizes

    def first_rows(self, numbers: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(index in numbers, row) of at most `most` rows of each."""
        held = np.minimum(self.sizes[numbers], most)
        at = np.repeat(np.arange(len(numbers)), held)
        return at, self.rows[self.begin[numbers][at] + np.arange(len(at)) - (np.cumsum(held) - held)[at]]


def inner_products(columns: np.ndarray, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Sums of products in double precision, component by component in order, so equal vectors get equal scores."""
    out = np.zeros(len(rows))
    for d in range(len(query)):
        out += columns[d, rows] * query[d]
    return out


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """(d, v) of at most `most` rows of each width; ids are put in order before any vector is moved."""
    hashed = rows.select("d", F.struct(F.xxhash64("id").alias("h"), "id").alias("at"), "v")
    n = F.row_number().over(Window.partitionBy("d").orderBy("at"))
    last = hashed.select("d", "at").withColumn("n", n).where(F.col("n") <= most).groupBy("d").agg(F.max("at").alias("last"))
    near = hashed.join(F.broadcast(last), "d").where(F.col("at") <= F.col("last"))
    return near.withColumn("n", n).where(F.col("n") <= most).select("d", "v")  # an id can have many rows


def approximate_top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
    pivots: int = PIVOTS, kept: int = KEPT, reranked: float = RERANKED, block: int = BLOCK, group: int = GROUP,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest found by inner product, ties to smaller ids.

    `is_query` is a condition on the column `id`. Rows without id, and vectors that are null, zero, empty or hold null or
    non-finite components take no part; vectors of different widths do not meet. Rows that share a query's id are its own and no
    candidates; other repeated rows are candidates each. With fewer than k candidates all are returned. Of equal vectors those
    with the smallest ids are found, however many there are. At the defaults the
    recall at 20 on unrelated directions of width 64 is above 0.95, at equal and at widely varying lengths; tests hold it above
    0.9. With `reranked=1.0` every row is ranked again and the result is exact.
    """
    rows = usable(vectors, vec_id, vector).where(F.exists("v", lambda x: x != 0))
    sample = sampled(rows, pivots).toArrow()
    by_width: dict[int, np.ndarray] = {}
    for width, count in zip(*np.unique(np.asarray(sample["d"]), return_counts=True)):
        if count >= min(pivots, LEAST_PIVOTS):
            by_width[int(width)] = lifted(matrix(sample.filter(np.asarray(sample["d"]) == width)["v"]))
    shipped = vectors.sparkSession.sparkContext.broadcast(by_width)

    def search(query_ids, queries, ids, x):
        centres = shipped.value.get(x.shape[1])
        centres = np.eye(1, x.shape[1] + 1) if centres is None else centres  # a width of few rows
        copies = Copies(x)
        index, columns = InvertedFiles(lifted(copies.vectors), centres, min(kept, len(centres))), np.ascontiguousarray(copies.vectors.T)
        most = max(AT_LEAST, 20 * k, int(reranked * len(x))) if len(centres) > 1 else len(x)
        most = min(len(copies.vectors), most)
        numbers, places, scores = [], [], []
        for n, order in enumerate(nearest_pivots(np.column_stack([queries, np.zeros(len(queries))]), centres, min(kept, len(centres)))):
            agree = index.agreement(order).astype(np.int64)
            own = np.flatnonzero(ids == query_ids[n])
            held, without = np.unique(copies.of[own], return_counts=True)
            agree[held[without == copies.sizes[held]]] = -1  # no row but the query's own
            near = np.sort(np.argpartition(np.arange(len(agree)) - agree * len(agree), most - 1)[:most])
            near = near[agree[near] >= 0]
            found = inner_products(columns, near, queries[n])
            if len(found) > k:
                best = found >= np.partition(found, -k)[-k]
                near, found = near[best], found[best]
            at, rows = copies.first_rows(near, k + len(own))
            others = ~np.isin(rows, own)
            at, rows = at[others], rows[others]
            best = np.lexsort((rows, -found[at]))[:k]
            numbers.append(np.full(len(best), n))
            places.append(rows[best])
            scores.append(found[at[best]])
        return np.concatenate(numbers), np.concatenate(places), np.concatenate(scores)

    return best_in_blocks(rows, is_query, k, block, group, search, "double")
