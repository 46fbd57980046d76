"""Hard-negative mining with an inverted multi-index.

Components become whole numbers, floor(256 x). Each half of the components has a codebook, fitted on a bounded sample; a
pair of words, one from each codebook, is a cell, and every row lies in the cell of its nearest words. For a query with
halves p and q, a row of cell (i, j) scores at most p.c_i + |p| r_i + q.c_j + |q| r_j, where r is the largest distance of
any row's half to its word. The two sums are sorted apart, and a heap walks pairs of places in the sorted lists in the
order of the summed bound (a multi-sequence), so cells come best first and the walk stops as soon as the next bound cannot
change any window of the query.

A window is a range of scores of which the first k rows are wanted, of the query's own label or of other labels. Neighbouring cells form blocks
of bounded size; a block meets its queries in tasks of their own. Each query searches the block it lies in first. What it
finds there is a floor for all other blocks, and only blocks with a cell that can still reach a window's floor get the query.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestack.llm.vectors import matrix, usable

#: Rows of a cell aimed at, and the most words of a codebook.
CELL = 256
WORDS = 64
#: Rows from which codebooks are fitted; every row is indexed.
SAMPLE = 4_096
#: The most rows of a block, fewer of wide vectors so that a block has at most 32 MB, and queries that meet it in one task.
BLOCK = 4_096
BLOCK_BYTES = 32 << 20
GROUP = 2_048
#: Rows that are multiplied at a time while cells are visited.
BUNDLE = 1_024
LEAST, MOST = -(2**63), 2**63 - 1


def codebook(x: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """At most k words for the rows of x: means of nearest rows, starting from the first different rows."""
    words = np.unique(x[: 4 * k], axis=0, return_index=True)[1]
    words = x[np.sort(words)[:k]].copy() if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds if len(x) else 0):
        at = nearest(x, words)[0]
        for w in np.unique(at):
            words[w] = x[at == w].mean(0)
    return words


def nearest(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest word, distance to it) of each row."""
    at = ((words**2).sum(1)[None, :] - 2 * x @ words.T).argmin(1) if x.shape[1] else np.zeros(len(x), int)
    return at, np.sqrt(((x - words[at]) ** 2).sum(1))


def multi_sequence(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """All pairs of places in a and b, in descending order of a[i] + b[j]."""
    first, second = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    heap, seen = [(-(a[first[0]] + b[second[0]]), 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        yield int(first[i]), int(second[j]), -total
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(a[first[x]] + b[second[y]]), x, y))


class Codes:
    """The codebooks and radii of one width."""

    def __init__(self, words: tuple[np.ndarray, np.ndarray]):
        self.words = words
        self.half = words[0].shape[1]
        self.radii = tuple(np.zeros(len(w)) for w in words)
        self.cells: list[tuple[int, int, int, int]] = []  # (i, j, first block, number of blocks)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def bounds(self, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half (most, least): what a row of each word can add to the score of each query."""
        out = []
        for part, words, radii in zip(self.halves(queries), self.words, self.radii):
            centre, reach = part @ words.T, np.sqrt((part**2).sum(1))[:, None] * radii[None, :]
            slack = 1e-9 * (np.abs(centre) + reach) + 1e-6
            out.append((centre + reach + slack, centre - reach - slack))
        return out


class Block:
    """The rows of one block by cell, and the search of queries in it."""

    def __init__(self, codes: Codes, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray):
        order = np.lexsort((j, i))
        self.codes, self.ids, self.labels, self.x = codes, ids[order], labels[order], x[order]
        self.rank = np.empty(len(ids), int)
        self.rank[np.argsort(self.ids, kind="stable")] = np.arange(len(ids))
        i, j = i[order], j[order]
        new = np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (np.diff(j) != 0)])
        self.cells = {(int(i[a]), int(j[a])): (int(a), int(z)) for a, z in zip(new, np.r_[new[1:], len(i)])}
        self.used = np.unique(i), np.unique(j)
        self.largest = np.abs(x).max(initial=0)
        self.visited = 0

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        if np.abs(query).sum() * self.largest < 2**52:
            return (self.x[rows] @ query).astype(np.int64)
        query = [int(c) for c in query]  # beyond, Python's whole numbers
        return np.array([max(LEAST + 1, min(MOST, sum(int(c) * q for c, q in zip(x, query)))) for x in self.x[rows]], np.int64)

    def search(self, query: np.ndarray, bounds, own, label, same: bool, k: int, windows: list[tuple[int, int, int | None]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each window (lowest, highest, floor) its number and the (rows, scores) that may be among its first k."""
        (most1, least1), (most2, least2) = [(m[u], s[u]) for (m, s), u in zip(bounds, self.used)]
        top = max(high for _, high, _ in windows)
        kept = [(np.zeros(0, int), np.zeros(0, np.int64)) for _ in windows]
        need = [max(low, low if floor is None else floor) for low, _, floor in windows]
        waiting, size = [], 0

        def flush() -> None:
            nonlocal waiting, size
            rows, waiting, size = np.concatenate([np.arange(a, z) for a, z in waiting]), [], 0
            rows = rows[((self.labels[rows] == label) == same) & (self.ids[rows] != own)]
            scores = self.scores(rows, query)
            for w, (_, high, _) in enumerate(windows):
                fit = (scores >= need[w]) & (scores <= high)
                if fit.any():
                    r, s = np.r_[kept[w][0], rows[fit]], np.r_[kept[w][1], scores[fit]]
                    best = np.lexsort((self.rank[r], -s))[:k]  # no score is the least of its type
                    kept[w] = r[best], s[best]
                    if len(best) == k:
                        need[w] = max(need[w], int(s[best[-1]]))

        for i, j, bound in multi_sequence(most1, most2):
            if bound < min(need):
                break
            cell = self.cells.get((int(self.used[0][i]), int(self.used[1][j])))
            if cell and (top == MOST or least1[i] + least2[j] <= top):
                self.visited += 1
                waiting.append(cell)
                size += cell[1] - cell[0]
                if size >= BUNDLE:
                    flush()
        if waiting:
            flush()
        return [(w, *found) for w, found in enumerate(kept) if len(found[0])]


class MultiIndex:
    """`rows`: (id, label, d, v, i, j, b), every usable row with its cell and block; `codes`: codebooks, radii and cells by width.

    Codebooks come from one sample over all widths; a width of which it holds no row has a single word. A cell with more rows than a
    block has several blocks, dealt by hashed id.
    """

    def __init__(self, vectors: DataFrame, label: Column, scratch, vec_id: str, vector: str, sample: int = SAMPLE, block: int = BLOCK):
        given = vectors.select(F.struct(F.col(vec_id).alias("id"), label.alias("label")).alias("who"), F.col(vector).alias("v"))
        fine = usable(given.where("who.id is not null and who.label is not null"), "who", "v")
        rows = fine.select("id.id", "id.label", "d", F.col("v").cast("array<double>").alias("v"))
        self.scratch, self.spark, self.block = scratch, vectors.sparkSession, block
        count = rows.count()
        drawn = rows.orderBy(F.xxhash64("id"), "id", "label").limit(sample).select("d", "v").toArrow()
        self.codes = _fit(drawn, min(WORDS, max(1, round((count / CELL) ** 0.5))))
        self.id_type, self.label_type = rows.schema["id"].dataType, rows.schema["label"].dataType
        schema = f"id {self.id_type.simpleString()}, label {self.label_type.simpleString()}, d int, v array<double>, i int, j int, r1 double, r2 double"
        assigned = scratch.put(rows.mapInArrow(_assign(self.codes), schema))
        cells = assigned.groupBy("d", "i", "j").agg(F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).orderBy("d", "i", "j").collect()
        blocks = self._deal(cells)  # a row for each cell in use, at most WORDS^2 a width
        self.rows = assigned.drop("r1", "r2").join(F.broadcast(blocks), ["d", "i", "j"]).withColumn("b", F.col("first") + F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).drop("first", "pieces")

    def _deal(self, cells) -> DataFrame:
        """Neighbouring cells share a block while they fit."""
        out, at, room, width = [], -1, 0, None
        rows = Counter()
        for c in cells:
            rows[c.d] += c.n
        for c in cells:
            codes = self.codes.setdefault(c.d, Codes((np.zeros((1, c.d // 2)), np.zeros((1, c.d - c.d // 2)))))
            codes.radii[0][c.i], codes.radii[1][c.j] = max(codes.radii[0][c.i], c.r1), max(codes.radii[1][c.j], c.r2)
            most = max(1, min(self.block, BLOCK_BYTES // (8 * max(1, c.d))))
            most = -(-rows[c.d] // -(-rows[c.d] // most))  # blocks of about equal size
            pieces = -(-c.n // most)
            if c.d != width or c.n > room:
                at, room, width = at + 1, most, c.d
            codes.cells.append((c.i, c.j, at, pieces))
            out.append((c.d, c.i, c.j, at, pieces))
            room = room - c.n if pieces == 1 else 0
            at += pieces - 1
        return self.spark.createDataFrame(out, "d int, i int, j int, first int, pieces int")

    def first_k(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """(query_id, window, score, id): the first k rows of every window, by score and then by smaller id.

        `queries`: (id, label, d, v, home, windows array<struct<lowest,highest>>).
        """
        home = self.scratch.put(self._meet(queries.withColumn("b", F.col("home")).withColumn("floors", F.array().cast("array<bigint>")), same, k))
        floors = home.groupBy("query_id", "window").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k)
        by_query = floors.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "floor"))).alias("m"))  # as many entries as a query has windows
        known = queries.join(by_query, F.col("id") == F.col("query_id"), "left").drop("query_id")
        known = known.withColumn("floors", F.transform("windows", lambda _, w: F.element_at("m", w))).drop("m")
        elsewhere = known.mapInArrow(_reachable(self.codes), known.withColumn("b", F.lit(0)).schema)
        found = home.unionByName(self._meet(self.scratch.put(elsewhere), same, k))
        order = Window.partitionBy("query_id", "window").orderBy(F.col("score").desc(), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def _meet(self, visits: DataFrame, same: bool, k: int) -> DataFrame:
        """Each query searches the block b that it visits."""
        groups = visits.groupBy("b").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
        dealt = visits.join(groups, "b").withColumn("g", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int"))
        dealt = dealt.select(*[F.col(c).alias(f"q_{c}") for c in ("b", "g", "id", "label", "d", "v", "windows", "floors")])
        rows = self.rows.join(groups, "b").withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        schema = f"query_id {self.id_type.simpleString()}, window int, id {self.id_type.simpleString()}, score bigint"
        arrow_id, codes = to_arrow_type(self.id_type), self.codes

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if left.num_rows and right.num_rows:
                here = codes[right["d"][0].as_py()]
                ids = np.asarray(right["id"])
                block = Block(here, ids, np.asarray(right["label"]), matrix(right["v"]), np.asarray(right["i"]), np.asarray(right["j"]))
                queries = matrix(left["q_v"])
                bounds = here.bounds(queries)
                for n, row in enumerate(left.drop_columns(["q_v"]).to_pylist()):
                    floors = row["q_floors"] or [None] * len(row["q_windows"])
                    windows = [(w["lowest"], w["highest"], f) for w, f in zip(row["q_windows"], floors)]
                    own = [(m[n], s[n]) for m, s in bounds]
                    for w, r, scores in block.search(queries[n], own, row["q_id"], row["q_label"], same, k, windows):
                        out += [(row["q_id"], w, i, s) for i, s in zip(block.ids[r].tolist(), scores.tolist())]
            columns = list(zip(*out)) or [[], [], [], []]
            return pa.table([pa.array(c, t) for c, t in zip(columns, (arrow_id, pa.int32(), arrow_id, pa.int64()))], ["query_id", "window", "id", "score"])

        return dealt.groupBy("q_b", "q_g").cogroup(rows.groupBy("b", "g")).applyInArrow(search, schema)


def _fit(drawn: pa.Table, k: int) -> dict[int, Codes]:
    out = {}
    for d in np.unique(np.asarray(drawn["d"])).tolist():
        x = np.floor(256 * matrix(drawn.filter(pc.equal(drawn["d"], d))["v"]))
        out[d] = Codes((codebook(x[:, : d // 2], k), codebook(x[:, d // 2 :], k)))
    return out


def _assign(codes: dict[int, Codes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table(batch)
            for d in np.unique(np.asarray(table["d"])).tolist():
                part = table.filter(pc.equal(table["d"], d))
                x = np.floor(256 * matrix(part["v"]))
                known = codes.get(d) or Codes((np.zeros((1, d // 2)), np.zeros((1, d - d // 2))))
                (i, r1), (j, r2) = (nearest(h, w) for h, w in zip(known.halves(x), known.words))
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * d)
                whole = pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))
                columns = [part["id"].combine_chunks(), part["label"].combine_chunks(), part["d"].combine_chunks(), whole, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(r1), pa.array(r2)]
                yield from pa.table(columns, ["id", "label", "d", "v", "i", "j", "r1", "r2"]).to_batches()

    return run


def _reachable(codes: dict[int, Codes]):
    """A row for each block, other than the own one, with a cell that can reach a window's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, row in enumerate(batch.select(["d", "home", "windows", "floors"]).to_pylist()):
                here = codes[row["d"]]
                query = matrix(pa.chunked_array([batch.column("v").slice(n, 1)]))
                (most1, least1), (most2, least2) = here.bounds(query)
                need = min(w["lowest"] if f is None else max(f, w["lowest"]) for w, f in zip(row["windows"], row["floors"]))
                top = max(w["highest"] for w in row["windows"])
                blocks = {at + p for i, j, at, pieces in here.cells if most1[0, i] + most2[0, j] >= need and (top == MOST or least1[0, i] + least2[0, j] <= top) for p in range(pieces)}
                blocks = sorted(blocks - {row["home"]})
                if blocks:
                    repeated = pa.table(batch.slice(n, 1)).take(pa.array([0] * len(blocks)))
                    yield from repeated.append_column("b", pa.array(blocks, pa.int32())).combine_chunks().to_batches()

    return run


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, scratch, positives: int = 5, negatives: int = 3, lower: int = 50, upper: int = 95,
    vec_id: str = "vec_id", vector: str = "embedding", **index,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows for which `is_anchor`, a condition on the column `id`, holds; `label` is an expression on the given table. Scores are whole-number
    inner products. An anchor's positives are its first rows of the same label; a positive's negatives are the first rows
    of other labels whose score is at least `lower` and at most `upper` percent of the positive's, which no score is where that is negative. Ties go to smaller ids.

    Rows without id or label, or whose vector is null or holds null or non-finite components, take no part. Vectors of different
    widths do not meet; an empty one has product 0 with other empty ones. Rows that share the anchor's id are its own and neither positives
    nor negatives; of them the one with the smallest label and vector is the anchor. Other rows that repeat an id are rows each.
    Scores beyond 64 bits are cut to the largest or smallest. An empty table, or one with a single label, gives no rows.
    """
    found = MultiIndex(vectors, label, scratch, vec_id, vector, **index)
    anchors = found.rows.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "d", "v", "b")).alias("a")).select("id", "a.label", "a.d", "a.v", F.col("a.b").alias("home"))
    anchors = scratch.put(anchors)

    def window(low: Column, high: Column) -> Column:
        return F.struct(low.cast("long").alias("lowest"), high.cast("long").alias("highest"))

    near = found.first_k(anchors.withColumn("windows", F.array(window(F.lit(LEAST + 1), F.lit(MOST)))), True, positives)
    near = scratch.put(near.select(F.col("query_id").alias("anchor_id"), F.col("rank").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    rest = F.pmod("positive_score", F.lit(100))
    hundreds = F.expr("(positive_score - pmod(positive_score, 100)) div 100")
    low, high = hundreds * lower + F.ceil(rest * lower / 100), hundreds * upper + F.floor(rest * upper / 100)
    ranges = near.where("positive_score >= 0").select("anchor_id", F.struct("p", window(low, high).alias("w")).alias("x"))
    asked = ranges.groupBy("anchor_id").agg(F.sort_array(F.collect_list("x")).alias("x"))  # at most `positives` entries
    asked = scratch.put(anchors.join(asked, F.col("id") == F.col("anchor_id")).withColumn("windows", F.col("x.w")).drop("anchor_id", "x"))
    hard = found.first_k(asked, False, negatives).select(F.col("query_id"), (F.col("window") + 1).alias("w"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    # the windows of an anchor are its positives with a score of 0 or more, which are the first ones
    joined = near.join(hard, (F.col("anchor_id") == F.col("query_id")) & (F.col("p") == F.col("w")))
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
