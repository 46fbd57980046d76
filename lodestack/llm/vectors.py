"""Meeting a stated query set with all vectors, in blocks of bounded size."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v, d) of the rows with an id and a vector without null or non-finite components; d is its number of components."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & fine).select(F.col(vec_id).alias("id"), F.col(vector).alias("v"), F.size(F.col(vector)).alias("d"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def best_in_blocks(rows: DataFrame, is_query: Column, k: int, block: int, group: int, search: Callable, score_type: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of what `search` finds for each query.

    Rows are dealt by hashed id over blocks of about `block` rows, queries over groups of about `group`; each pair of block
    and group is searched in a task of its own, which returns at most k rows per query. Only vectors of one width meet.
    `search(query_ids, queries, ids, vectors)` gives (query number, id, score) arrays. A repeated query counts once.
    """
    counts = rows.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, groups = max(1, math.ceil(counts[0] / block)), max(1, math.ceil(counts[1] / group))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def everywhere(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    stored = rows.withColumn("b", dealt(blocks)).withColumn("g", everywhere(groups))
    asked = rows.where(is_query).dropDuplicates(["id", "v"]).withColumn("g", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int")).withColumn("b", everywhere(blocks))
    # names of its own, as both sides come from one frame
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("d", "g", "b", "id", "v")])
    id_type = rows.schema["id"].dataType.simpleString()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in zip(("query_id", "vec_id", "score"), (arrow_id, arrow_id, arrow_score))})
        ids = np.asarray(right["id"])
        order = np.argsort(ids, kind="stable")
        n, at, scores = search(np.asarray(left["q_id"]), matrix(left["q_v"]), ids[order], matrix(right["v"])[order])
        taken = right["id"].combine_chunks().take(pa.array(order[at]))
        return pa.table({"query_id": left["q_id"].combine_chunks().take(pa.array(n)), "vec_id": taken, "score": pa.array(scores, arrow_score)})

    schema = f"query_id {id_type}, vec_id {id_type}, score {score_type}"
    arrow_id, arrow_score = to_arrow_type(rows.schema["id"].dataType), pa.int64() if score_type == "bigint" else pa.float64()
    found = asked.groupBy("q_d", "q_g", "q_b").cogroup(stored.groupBy("d", "g", "b")).applyInArrow(meet, schema)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_rows(n: np.ndarray, at: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query number; equal scores go to the smaller place, which stands for the smaller id."""
    order = np.lexsort((at, -scores, n))
    n, at, scores = n[order], at[order], scores[order]
    begin = np.searchsorted(n, n, "left")
    keep = np.arange(len(n)) - begin < k
    return n[keep], at[keep], scores[keep]
