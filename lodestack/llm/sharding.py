"""Byte-balanced shards by differencing (Karmarkar and Karp).

Units with equal texts form one indivisible group. A partial partition holds k loads; the two with the largest spread (most
minus least load) are combined again and again, the heaviest load of one onto the lightest of the other, until one is left.
Groups are dealt over blocks of bounded size by digest; each block is differenced in a task of its own and leaves one
partial partition, and those are differenced again, block by block, until one remains. Positions are then resolved from
the top down with joins.

A group of copies larger than one shard's share cannot stay whole under this law; it is cut by id into pieces of about a
thirty-second of a share. There are fewer such groups than shards.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRST_BLOCK = 65_536
NEXT_BLOCK = 4_096


def difference(units: list[list[int]], k: int) -> list[list[int]]:
    """For each unit (its loads, at most k) the place, 0 to k-1, that each load gets in the combined partition.

    Place 0 is the heaviest. Equal spreads are taken in the order given.
    """
    if not units:
        return []
    loads: list[list[int]] = []
    orders: list[list[int]] = []
    heap: list[tuple[int, int]] = []
    for n, unit in enumerate(units):
        padded = [*unit, *[0] * (k - len(unit))]
        order = sorted(range(k), key=lambda i: -padded[i])
        loads.append([padded[i] for i in order])
        orders.append(order)
        heap.append((loads[n][-1] - loads[n][0], n))
    heapq.heapify(heap)
    pairs: list[tuple[int, int]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        sums = [x + y for x, y in zip(loads[a], reversed(loads[b]))]
        order = sorted(range(k), key=lambda i: -sums[i])
        loads[a] = loads[b] = []
        loads.append(merged := [sums[i] for i in order])
        orders.append(order)
        pairs.append((a, b))
        heapq.heappush(heap, (merged[-1] - merged[0], len(loads) - 1))
    places: list[list[int]] = [[]] * len(loads)
    places[-1] = list(range(k))
    for n in range(len(loads) - 1, len(units) - 1, -1):
        by_sum = [0] * k
        for place, i in zip(places[n], orders[n]):
            by_sum[i] = place
        a, b = pairs[n - len(units)]
        places[a], places[b], places[n] = by_sum, by_sum[::-1], []
    out = []
    for n, unit in enumerate(units):
        own = [0] * k
        for place, i in zip(places[n], orders[n]):
            own[i] = place
        out.append(own[: len(unit)])
    return out


def _block(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one block: its number of rows is bounded
        if not sum(batch.num_rows for batch in held):
            return
        table = pa.Table.from_batches(held).sort_by([("unit", "ascending")])
        places = difference(table["loads"].to_pylist(), k)
        block = TaskContext.get().partitionId()
        table = table.append_column("block", pa.array([block] * table.num_rows, pa.int64()))
        table = table.append_column("places", pa.array(places, pa.list_(pa.int32())))
        yield from table.combine_chunks().to_batches(max_chunksize=8_192)

    return run


def _level(units: DataFrame, k: int, blocks: int) -> DataFrame:
    """(unit, loads) to (unit, loads, block, places)."""
    dealt = units.repartition(blocks, "unit") if blocks > 1 else units.coalesce(1)
    return dealt.mapInArrow(_block(k), "unit string, loads array<bigint>, block bigint, places array<int>")


def _partial(level: DataFrame, k: int) -> DataFrame:
    """One unit per block: its k loads by place."""
    spread = level.select("block", F.explode(F.arrays_zip("places", "loads")).alias("x"))
    sums = spread.groupBy("block", F.col("x.places").alias("place")).agg(F.sum("x.loads").alias("load"))
    by_place = F.map_from_entries(F.collect_list(F.struct("place", "load")))
    return sums.groupBy("block").agg(by_place.alias("m")).select(
        F.col("block").cast("string").alias("unit"),
        F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("loads"),
    )


def assign_groups(groups: DataFrame, k: int, count: int, scratch, partitions: int) -> DataFrame:
    """(unit string, loads array of one size), one row per group, to (unit, shard)."""
    levels = [scratch.put(_level(groups, k, max(partitions, math.ceil(count / FIRST_BLOCK))))]
    while (blocks := levels[-1].select("block").distinct().count()) > 1:
        levels.append(scratch.put(_level(_partial(levels[-1], k), k, math.ceil(blocks / NEXT_BLOCK))))
    top = levels.pop().select("unit", "places")
    while levels:
        here = levels.pop().select("unit", "block", "places").alias("h")
        joined = here.join(top.alias("t"), F.col("h.block").cast("string") == F.col("t.unit"))
        top = joined.select("h.unit", F.transform("h.places", lambda p: F.element_at(F.col("t.places"), p + 1)).alias("places"))
    return top.select("unit", F.col("places")[0].alias("shard"))


def shard_documents(docs: DataFrame, scratch, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null under this law), unit.

    Size is the text's UTF-8 bytes plus 8. A null text has size 8, checksum 0 and forms one group with other nulls; an
    empty one likewise, apart from nulls. Slots number a shard's rows from 0 in the order of hashed, then plain id; rows that
    agree in id, size and checksum are interchangeable and may swap slots. Rows of one id that repeat stay in one piece of a
    cut group. A null id is an id of its own. An empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = F.col(text).cast("binary")
    rows = scratch.put(
        docs.select(
            F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long").alias("size"),
            F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"), F.coalesce(F.sha2(raw, 256), F.lit("null")).alias("digest"),
        )
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    total, rows_total = rows.agg(F.sum("size"), F.count("*")).first()
    share = max(1, (total or 0) // shards)
    # fewer groups than shards can be larger than a share
    large = groups.where(F.col("bytes") > share).select("digest", F.ceil(F.col("bytes") * 32 / F.lit(share)).alias("pieces"))
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).otherwise(F.lit(0))
    keyed = rows.join(F.broadcast(large), "digest", "left").withColumn("unit", F.concat_ws("-", "digest", piece.cast("string")))
    units = scratch.put(keyed.groupBy("unit").agg(F.sum("size").alias("bytes")).select("unit", F.array("bytes").alias("loads")))
    placed = scratch.put(assign_groups(units, shards, units.count(), scratch, partitions))
    buckets = max(8, partitions // 4, math.ceil((rows_total or 0) / shards / FIRST_BLOCK))
    placed_rows = scratch.put(
        keyed.join(placed, "unit").select("doc_id", "size", "text_crc32", "unit", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int").alias("bucket"))
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed_rows.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id", "text_crc32", "size")
    numbered = placed_rows.withColumn("n", F.row_number().over(within)).join(starts, ["shard", "bucket"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("n") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "unit",
    )
