"""Tables that grow by a folder per micro-batch, and folding the old folders into one.

Below a table's folder lie `batch=<n>` folders and, once it was folded, `_folded`: a base of all batches up to a number,
and a manifest that names both. Readers take the base and only the batches after it, so a batch that is replayed after it
was folded changes nothing. The manifest is switched last, and what a fold replaced is removed by the fold after it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.sources.tables import file_system, read_pointer, switch_pointer


def _manifest(spark: SparkSession, out: str) -> dict:
    text = read_pointer(spark, f"{out}/_folded")
    return json.loads(text) if text else {"base": None, "upto": -1, "before": []}


def _batches(spark: SparkSession, out: str) -> list[tuple[int, bool]]:
    """(number, whether its write ended) of every batch folder, in order."""
    where, system = file_system(spark, out)
    if not system.exists(where):
        return []
    names = [e.getPath().getName() for e in system.listStatus(where)]
    numbers = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
    return [(n, system.exists(file_system(spark, f"{out}/batch={n}/_SUCCESS")[0])) for n in numbers]


def read_batches(spark: SparkSession, out: str, schema: str | None = None, before: int | None = None) -> DataFrame | None:
    """All rows of the table with their `batch`; with `before` only those of earlier batches. None if there are no batches yet.

    Rows of a base have the number of the batch they came with, or after a fold that merged rows the last one folded.
    """
    known = _manifest(spark, out)
    reader = spark.read.schema(schema) if schema else spark.read
    live = [f"{out}/batch={n}" for n, _ in _batches(spark, out) if n > known["upto"] and (before is None or n < before)]
    frames = [reader.parquet(f"{out}/_folded/{known['base']}")] if known["base"] else []
    if live:
        frames.append(reader.option("basePath", out).parquet(*live))
    if not frames:
        return None
    rows = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    return rows if before is None else rows.where(F.col("batch") < before)


def fold_batches(spark: SparkSession, out: str, merge: Callable[[DataFrame], DataFrame] | None = None, files: int = 1) -> int:
    """Folds the base and all complete batches but the last, which may still be replayed, into a new base of `files` files.

    `merge` reduces the rows (without `batch`) to those that readers need, in the same columns; without it all rows stay, each with its
    batch. Returns how many batches were folded. Only one fold of a table may run at a time; its stream may go on.
    """
    known = _manifest(spark, out)
    numbers = _batches(spark, out)
    waiting = [n for n, _ in numbers if n > known["upto"]][:-1]
    ended = dict(numbers)
    # up to the first that has not ended
    ready = waiting[: next((i for i, n in enumerate(waiting) if not ended[n]), len(waiting))]
    if not ready:
        return 0
    rows = read_batches(spark, out, before=ready[-1] + 1)
    if merge:
        rows = merge(rows.drop("batch")).withColumn("batch", F.lit(ready[-1]))
    base = f"base-{uuid.uuid4().hex}"
    rows.coalesce(files).write.parquet(f"{out}/_folded/{base}")
    replaced = [f"batch={n}" for n in ready] + ([f"_folded/{known['base']}"] if known["base"] else [])
    switch_pointer(spark, f"{out}/_folded", json.dumps({"base": base, "upto": ready[-1], "before": replaced}))
    for name in known["before"]:
        where, system = file_system(spark, f"{out}/{name}")
        system.delete(where, True)
    return len(ready)
