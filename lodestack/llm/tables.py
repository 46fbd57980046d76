"""Tables in the shared folder that cut lineage, and reading the given tables."""

from __future__ import annotations

import ctypes
import gc
import sys
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestack.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written tables of one operator call: `put` writes and rereads, `drop` deletes what is no longer needed.

    They lie in the folder that `spark.checkpoint.dir` names, so losing an executor loses none of them. What a returned
    frame still reads must not be dropped.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame, files: int | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        (df.coalesce(files) if files else df).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            for path in {f.rpartition("/")[0] for f in frame.inputFiles()}:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh_name(name: str, taken: list[str]) -> str:
    """The name, or one made longer that no column has in any spelling."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def releasing(run: Callable) -> Callable:
    """The function for mapInArrow, returning to the system, after each task, the memory that its worker keeps but doesn't use."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _release()

    return released


def _give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches
    if bpe := sys.modules.get("lodestack.llm.bpe"):
        bpe.codec.cache_clear()
    gc.collect()
    _release()
    time.sleep(0.05)  # so that tasks spread over all workers


def give_back_memory(spark: SparkSession) -> None:
    """Lets the Python workers, which Spark uses again, return what earlier jobs left in them: caches and freed memory."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).mapInArrow(_give_back, "id bigint").write.format("noop").mode("overwrite").save()
