"""Session settings the library expects, and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Whether Spark removes the shuffled rows of a query when it ends; otherwise they stay until the driver collects its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "lodestack", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; `conf` uses `__` for dots, e.g. `spark__driver__memory="8g"`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder named by the cluster. Only a local session without one gets its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="lodestack-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def cut_lineage(df: DataFrame, **options) -> DataFrame:
    """The rows written to the shared folder and read back, so that a lost executor does not replay earlier rounds.

    Unlike a checkpointed frame, a written one carries no constraints of its old plan; in a loop those grow with every
    round and slow the planning down. What was shuffled for the rows is dropped once they are written. `options` are those of the writer.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.options(**options).parquet(folder)
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(folder)


def drop_cut(*frames: DataFrame) -> None:
    """Removes the folders that `cut_lineage` wrote for these frames; nothing may read them any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {os.path.dirname(file) for file in df.inputFiles()}:
            if os.path.basename(folder).startswith("cut-"):
                where = spark._jvm.org.apache.hadoop.fs.Path(folder)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
