"""Incremental flows. Each micro-batch overwrites its own `batch=<n>` folder, so a replayed batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lodestack.operators.logs import is_agent_message
from lodestack.operators.metadata import job_states, latest
from lodestack.session import cut_lineage
from lodestack.sources.csv import read_typed
from lodestack.sources.files import with_hashes
from lodestack.streaming.compaction import fold_batches, read_batches


def _folder(path: str, batch: int) -> str:
    return f"{path}/batch={batch}"


def stream_csv_drops(
    spark: SparkSession, drops: str, schema: T.StructType, user: str, out: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """New CSV files are hashed; contents not yet in the catalog of `user` are typed and written once, and every arrival is
    logged. `out/files` is the catalog, `out/rows` holds the typed rows by file_id, `out/arrivals` the arrivals.

    Files share one schema and have a header. Digests read files as streams and rows are read by ranges of files, quoted line
    breaks or not.
    """
    source = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", "*.csv")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(drops)
    )
    catalog = f"{out}/files"

    def load(batch: DataFrame, number: int) -> None:
        names = cut_lineage(with_hashes(batch))
        first = names.groupBy("file_hash").agg(F.min("path").alias("path"), F.min_by("length", "path").alias("file_size"))
        known = read_batches(spark, catalog, "file_hash string, user string, batch int", before=number)
        if known is not None:
            first = first.join(known.where(F.col("user") == user).select("file_hash"), "file_hash", "left_anti")
        record = first.select(
            F.concat(F.substring("file_hash", 1, 12), F.lit("-"), F.substring(F.sha2("path", 256), 1, 32)).alias("file_id"),
            F.lit(user).alias("user"),
            F.lit("csv").alias("file_type"),
            F.element_at(F.split("path", "/"), -1).alias("original_filename"),
            "path",
            "file_hash",
            "file_size",
        )
        record.write.mode("overwrite").parquet(_folder(catalog, number))
        # What arrived under which name, known contents too: the latest arrival of a hash gives its current name.
        seen = names.withColumn("user", F.lit(user)).withColumn("seen_at", F.current_timestamp())
        seen.write.mode("overwrite").parquet(_folder(f"{out}/arrivals", number))
        written = spark.read.schema(record.schema).parquet(_folder(catalog, number)).select("path", "file_id")
        paths = [row.path for row in written.select("path").collect()]  # at most `files_per_batch`
        if paths:
            typed = read_typed(spark, paths, schema).withColumnRenamed("file", "_path")
            named = typed.join(written.withColumnRenamed("path", "_path"), "_path").select("file_id", *schema.names)
            named.write.mode("overwrite").parquet(_folder(f"{out}/rows", number))

    return source.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dropped_rows(spark: SparkSession, out: str) -> DataFrame:
    """The typed rows of all dropped files, with file_id."""
    return read_batches(spark, f"{out}/rows").drop("batch")


def fold_drops(spark: SparkSession, out: str, files: int = 1) -> int:
    """Folds earlier batches of catalog, arrivals and rows into `files` files each; the number of catalog batches folded."""
    return [fold_batches(spark, f"{out}/{part}", None, files) for part in ("files", "arrivals", "rows")][0]


def stream_job_states(states: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's summary per job (job_id, state, at, error). `current_jobs` merges the batches on reading,
    so no batch rewrites the table."""

    def load(batch: DataFrame, number: int) -> None:
        job_states(batch).write.mode("overwrite").parquet(_folder(out, number))

    return states.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_jobs(spark: SparkSession, out: str) -> DataFrame:
    """One row per job over all batches, as `job_states` over the whole log would give."""
    return _merged_jobs(read_batches(spark, out))


def fold_jobs(spark: SparkSession, out: str, files: int = 1) -> int:
    """Folds earlier batches into one row per job."""
    return fold_batches(spark, out, _merged_jobs, files)


def _merged_jobs(parts: DataFrame) -> DataFrame:
    last = F.struct("updated_at", "state")
    return parts.groupBy("job_id").agg(
        F.max_by("state", last).alias("state"),
        F.min("created_at").alias("created_at"),
        F.min("started_at").alias("started_at"),
        F.max("finished_at").alias("finished_at"),
        F.max("updated_at").alias("updated_at"),
        F.max_by("error", last).alias("error"),
    )


def stream_final_messages(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's last agent message per run; `current_final_messages` merges the batches on reading, so no state
    is kept between them."""

    def load(batch: DataFrame, number: int) -> None:
        newest = batch.where(is_agent_message()).groupBy("run_id").agg(F.max(F.struct("seq", "text")).alias("m"))
        found = newest.select("run_id", F.col("m.seq").alias("seq"), F.col("m.text").alias("final_message"))
        found.write.mode("overwrite").parquet(_folder(out, number))

    return events.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_final_messages(spark: SparkSession, out: str) -> DataFrame:
    """The last message of each run over all batches."""
    return _last_messages(read_batches(spark, out).drop("batch"))


def fold_final_messages(spark: SparkSession, out: str, files: int = 1) -> int:
    """Folds earlier batches into one row per run."""
    return fold_batches(spark, out, _last_messages, files)


def _last_messages(parts: DataFrame) -> DataFrame:
    return latest(parts, ["run_id"], "seq")
