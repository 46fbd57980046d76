"""Keyed metadata tables: upserts, content-hash staging, pending work and job states.

The newest record of a key is picked with `max_by`, which combines before the shuffle; a key that fills a third of a log
costs one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.session import cut_lineage

WAITING = ("new", "queued")


def latest(df: DataFrame, keys: Sequence[str], order_by: str | Sequence[str]) -> DataFrame:
    """The last row per key; columns keep their order."""
    order = F.struct(*([order_by] if isinstance(order_by, str) else order_by))
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """`new` replaces `old` by key, except that a `keep` column keeps its old value when there is one.

    `new` must be unique by key (`latest` makes it so). One hash exchange per side.
    """
    marked = new.withColumn("_new", F.lit(True))
    joined = old.alias("o").join(marked.alias("n"), list(keys), "full_outer")
    replaced = F.col("n._new").isNotNull()

    def value(column: str) -> Column:
        mine, theirs = F.col(f"o.{column}"), F.col(f"n.{column}")
        if column in keep:
            return F.coalesce(mine, theirs).alias(column)
        return F.when(replaced, theirs).otherwise(mine).alias(column)

    return joined.select(*[F.col(c) if c in keys else value(c) for c in old.columns])


def upsert_files(old: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """By file_id; created_at stays, updated_at becomes `now` (default: the current time)."""
    stamped = new.withColumn("updated_at", F.current_timestamp() if now is None else now)
    return upsert(old, stamped, ["file_id"], keep=["created_at"])


def upsert_jobs(old: DataFrame, new: DataFrame, now: Column | None = None, keep_started: bool = False) -> DataFrame:
    """By job_id, as for files. A record without started_at or extra blanks them unless `keep_started`."""
    stamped = new.withColumn("updated_at", F.current_timestamp() if now is None else now)
    if not keep_started:
        return upsert(old, stamped, ["job_id"], keep=["created_at"])
    started = old.select("job_id", F.col("started_at").alias("_started"))
    filled = stamped.join(started, "job_id", "left").withColumn("started_at", F.coalesce("started_at", "_started"))
    return upsert(old, filled.drop("_started"), ["job_id"], keep=["created_at"])


def upsert_knowledge(old: DataFrame, new: DataFrame) -> DataFrame:
    """By knowledge_id; everything is replaced, created_at too."""
    return old.join(new.select("knowledge_id"), "knowledge_id", "left_anti").select(old.columns).unionByName(new.select(old.columns))


def upsert_mappings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunk mappings by (input_file_hash, chunk_order). Higher orders of an earlier load are not deleted."""
    keys = ["input_file_hash", "chunk_order"]
    kept = old.join(new.select(*keys), keys, "left_anti")
    return kept.select(old.columns).unionByName(new.select(old.columns))


def align_chunks(records: DataFrame, chunks: DataFrame, keys: Sequence[str] = ("input_file_hash", "chunk_order")) -> DataFrame:
    """Ingest records with the text of their chunk."""
    return records.join(chunks.select(*keys, "chunk"), list(keys))


def write_mappings(mappings: DataFrame, path: str) -> str:
    """Loads mappings into the table at `path`, partitioned by hash prefix: only prefixes present in `mappings` are rewritten,
    and their other rows stay."""
    spark = mappings.sparkSession
    rows = mappings.withColumn("prefix", F.substring("input_file_hash", 1, 2))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        stored = spark.read.schema(rows.schema).parquet(path)
        touched = stored.join(rows.select("prefix").distinct(), "prefix", "left_semi")
        # Written elsewhere first, since the prefixes read are those that are replaced.
        rows = cut_lineage(upsert_mappings(touched, rows))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(path)
    return path


def find_by_hash(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """First file per (user, file_hash, file_type) of `wanted`, oldest first."""
    keys = ["user", "file_hash", "file_type"]
    return _first(files.join(wanted.select(*keys).distinct(), keys, "left_semi"), keys, ["created_at", "file_id"])


def _first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order_by)).alias("_row"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def merge_maps(stored: Column, given: Column) -> Column:
    """Both maps; a key of `given` wins."""
    mine = F.map_filter(stored, lambda key, _: ~F.map_contains_key(given, key))
    return F.map_concat(mine, given)


def stage_files(files: DataFrame, uploads: DataFrame, now: Column | None = None) -> DataFrame:
    """The files table after a batch of uploads, deduplicated by (user, file_hash, file_type).

    A known content keeps its id and paths and takes the last upload's business_context; a new one takes the first
    upload's fields. Metadata merge in arrival order, later keys winning. `uploads` has the files columns but
    created_at / updated_at, plus `arrived`. The metadata of one content are merged per key, never as one list.
    """
    now = F.current_timestamp() if now is None else now
    keys = ["user", "file_hash", "file_type"]
    arrived = [c for c in uploads.columns if c not in keys]
    batch = uploads.groupBy(*keys).agg(
        F.min_by(F.struct(*arrived), "arrived").alias("first"),
        F.max_by("business_context", "arrived").alias("context"),
    )
    entries = uploads.select(*keys, "arrived", F.explode("extra").alias("key", "value"))
    extras = (
        entries.groupBy(*keys, "key")
        .agg(F.max_by("value", "arrived").alias("value"))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("given"))
    )
    none = F.create_map().cast("map<string,string>")
    stored = find_by_hash(files, uploads)
    rest = [c for c in files.columns if c not in keys]
    merged = batch.join(extras, keys, "left").join(stored.select(*keys, F.struct(*rest).alias("old")), keys, "left")
    known = F.col("old").isNotNull()

    def value(column: str) -> Column:
        if column == "business_context":
            return F.col("context")
        if column == "extra":
            return merge_maps(F.coalesce("old.extra", none), F.coalesce("given", none))
        if column == "updated_at":
            return now
        if column == "created_at":
            return F.coalesce("old.created_at", now)
        return F.when(known, F.col(f"old.{column}")).otherwise(F.col(f"first.{column}"))

    changed = merged.select(*[F.col(c) if c in keys else value(c).alias(c) for c in files.columns])
    kept = files.join(changed.select("file_id"), "file_id", "left_anti")
    return kept.select(files.columns).unionByName(changed)


def pending_work(requests: DataFrame, artifacts: DataFrame, keys: Sequence[str], stages: Sequence[str] = ()) -> DataFrame:
    """Requests whose artifact is absent. With `stages`, one row per missing (request, stage)."""
    if not stages:
        return requests.join(artifacts.select(*keys), list(keys), "left_anti")
    wanted = requests.withColumn("stage", F.explode(F.array(*[F.lit(s) for s in stages])))
    return wanted.join(artifacts.select(*keys, "stage"), [*keys, "stage"], "left_anti")


def job_states(log: DataFrame) -> DataFrame:
    """One row per job from its state log (job_id, state, at, error): last state, first and last times, last error."""
    at = F.col("at")
    return log.groupBy("job_id").agg(
        F.max_by("state", F.struct("at", "state")).alias("state"),
        F.min(at).alias("created_at"),
        F.min(F.when(F.col("state") == "active", at)).alias("started_at"),
        F.max(F.when(F.col("state").isin("complete", "failed"), at)).alias("finished_at"),
        F.max(at).alias("updated_at"),
        F.max_by("error", F.struct("at", "state")).alias("error"),
    )


def job_counts(jobs: DataFrame) -> DataFrame:
    """One row: queued (new or queued), active, incomplete (all three)."""
    status = F.col("status")
    return jobs.agg(
        F.count_if(status.isin(*WAITING)).alias("queued"),
        F.count_if(status == "active").alias("active"),
        F.count_if(status.isin(*WAITING, "active")).alias("incomplete"),
    )


def job_page(jobs: DataFrame, offset: int = 0, limit: int = 10) -> DataFrame:
    """Waiting jobs, oldest first."""
    return jobs.where(F.col("status").isin(*WAITING)).orderBy("queued", "key").offset(offset).limit(limit)


def jobs_with_status(jobs: DataFrame, statuses: Sequence[str]) -> DataFrame:
    return jobs.where(F.col("status").isin(*statuses))


UPLOAD_EXTENSIONS: Mapping[str, str] = {"pdf": ".pdf", "csv": ".csv", "sqlite": ".sqlite"}


def validate_uploads(uploads: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Adds `valid` and `reason` to uploads (upload_type, source_path, schema_sql_path).

    `existing(path)` is an optional listing of the files that are there.
    """

    def ends(path: str, suffix: Column | str) -> Column:
        return F.endswith(F.lower(path), suffix if isinstance(suffix, Column) else F.lit(suffix))

    df = uploads
    for path, flag in (("source_path", "_source_there"), ("schema_sql_path", "_schema_there")):
        if existing is None:
            df = df.withColumn(flag, F.lit(True))
        else:
            there = existing.select(F.col("path").alias(path), F.lit(True).alias(flag)).distinct()
            df = df.join(there, path, "left")
    suffixes = F.create_map(*[F.lit(x) for pair in UPLOAD_EXTENSIONS.items() for x in pair])
    suffix = F.try_element_at(suffixes, F.col("upload_type"))
    sqlite = F.col("upload_type") == "sqlite"
    no_schema = F.coalesce("schema_sql_path", F.lit("")) == ""
    reason = (
        F.when(suffix.isNull(), "unknown upload type")
        .when(F.col("_source_there").isNull(), "source file not found")
        .when(~ends("source_path", suffix), "invalid extension")
        .when(sqlite & no_schema, "schema_sql_path is required for sqlite uploads")
        .when(sqlite & F.col("_schema_there").isNull(), "schema file not found")
        .when(sqlite & ~ends("schema_sql_path", ".sql"), "schema_sql_path must point to a .sql file")
    )
    checked = df.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
    return checked.select(*uploads.columns, "valid", "reason")
