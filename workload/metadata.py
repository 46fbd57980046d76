"""Metadata tables: upserts, content deduplication, pending work, jobs and uploads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.casts import with_file_id
from lodestack.operators import metadata as md
from lodestack.session import shared_folder
from lodestack.sources.tables import list_datasets as listed
from lodestack.sources.tables import read_dataset as find_and_read
from workload.registry import query, table

NOW = "TIMESTAMP '2030-01-01 00:00:00'"


def now():
    return F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")


# Stored records are the customers; the new ones are made from the order lines of parts with the same numbers.
def customer_files(spark, sf_dir) -> DataFrame:
    opened = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("updated_at"))
    return table(spark, sf_dir, "customer").join(opened, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("file_id"), F.col("c_name").alias("original_filename"), F.col("c_mktsegment").alias("business_context"), "created_at", "updated_at"
    )


def part_files(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_shipdate").alias("created_at"), F.max("l_shipdate").alias("updated_at"))
    return table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").alias("file_id"), F.col("p_name").alias("original_filename"), F.col("p_brand").alias("business_context"), "created_at", "updated_at"
    )


UPSERT_SQL = f"""
WITH o AS (SELECT c_custkey AS file_id, c_name AS original_filename, c_mktsegment AS business_context, min(o_orderdate) AS created_at,
  max(o_orderdate) AS updated_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
n AS (SELECT p_partkey AS file_id, p_name AS original_filename, p_brand AS business_context, min(l_shipdate) AS created_at,
  {NOW} AS updated_at FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_name, p_brand)
"""


@query(UPSERT_SQL + """
SELECT file_id, CASE WHEN n.file_id IS NULL THEN o.original_filename ELSE n.original_filename END AS original_filename,
  CASE WHEN n.file_id IS NULL THEN o.business_context ELSE n.business_context END AS business_context,
  coalesce(o.created_at, n.created_at) AS created_at, coalesce(n.updated_at, o.updated_at) AS updated_at
FROM o FULL JOIN n USING (file_id)""")
def upsert_keep_created(spark, sf_dir):
    return md.upsert_files(customer_files(spark, sf_dir), part_files(spark, sf_dir), now())


JOBS = {"file_id": "job_id", "original_filename": "state", "business_context": "started_at"}


@query(UPSERT_SQL + """
SELECT file_id AS job_id, CASE WHEN n.file_id IS NULL THEN o.original_filename ELSE n.original_filename END AS state,
  CASE WHEN n.file_id IS NULL THEN o.business_context
       ELSE coalesce(CASE WHEN n.business_context < 'Brand#2' THEN n.business_context END, o.business_context) END AS started_at,
  coalesce(o.created_at, n.created_at) AS created_at, coalesce(n.updated_at, o.updated_at) AS updated_at
FROM o FULL JOIN n USING (file_id)""")
def upsert_jobs_keep_started(spark, sf_dir):
    new = part_files(spark, sf_dir).withColumnsRenamed(JOBS)
    new = new.withColumn("started_at", F.when(F.col("started_at") < "Brand#2", F.col("started_at")))
    return md.upsert_jobs(customer_files(spark, sf_dir).withColumnsRenamed(JOBS), new, now(), keep_started=True)


@query(UPSERT_SQL + """
SELECT file_id AS job_id, CASE WHEN n.file_id IS NULL THEN o.original_filename ELSE n.original_filename END AS state,
  CASE WHEN n.file_id IS NULL THEN o.business_context WHEN n.business_context < 'Brand#2' THEN n.business_context END AS started_at,
  coalesce(o.created_at, n.created_at) AS created_at, coalesce(n.updated_at, o.updated_at) AS updated_at
FROM o FULL JOIN n USING (file_id)""")
def upsert_jobs_blank_started(spark, sf_dir):
    new = part_files(spark, sf_dir).withColumnsRenamed(JOBS)
    new = new.withColumn("started_at", F.when(F.col("started_at") < "Brand#2", F.col("started_at")))
    return md.upsert_jobs(customer_files(spark, sf_dir).withColumnsRenamed(JOBS), new, now())


@query(UPSERT_SQL + """
SELECT file_id AS knowledge_id, original_filename AS query, created_at FROM n
UNION ALL SELECT file_id, original_filename, created_at FROM o ANTI JOIN n USING (file_id)""")
def upsert_knowledge(spark, sf_dir):
    names = {"file_id": "knowledge_id", "original_filename": "query"}
    keep = lambda df: df.withColumnsRenamed(names).select("knowledge_id", "query", "created_at")
    return md.upsert_knowledge(keep(customer_files(spark, sf_dir)), keep(part_files(spark, sf_dir)))


# Mappings of the documents' lines; the pages are a second load of files with the same numbers.
def _mappings(df: DataFrame, key: str, text: str, separator: str) -> DataFrame:
    lines = df.select(F.concat(F.lit("h"), F.col(key).cast("string")).alias("input_file_hash"), F.posexplode(F.split(text, separator)).alias("chunk_order", "chunk"))
    return lines.withColumn("chunk_id", F.concat_ws("-", F.lit(key), "input_file_hash", F.col("chunk_order").cast("string")))


MAPPING_SQL = """SELECT 'h' || {k} AS input_file_hash, (i - 1)::INTEGER AS chunk_order, parts[i] AS chunk, '{k}-h' || {k} || '-' || (i - 1) AS chunk_id
 FROM (SELECT {k}, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT {k}, string_split({c}, {s}) AS parts FROM {t}))"""


@query(f"""
WITH o AS ({MAPPING_SQL.format(k='doc_id', c='text', s='chr(10)', t='documents')}), n AS ({MAPPING_SQL.format(k='page_id', c='html', s="'<p>'", t='pages')})
SELECT * FROM n UNION ALL SELECT * FROM o ANTI JOIN n USING (input_file_hash, chunk_order)""")
def upsert_mappings(spark, sf_dir):
    old = _mappings(table(spark, sf_dir, "documents"), "doc_id", "text", "\n")
    return md.upsert_mappings(old, _mappings(table(spark, sf_dir, "pages"), "page_id", "html", "<p>"))


@query(f"""
WITH o AS ({MAPPING_SQL.format(k='doc_id', c='text', s='chr(10)', t='documents')}), n AS ({MAPPING_SQL.format(k='page_id', c='html', s="'<p>'", t='pages')})
SELECT * FROM n UNION ALL SELECT * FROM o ANTI JOIN n USING (input_file_hash, chunk_order)""")
def load_mappings(spark, sf_dir):
    """The table on disk after a first load and a second one that shares hash prefixes with it."""
    path = f"{shared_folder(spark)}/mappings-{uuid.uuid4().hex}"
    md.write_mappings(_mappings(table(spark, sf_dir, "documents"), "doc_id", "text", "\n"), path)
    md.write_mappings(_mappings(table(spark, sf_dir, "pages"), "page_id", "html", "<p>"), path)
    return spark.read.parquet(path).drop("prefix")


# Records of every second chunk, and of chunks that are not there.
@query(f"""
WITH c AS ({MAPPING_SQL.format(k='doc_id', c='text', s='chr(10)', t='documents')})
SELECT input_file_hash, chunk_order, 'new-' || input_file_hash || '-' || chunk_order AS record_id, chunk FROM c WHERE chunk_order % 2 = 1""")
def align_chunks(spark, sf_dir):
    chunks = _mappings(table(spark, sf_dir, "documents"), "doc_id", "text", "\n")
    order = F.col("chunk_order")
    known = chunks.where(order % 2 == 1)
    unknown = chunks.withColumn("chunk_order", -1 - order)
    ids = known.unionByName(unknown).select("input_file_hash", "chunk_order")
    records = ids.withColumn("record_id", F.concat_ws("-", F.lit("new"), "input_file_hash", order.cast("string")))
    return md.align_chunks(records, chunks)


@query("SELECT * FROM part")
def read_dataset(spark, sf_dir):
    """An artifact of a user looked up in the catalog; another user has a file of the same id."""
    path = f"{shared_folder(spark)}/artifact-{uuid.uuid4().hex}"
    table(spark, sf_dir, "part").write.parquet(path)
    catalog = spark.createDataFrame([("f1", "a", "sql", "part", path), ("f1", "b", "sql", "other", f"{path}-other")], "file_id string, user string, file_type string, original_filename string, artifact_path string")
    return find_and_read(catalog, "f1", "a")


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))


@query("""SELECT doc_id, substring(sha256(text), 1, 12) || '-' || substring(sha256(doc_id::VARCHAR), 1, 32) AS file_id FROM documents""")
def file_ids(spark, sf_dir):
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    return with_file_id(hashed, key="doc_id").drop("file_hash")


def _uploads(docs: DataFrame) -> DataFrame:
    extra = F.create_map(F.lit("source"), "source", F.concat(F.lit("len"), (F.col("n_chars") % 10).cast("string")), F.col("doc_id").cast("string"))
    return docs.select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_id"),
        F.lit("u").alias("user"),
        F.col("lang").alias("file_type"),
        F.sha2("text", 256).alias("file_hash"),
        F.col("source").alias("business_context"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("original_path"),
        extra.alias("extra"),
        F.col("doc_id").alias("arrived"),
    )


@query(f"""
WITH u AS (SELECT 'f' || doc_id AS file_id, lang AS file_type, sha256(text) AS file_hash, source, source || '/' || doc_id AS path, doc_id,
  'len' || (n_chars % 10) AS k FROM documents),
s AS (SELECT u.*, TIMESTAMP '2020-01-01 00:00:00' AS created_at FROM u SEMI JOIN (SELECT doc_id FROM labels WHERE toxic = 0) USING (doc_id)),
first_s AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY file_type, file_hash ORDER BY file_id) = 1),
g AS (SELECT file_type, file_hash, arg_min(file_id, doc_id) AS file_id, arg_min(path, doc_id) AS path, arg_max(source, doc_id) AS context FROM u GROUP BY ALL),
e AS (SELECT file_type, file_hash, k, max(doc_id)::VARCHAR AS v FROM u GROUP BY ALL
      UNION ALL SELECT file_type, file_hash, 'source', arg_max(source, doc_id) FROM u GROUP BY ALL),
m AS (SELECT file_type, file_hash, string_agg(k || '=' || v, ';' ORDER BY k) AS extra FROM e GROUP BY ALL)
SELECT coalesce(f.file_id, g.file_id) AS file_id, 'u' AS user, file_type, file_hash, g.context AS business_context,
  coalesce(f.path, g.path) AS original_path, extra, coalesce(f.created_at, {NOW}) AS created_at, {NOW} AS updated_at
FROM g JOIN m USING (file_type, file_hash) LEFT JOIN first_s f USING (file_type, file_hash)
UNION ALL SELECT file_id, 'u', file_type, file_hash, source, path, k || '=' || doc_id || ';source=' || source, created_at, created_at
FROM s WHERE file_id NOT IN (SELECT file_id FROM first_s)""")
def content_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    clean = table(spark, sf_dir, "labels").where(F.col("toxic") == 0)
    early = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    files = _uploads(docs.join(clean, "doc_id", "left_semi")).drop("arrived").withColumns({"created_at": early, "updated_at": early})
    staged = md.stage_files(files, _uploads(docs), now())
    pairs = F.transform(F.array_sort(F.map_entries("extra")), lambda p: F.concat(p["key"], F.lit("="), p["value"]))
    return staged.withColumn("extra", F.array_join(pairs, ";"))


@query("""
WITH s AS (SELECT doc_id, unnest(['pre', 'post', 'ingest']) AS stage FROM documents),
a AS (SELECT doc_id, 'pre' AS stage FROM labels UNION ALL SELECT doc_id, 'post' FROM labels WHERE quality = 1
      UNION ALL SELECT doc_id, 'ingest' FROM labels WHERE quality = 1 AND toxic = 0)
SELECT doc_id, stage FROM s ANTI JOIN a USING (doc_id, stage)""")
def pending_work(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    good = F.col("quality") == 1
    done = [labels.select("doc_id", F.lit("pre").alias("stage")), labels.where(good).select("doc_id", F.lit("post").alias("stage"))]
    done.append(labels.where(good & (F.col("toxic") == 0)).select("doc_id", F.lit("ingest").alias("stage")))
    artifacts = done[0].unionByName(done[1]).unionByName(done[2])
    return md.pending_work(table(spark, sf_dir, "documents").select("doc_id"), artifacts, ["doc_id"], ["pre", "post", "ingest"])


# Events as a job log: the user is the job, the event type its state.
STATE = {"signup": "new", "view": "queued", "click": "active", "purchase": "complete", "error": "failed"}
LOG_SQL = "SELECT user_id AS job_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATE.items()) + """ END AS state,
 ts AS "at", CASE WHEN event_type = 'error' THEN props END AS error FROM events"""
STATES_SQL = f"""
WITH l AS ({LOG_SQL}),
j AS (SELECT job_id, arg_max(state, "at") AS state, min("at") AS created_at, min("at") FILTER (WHERE state = 'active') AS started_at,
  max("at") FILTER (WHERE state IN ('complete', 'failed')) AS finished_at, max("at") AS updated_at FROM l GROUP BY job_id),
states AS (SELECT j.*, l.error FROM j JOIN l ON l.job_id = j.job_id AND l."at" = j.updated_at)
"""


def job_log(events: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in STATE.items() for x in pair])
    return events.select(
        F.col("user_id").alias("job_id"),
        F.try_element_at(names, F.col("event_type")).alias("state"),
        F.col("ts").alias("at"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
    )


def _states(spark, sf_dir) -> DataFrame:
    return md.job_states(job_log(table(spark, sf_dir, "events")))


@query(STATES_SQL + "SELECT * FROM states")
def latest_state(spark, sf_dir):
    return _states(spark, sf_dir)


@query(f"WITH l AS ({LOG_SQL}) SELECT job_id, state, \"at\", error FROM l QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY \"at\" DESC, state DESC) = 1")
def latest_record(spark, sf_dir):
    return md.latest(job_log(table(spark, sf_dir, "events")), ["job_id"], ["at", "state"])


def _queue(spark, sf_dir) -> DataFrame:
    return _states(spark, sf_dir).select(F.col("job_id").alias("key"), F.col("state").alias("status"), F.col("created_at").alias("queued"))


QUEUE_SQL = STATES_SQL + ", queue AS (SELECT job_id AS key, state AS status, created_at AS queued FROM states)"


@query(QUEUE_SQL + """
SELECT count(*) FILTER (WHERE status IN ('new', 'queued')) AS queued, count(*) FILTER (WHERE status = 'active') AS active,
  count(*) FILTER (WHERE status IN ('new', 'queued', 'active')) AS incomplete FROM queue""")
def job_counts(spark, sf_dir):
    return md.job_counts(_queue(spark, sf_dir))


@query(QUEUE_SQL + "SELECT * FROM queue WHERE status IN ('new', 'queued') ORDER BY queued, key LIMIT 10 OFFSET 5")
def job_page(spark, sf_dir):
    return md.job_page(_queue(spark, sf_dir), 5, 10)


@query(QUEUE_SQL + "SELECT * FROM queue WHERE status IN ('active', 'failed')")
def jobs_with_status(spark, sf_dir):
    return md.jobs_with_status(_queue(spark, sf_dir), ["active", "failed"])


@query("SELECT source AS user_id, 'f' || doc_id AS file_id, text AS original_filename FROM documents SEMI JOIN labels USING (doc_id) WHERE lang = 'en'")
def list_datasets(spark, sf_dir):
    marked = table(spark, sf_dir, "labels").select("doc_id", F.lit("x").alias("artifact_path"))
    files = table(spark, sf_dir, "documents").join(marked, "doc_id", "left").select(
        F.col("source").alias("user"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_id"),
        F.col("text").alias("original_filename"), F.col("lang").alias("file_type"), "artifact_path",
    )
    return listed(files, file_type="en")


@query("""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'pdf' WHEN contains(url, '/fr/') THEN 'csv' WHEN contains(url, '/de/') THEN 'sqlite' ELSE 'zip' END AS upload_type,
  url || CASE WHEN length(html) > 4000 THEN '.PDF' WHEN length(html) > 3000 THEN '.csv' ELSE '.sqlite' END AS source_path,
  CASE WHEN length(url) > 44 THEN 'schema.sql' WHEN length(url) > 40 THEN 'schema.txt' END AS schema_sql_path FROM pages),
r AS (SELECT *, CASE WHEN upload_type = 'zip' THEN 'unknown upload type' WHEN NOT ends_with(lower(source_path), '.' || upload_type) THEN 'invalid extension'
  WHEN upload_type = 'sqlite' AND schema_sql_path IS NULL THEN 'schema_sql_path is required for sqlite uploads'
  WHEN upload_type = 'sqlite' AND schema_sql_path <> 'schema.sql' THEN 'schema_sql_path must point to a .sql file' END AS reason FROM u)
SELECT page_id, upload_type, source_path, schema_sql_path, reason IS NULL AS valid, reason FROM r""")
def validate_uploads(spark, sf_dir):
    url, size = F.col("url"), F.length("html")
    kind = F.when(url.contains("/en/"), "pdf").when(url.contains("/fr/"), "csv").when(url.contains("/de/"), "sqlite").otherwise("zip")
    suffix = F.when(size > 4000, ".PDF").when(size > 3000, ".csv").otherwise(".sqlite")
    schema = F.when(F.length(url) > 44, "schema.sql").when(F.length(url) > 40, "schema.txt")
    uploads = table(spark, sf_dir, "pages").select("page_id", kind.alias("upload_type"), F.concat(url, suffix).alias("source_path"), schema.alias("schema_sql_path"))
    return md.validate_uploads(uploads)
