"""Ingest jobs and incremental flows. They write below the session's shared folder and read their result back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions.text import words
from lodestack.operators.embed import embed, embed_hashed
from lodestack.operators.logs import parse_events
from lodestack.operators.similarity import cosine
from lodestack.plans.csv_ingest import csv_to_parquet as convert
from lodestack.session import shared_folder
from lodestack.sources.csv import CsvJob
from lodestack.sources.files import hash_files, read_json_lines
from lodestack.sources.tables import read_snapshot, write_snapshot
from lodestack.streaming import jobs as st
from workload.logs import event_lines
from workload.metadata import STATES_SQL, job_log
from workload.registry import query, table


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate::DATE AS o_orderdate, o_orderpriority FROM orders")
def csv_to_parquet(spark, sf_dir):
    folder = fresh_folder(spark, "csv")
    table(spark, sf_dir, "orders").write.option("header", True).csv(f"{folder}/orders.csv")
    done = convert(spark, CsvJob(f"{folder}/orders.csv", folder=True))
    return spark.read.parquet(done["output_path"])


@query("SELECT doc_id, text, lang, source FROM documents")
def csv_of_texts(spark, sf_dir):
    """Texts with commas, quotes and line breaks, through a file with semicolons."""
    folder = fresh_folder(spark, "csv-texts")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    docs.write.options(header=True, sep=";", quote='"', escape='"').csv(f"{folder}/documents.csv")
    done = convert(spark, CsvJob(f"{folder}/documents.csv", folder=True, auto_cast_dates=False))
    return spark.read.parquet(done["output_path"])


@query("""SELECT c_custkey::VARCHAR AS key, c_name, c_acctbal FROM customer""")
def snapshot(spark, sf_dir):
    path = write_snapshot(table(spark, sf_dir, "customer"), "c_custkey", fresh_folder(spark, "snapshot"))
    rows = read_snapshot(spark, path, "key string, record struct<c_name: string, c_acctbal: double>")
    return rows.select("key", "record.*")


@query("""SELECT r_name AS name, sha256(n) AS file_hash FROM (SELECT r_name, string_agg(n_name, chr(10) ORDER BY n_name) || chr(10) AS n
 FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)""")
def file_hashes(spark, sf_dir):
    folder = fresh_folder(spark, "hash")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # A file per region, its nations in order.
    nations.repartition("r_name").sortWithinPartitions("r_name", "n_name").select("n_name", "r_name").write.partitionBy("r_name").text(folder)
    hashed = hash_files(spark, f"{folder}/*/*.txt")
    return hashed.select(F.regexp_extract("path", "r_name=([^/]*)/", 1).alias("name"), "file_hash")


@query("SELECT type, count(*) AS n FROM (SELECT CASE role WHEN 'user' THEN 'thread.started' ELSE 'item.completed' END AS type FROM conversations) GROUP BY type")
def json_lines(spark, sf_dir):
    folder = fresh_folder(spark, "jsonl")
    event_lines(table(spark, sf_dir, "conversations")).select("value").write.text(folder)
    events = read_json_lines(spark, folder, "type string, thread_id string")
    return events.groupBy("event.type").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::DOUBLE AS n_words, length(text)::DOUBLE AS n_chars FROM conversations""")
def embed_batches(spark, sf_dir):
    def sizes(texts):
        return [[len(t.split()), len(t)] for t in texts]

    vectors = embed(table(spark, sf_dir, "conversations"), sizes)
    return vectors.select("conv_id", "turn", F.col("vector")[0].cast("double").alias("n_words"), F.col("vector")[1].cast("double").alias("n_chars"))


@query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) > 0 AS unit, 64 AS size FROM documents""")
def embed_hashed_words(spark, sf_dir):
    vectors = embed_hashed(table(spark, sf_dir, "documents"), size=64)
    length = cosine(F.col("vector"), F.col("vector"))
    unit = (F.abs(length - 1) < 1e-6) & (F.size(words(F.col("text"))) > 0)
    return vectors.select("doc_id", unit.alias("unit"), F.size("vector").alias("size"))


DROP = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_acctbal", T.DoubleType()), T.StructField("c_mktsegment", T.StringType())])


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def stream_csv_drops(spark, sf_dir):
    drops, out, check = (fresh_folder(spark, n) for n in ("drops", "csv-out", "csv-check"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    # Every file is dropped twice, and all of them once more after the first run: each content is still written once.
    for _ in range(2):
        customers.repartition(4, "c_custkey").sortWithinPartitions("c_custkey").write.mode("append").option("header", True).csv(drops)
        st.stream_csv_drops(spark, drops, DROP, "u", out, check).awaitTermination()
    return st.dropped_rows(spark, out).drop("file_id")


@query("SELECT doc_id, text FROM documents")
def stream_csv_texts(spark, sf_dir):
    """Dropped files whose quoted fields hold line breaks and quotes."""
    drops, out, check = (fresh_folder(spark, n) for n in ("text-drops", "text-out", "text-check"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Several files, and more where the table takes more tasks to read, so that none grows with it.
    files = max(3, docs.rdd.getNumPartitions())
    docs.repartition(files).write.options(header=True, quote='"', escape='"').csv(drops)
    st.stream_csv_drops(spark, drops, docs.schema, "u", out, check).awaitTermination()
    return st.dropped_rows(spark, out).drop("file_id")


def _stream(spark, sf_dir, name: str, files: int = 3):
    """The table as a stream of `files` files below the shared folder."""
    folder = fresh_folder(spark, name)
    source = table(spark, sf_dir, name)
    source.repartition(files).write.parquet(folder)
    return spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query(STATES_SQL + "SELECT * FROM states")
def stream_job_states(spark, sf_dir):
    out = fresh_folder(spark, "states")
    st.stream_job_states(job_log(_stream(spark, sf_dir, "events")), out, fresh_folder(spark, "states-check")).awaitTermination()
    st.fold_jobs(spark, out)
    return st.current_jobs(spark, out)


@query("SELECT conv_id AS run_id, max(turn) AS seq, arg_max(text, turn) AS final_message FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def stream_final_messages(spark, sf_dir):
    out = fresh_folder(spark, "messages")
    events = parse_events(event_lines(_stream(spark, sf_dir, "conversations")))
    st.stream_final_messages(events, out, fresh_folder(spark, "messages-check")).awaitTermination()
    return st.current_final_messages(spark, out)
