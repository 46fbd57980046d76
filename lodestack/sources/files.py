"""Raw files and JSON-lines logs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions.text import single_json, strip


# Stores whose files are read as streams, by the scheme of the path, and the name they have for the reader.
STREAMED = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}
PIECE = 8 << 20


def _digest(path: str) -> str:
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        system, inside = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        system, inside = fs.FileSystem.from_uri(f"{STREAMED[scheme]}:{quote(rest)}")
    digest = hashlib.sha256()
    with system.open_input_stream(inside) as stream:
        while piece := stream.read(PIECE):
            digest.update(piece)
    return digest.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("file_hash", pa.array([_digest(p) for p in batch.column(0).to_pylist()], pa.string()))


def with_hashes(files: DataFrame) -> DataFrame:
    """(path, length, file_hash) of a listing of binary files (path, length, content): SHA-256 of their bytes.

    Files are read piece by piece, so their size does not matter and `content` is left unread; a file is one task's work, as
    the digest is. Only if a store is among them that no stream reader knows do contents pass through a cell, which holds 2 GB.
    """
    known = F.substring_index("path", ":", 1).isin(*STREAMED)
    if files.where(~known).select("path").isEmpty():
        return files.select("path", "length").mapInArrow(_digests, "path string, length bigint, file_hash string")
    return files.select("path", "length", F.sha2("content", 256).alias("file_hash"))


def hash_files(spark: SparkSession, path_glob: str) -> DataFrame:
    """(path, length, file_hash): SHA-256 of the bytes of every file the glob matches. Spark lists no files without bytes."""
    return with_hashes(spark.read.format("binaryFile").load(path_glob))


def parse_json_lines(lines: DataFrame, schema: T.StructType | str, line: str | Column = "value") -> DataFrame:
    """Adds `event`, the line read with a fixed schema. Blank lines and lines that are not a JSON object are dropped."""
    text = strip(F.col(line) if isinstance(line, str) else line)
    kept = lines.withColumn("_text", text).where(F.col("_text").startswith("{"))
    kept = kept.where(single_json(F.col("_text")).isNotNull())
    return kept.withColumn("event", F.from_json("_text", schema)).drop("_text")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Events of a JSON-lines file or folder, without schema inference: (event, file)."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    return parse_json_lines(lines, schema).drop("value")
