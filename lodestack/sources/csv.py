"""Typed CSV ingest.

A quoted field may hold line breaks, so where a line starts does not tell whether a record does. Every range of a file is
therefore read once for what it does to the state "inside quotes", for either state at its start. Put in order, the ranges' effects
give each range its true state, and then all ranges are cut into records at once. Only the pieces of records that cross from one
range into the next are put together afterwards, at most two for each range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.session import cut_lineage


class CsvReadError(Exception):
    """The input is missing, not a CSV, or does not parse."""


@dataclass(frozen=True)
class CsvJob:
    """Options of one CSV → Parquet job. `sample_size` is the lines used to infer types; -1 reads all.

    `folder=True` also takes a folder of part files named `….csv`, as Spark writes them. A delimiter of None is found from the
    first lines; whether quoted fields hold line breaks is found from the whole input if `multi_line` is None.
    """

    input_path: str
    output_path: str | None = None
    dtype_overrides: Mapping[str, str] = field(default_factory=dict)
    auto_cast_dates: bool = True
    sample_size: int = -1
    header: bool = True
    delimiter: str | None = None
    folder: bool = False
    multi_line: bool | None = None

    def __post_init__(self) -> None:
        check_sample_size(self.sample_size)

    @property
    def target(self) -> str:
        """The output path, by default the input's stem with `.parquet`."""
        return self.output_path or self.input_path[: -len(".csv")] + ".parquet"


def check_sample_size(sample_size: int) -> None:
    if sample_size == 0 or sample_size < -1:
        raise ValueError("sample_size must be -1 or at least 1")


def _check_path(spark: SparkSession, path: str, folder: bool) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(hadoop):
        raise CsvReadError(f"nothing to read at {path}")
    if not folder and not system.getFileStatus(hadoop).isFile():
        raise CsvReadError(f"{path} is a folder; pass folder=True to read its part files")
    if not path.lower().endswith(".csv"):
        raise CsvReadError(f"{path} has no .csv ending")


def _widened(schema: T.StructType) -> T.StructType:
    """Inferred `int` becomes `bigint`, so that a longer file does not change a column's type."""
    return T.StructType(
        [T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.IntegerType) else f.dataType) for f in schema]
    )


# Delimiters that are looked for, and the lines that are looked at.
DELIMITERS = (",", ";", "\t", "|")
HEAD = 1000
# A doubled quote stands for one; no other escape.
QUOTING = {"quote": '"', "escape": '"'}


def sniff(head: list[str]) -> tuple[str, bool]:
    """(delimiter, whether a quoted field holds a line break) of the first lines of a file.

    The delimiter is the one that cuts most lines into as many fields as the first line, more than one; a comma if none does.
    """
    records, open_quote, broken = [""], False, False
    for line in head:
        records[-1] += line if not open_quote else "\n" + line
        open_quote ^= line.count('"') % 2 == 1
        broken |= open_quote
        if not open_quote:
            records.append("")
    bare = [re.sub(r'"(?:[^"]|"")*"', "", r) for r in records if r]

    def fit(delimiter: str) -> tuple[int, int]:
        counts = [r.count(delimiter) for r in bare]
        return (sum(c == counts[0] for c in counts), counts[0]) if counts and counts[0] else (0, 0)

    best = max(DELIMITERS, key=fit)
    return (best if fit(best)[0] else ","), broken


def ends_open(line: str, is_open: bool, delimiter: str) -> bool:
    """Whether a quoted field is still open after the line. A quote opens a field only where the field begins."""
    at = 0
    while True:
        if is_open:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == '"':
                at += 2
                continue
        elif line[at : at + 1] == '"':
            is_open, at = True, at + 1
            continue
        is_open = False
        at = line.find(delimiter, at)
        if at < 0:
            return False
        at += len(delimiter)


def _ranges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, start, line): lines with the range of the file they were read in; their order within a range is that of the rows."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _effects(delimiter: str):
    """One row per range: the state at its end and whether a line ended open, for a closed and an open start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            for place, line in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist()):
                effect = seen.setdefault(place, [False, False, True, False])
                for n in (0, 2):
                    if '"' in line:
                        effect[n] = ends_open(line, effect[n], delimiter)
                    effect[n + 1] |= effect[n]
        rows = [(*place, *effect) for place, effect in seen.items()]
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows)], ["file", "start", "from_closed", "broken_closed", "from_open", "broken_open"])

    return run


def _states(ranges: pd.DataFrame) -> pd.DataFrame:
    """The state at the start of each range of one file: a row for each range comes in."""
    is_open, out = False, []
    for row in ranges.sort_values("start").itertuples():
        out.append((row.file, row.start, is_open, bool(row.broken_open if is_open else row.broken_closed)))
        is_open = bool(row.from_open if is_open else row.from_closed)
    return pd.DataFrame(out, columns=["file", "start", "open", "broken"])


def _cut(delimiter: str):
    """(file, start, n, piece, text): whole records (piece 0), and the parts of records that a range begins (1) or ends (2) with.

    Line breaks between lines stay inside a record; a carriage return at its end goes.
    """
    names = ["file", "start", "n", "piece", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, n, is_open, piece, out = None, [], 0, False, 0, []

        def close(kind: int) -> None:
            nonlocal held, n
            out.append((*place, n, kind, "\n".join(held)))
            held, n = [], n + 1

        for batch in batches:
            for file, start, line, began_open in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if (file, start) != place:
                    if held:
                        close(1 if piece else 2)
                    place, n, is_open, piece = (file, start), 0, began_open, int(began_open)
                held.append(line)
                if '"' in line:
                    is_open = ends_open(line, is_open, delimiter)
                if not is_open:
                    close(piece)
                    piece = 0
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out)], names)
                out = []
        if held:
            close(1 if piece else 2)
            yield pa.record_batch([pa.array(c) for c in zip(*out)], names)

    return run


def range_states(spark: SparkSession, path: str | list[str], delimiter: str) -> DataFrame:
    """(file, start, open, broken): one row per range of the input: its state at the start, and whether a line in it ends open."""
    schema = "file string, start bigint, from_closed boolean, broken_closed boolean, from_open boolean, broken_open boolean"
    effects = _ranges(spark, path).mapInArrow(_effects(delimiter), schema)
    return cut_lineage(effects.groupBy("file").applyInPandas(_states, "file string, start bigint, open boolean, broken boolean"))


def csv_records(spark: SparkSession, path: str | list[str], delimiter: str, states: DataFrame) -> DataFrame:
    """(file, first, text): the records of the input, whatever lines they spread over; `first` marks a file's first one."""
    # Nine bytes for each range.
    begun = states.select(F.xxhash64("file", "start").alias("place"), "open")
    moved = F.raise_error(F.lit("the input was split otherwise than when its quotes were looked at; read it again")).cast("boolean")
    lines = _ranges(spark, path).withColumn("place", F.xxhash64("file", "start"))
    known = lines.join(F.broadcast(begun), "place", "left").select("file", "start", "line", F.coalesce("open", moved).alias("open"))
    pieces = known.mapInArrow(_cut(delimiter), "file string, start bigint, n bigint, piece bigint, text string")
    whole = pieces.where("piece = 0").select("file", ((F.col("start") == 0) & (F.col("n") == 0)).alias("first"), "text")
    # A range has at most two pieces of records.
    parts = cut_lineage(pieces.where("piece > 0"))
    order = Window.partitionBy("file").orderBy("start", "n")
    numbered = parts.withColumn("record", F.count_if(F.col("piece") == 2).over(order))
    joined = numbered.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "n", "text"))).alias("p"))
    joined = joined.select("file", ((F.col("p")[0]["start"] == 0) & (F.col("p")[0]["n"] == 0)).alias("first"), F.array_join("p.text", "\n").alias("text"))
    tidy = F.regexp_replace("text", "\r$", "")
    return whole.union(joined).withColumn("text", F.when(F.col("first"), F.ltrim(tidy, F.lit("\ufeff"))).otherwise(tidy)).where(F.trim("text") != "")


def _read_records(spark: SparkSession, path: str, delimiter: str, header: bool, states: DataFrame) -> DataFrame:
    """The typed rows of records that were cut beforehand: any number of tasks reads a file."""
    records = csv_records(spark, path, delimiter, states)

    def parsed(rows: DataFrame, **options) -> DataFrame:
        strings = getattr(rows.select("text")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        reader = spark.read.options(sep=delimiter, multiLine=True, **QUOTING, **options)
        return DataFrame(reader._jreader.csv(strings), spark)

    rows = records.where(~F.col("first")) if header else records
    schema = parsed(rows, header=False, inferSchema=True).schema
    if header:
        heads = records.where("first").orderBy("file").limit(1)
        names = parsed(heads, header=True).columns
        if not schema.fields:
            schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
        schema = T.StructType([T.StructField(name, f.dataType) for name, f in zip(names, schema)])
    strings = getattr(rows.select("text")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    reader = spark.read.schema(_widened(schema)).options(mode="FAILFAST", sep=delimiter, multiLine=True, **QUOTING)
    return DataFrame(reader._jreader.csv(strings), spark)


def read_typed(spark: SparkSession, paths: list[str], schema: T.StructType, delimiter: str = ",") -> DataFrame:
    """The rows of files with a header and the given schema, and the `file` they come from."""
    states = range_states(spark, paths, delimiter)
    if states.where("broken").isEmpty():
        rows = spark.read.schema(schema).options(header=True, mode="FAILFAST", enforceSchema=True, sep=delimiter, **QUOTING).csv(paths)
        return rows.select(F.col("_metadata.file_path").alias("file"), *schema.names)
    records = csv_records(spark, paths, delimiter, states).where(~F.col("first"))
    options = {"mode": "FAILFAST", "sep": delimiter, "multiLine": "true", **QUOTING}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return records.select("file", F.from_csv("text", ddl, options).alias("row")).select("file", *[F.col(f"row.`{n}`") for n in schema.names])


def read_csv(
    spark: SparkSession,
    path: str,
    sample_size: int = -1,
    header: bool = True,
    delimiter: str | None = None,
    folder: bool = False,
    multi_line: bool | None = None,
) -> DataFrame:
    """A CSV file with inferred types. A value that does not fit the type fails the job that reads it.

    Quoted fields may hold line breaks; with `multi_line=None` the whole input is looked at to find out, and `False` saves
    that pass. With line breaks in fields types are inferred from all rows, whatever `sample_size`.
    """
    check_sample_size(sample_size)
    _check_path(spark, path, folder)
    try:
        text = spark.read.text(path)
        delimiter = delimiter or sniff([row[0] for row in text.limit(HEAD).collect()])[0]
        if multi_line is not False:
            states = range_states(spark, path, delimiter)
            if not states.where("broken").isEmpty():
                return _read_records(spark, path, delimiter, header, states)
        options = {"header": header, "sep": delimiter, **QUOTING}
        guess = spark.read.options(inferSchema=True, **options)
        if sample_size == -1:
            schema = guess.csv(path).schema
        else:
            head = text.limit(sample_size + int(header))
            schema = guess.csv(head.rdd.map(lambda row: row[0])).schema
        return spark.read.schema(_widened(schema)).options(mode="FAILFAST", **options).csv(path)
    except (PySparkException, Py4JJavaError) as error:
        raise CsvReadError(f"not readable as CSV: {error}") from error
