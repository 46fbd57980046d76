"""Runs queries against their oracles: `python -m workload.check <sf_dir> [query …]`."""

from __future__ import annotations

import sys
import time

import duckdb
import pyarrow as pa
from pyspark.sql import SparkSession

from lodestack.session import build_session
from workload import load_all

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _plain(dtype: pa.DataType) -> str:
    text = str(dtype).replace("large_", "").replace("string_view", "string")
    return "timestamp" if text.startswith("timestamp") else text


def rows_of(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]

    def cell(value: object) -> str:
        return str(value.replace(tzinfo=None)) if hasattr(value, "tzinfo") else repr(value)

    return sorted(tuple(cell(v) for v in row) for row in zip(*columns))


def compare(spark: SparkSession, connection, sf_dir: str, name: str) -> tuple[str, float, float]:
    """(verdict, spark seconds, oracle seconds) for one query."""
    queries, oracles = load_all()
    start = time.time()
    got = queries[name](spark, sf_dir).toArrow()
    spark_time = time.time() - start
    if name not in oracles:
        return (f"ok rows={got.num_rows} (no oracle)" if got.num_rows else "EMPTY"), spark_time, 0.0
    start = time.time()
    want = connection.execute(oracles[name]).to_arrow_table()
    oracle_time = time.time() - start
    types = [{f.name: _plain(f.type) for f in t.schema} for t in (got, want)]
    if types[0] != types[1]:
        both = {k: (types[0].get(k), types[1].get(k)) for k in {*types[0], *types[1]} if types[0].get(k) != types[1].get(k)}
        return f"SCHEMA {both}", spark_time, oracle_time
    mine, theirs = rows_of(got), rows_of(want)
    if mine == theirs:
        return (f"ok rows={len(mine)}" if mine else "EMPTY"), spark_time, oracle_time
    extra = [r for r in mine if r not in set(theirs)][:2]
    lost = [r for r in theirs if r not in set(mine)][:2]
    return f"DIFF spark={len(mine)} oracle={len(theirs)}\n   spark:  {extra}\n   oracle: {lost}"[:3000], spark_time, oracle_time


def main() -> None:
    sf_dir, *names = sys.argv[1:]
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    queries, _ = load_all()
    failed = []
    for name in names or queries:
        try:
            verdict, spark_time, oracle_time = compare(spark, connection, sf_dir, name)
        except Exception as error:  # keep going, the summary names every failure
            verdict, spark_time, oracle_time = f"ERROR {type(error).__name__}: {str(error)[:1500]}", 0.0, 0.0
        if not verdict.startswith("ok"):
            failed.append(name)
        print(f"{name:32s} {spark_time:6.2f}s {oracle_time:6.2f}s  {verdict}", flush=True)
    print("failed:", failed or "none")


if __name__ == "__main__":
    main()
