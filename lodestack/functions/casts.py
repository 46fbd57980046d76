"""Casting columns by name rule or explicit override."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# CSV type names that Spark spells differently.
TYPE_ALIASES = {
    "varchar": "string",
    "text": "string",
    "char": "string",
    "bool": "boolean",
    "int1": "tinyint",
    "int2": "smallint",
    "int4": "int",
    "integer": "int",
    "int8": "bigint",
    "long": "bigint",
    "hugeint": "decimal(38,0)",
    "ubigint": "decimal(20,0)",
    "uinteger": "bigint",
    "usmallint": "int",
    "utinyint": "smallint",
    "float4": "float",
    "real": "float",
    "float8": "double",
    "numeric": "decimal(18,3)",
    "datetime": "timestamp",
    "timestamptz": "timestamp",
    "blob": "binary",
    "bytea": "binary",
}


def spark_type(name: str) -> str:
    """Spark DDL for a CSV type name; `X[]` becomes `array<X>`, unknown names pass through."""
    name = name.strip()
    if name.endswith("[]"):
        return f"array<{spark_type(name[:-2])}>"
    return TYPE_ALIASES.get(name.lower(), name)


def casts_by_name(
    columns: Sequence[str], overrides: Mapping[str, str] | None = None, auto_cast_dates: bool = True
) -> dict[str, str]:
    """Column → type. A name with `date` is a date; else one with `timestamp`, `_at` or `_time` a timestamp."""
    casts: dict[str, str] = {}
    for column in columns if auto_cast_dates else ():
        lower = column.lower()
        if "date" in lower:
            casts[column] = "date"
        elif "timestamp" in lower or lower.endswith(("_at", "_time")):
            casts[column] = "timestamp"
    return {**casts, **{c: spark_type(t) for c, t in (overrides or {}).items()}}


def _quoted(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def cast_by_name(
    df: DataFrame,
    overrides: Mapping[str, str] | None = None,
    auto_cast_dates: bool = True,
    strict: bool = True,
) -> DataFrame:
    """One projection with the casts above; order and names are kept and a bad value is an error.

    With `strict=False` a column guessed from its name keeps its type when any value would not cast. That needs
    one pass over the guessed columns.
    """
    casts = casts_by_name(df.columns, overrides, auto_cast_dates)
    if not strict:
        guessed = [c for c in casts if c in df.columns and c not in (overrides or {})]
        if guessed:
            lost = [
                F.count_if(_quoted(c).isNotNull() & _quoted(c).try_cast(casts[c]).isNull()).alias(str(i))
                for i, c in enumerate(guessed)
            ]
            row = df.agg(*lost).first()
            casts = {c: t for c, t in casts.items() if c not in guessed or row[str(guessed.index(c))] == 0}
    return df.select(*[_quoted(c).cast(casts[c]).alias(c) if c in casts else _quoted(c) for c in df.columns])


def with_file_id(df: DataFrame, file_hash: str = "file_hash", key: str | None = None) -> DataFrame:
    """Adds `file_id`: twelve digits of the hash, a dash, and 32 random hex digits (or a hash of `key`)."""
    tail = F.replace(F.uuid(), F.lit("-"), F.lit("")) if key is None else F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 32)
    return df.withColumn("file_id", F.concat(F.substring(file_hash, 1, 12), F.lit("-"), tail))
