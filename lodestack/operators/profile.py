"""Column profiles: counts, distinct values, frequent values and numeric summaries.

Profiles of many columns come from one scan: every cell becomes (column, state, digest), and equal cells are combined before
the shuffle, so a value that fills a third of the table costs one row per task and no value is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATASET_TOP = 10


def require_column(df: DataFrame, column: str, table: str | None = None) -> T.DataType:
    """The column's type, or an error that names it."""
    if column not in df.columns:
        raise ValueError(f"Column '{column}' not found" + (f" in table '{table}'" if table else ""))
    return df.schema[column].dataType


def _is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def _nan(column: Column, dtype: T.DataType) -> Column:
    return F.coalesce(F.isnan(column), F.lit(False)) if _is_float(dtype) else F.lit(False)


def _percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total * 100).otherwise(F.lit(0.0))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) for one column; null and NaN are values of their own."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


# What a cell holds beside a plain value.
PLAIN, NULL, EMPTY, NAN = 0, 1, 2, 3
SHORT = 8


def _state(column: str, dtype: T.DataType) -> str:
    """SQL text, as all of a cell's expressions: wide tables have thousands of them, and one text is parsed at once."""
    cases = f"WHEN {column} IS NULL THEN {NULL}"
    if isinstance(dtype, T.StringType):
        cases += f" WHEN {column} = '' THEN {EMPTY}"
    if _is_float(dtype):
        cases += f" WHEN isnan({column}) THEN {NAN}"
    return f"CASE {cases} ELSE {PLAIN} END"


def _narrow(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.DecimalType):
        return dtype.precision <= 18
    return isinstance(dtype, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _digest(column: str, dtype: T.DataType) -> tuple[str, str]:
    """Two numbers that stand for a value among the values of its column.

    Numbers, dates and times of at most eight bytes are mapped one to one. Others have 128 bits: a hash, and a second one with
    another seed or, for text beyond `SHORT` bytes and nested values, of the SHA-256 digest.
    """
    if _narrow(dtype):
        return f"xxhash64({column})", "0L"
    if isinstance(dtype, T.ArrayType) and _narrow(dtype.elementType):
        cells = f"{column}, transform({column}, x -> x IS NULL)"  # the hash of an array passes over nulls
        return f"xxhash64({cells})", f"xxhash64(1, {cells})"
    text = column
    if not isinstance(dtype, (T.StringType, T.BinaryType)):
        text = f"to_json(named_struct('v', {column}), map('ignoreNullFields', 'false'))"
    far = f"xxhash64(sha2(CAST({text} AS BINARY), 256))"
    return f"xxhash64({text})", f"CASE WHEN octet_length({text}) <= {SHORT} THEN xxhash64(1, {text}) ELSE {far} END"


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(at, state, high, low) per cell of the chosen columns, all types in one scan; `at` is the column's place."""
    cells = []
    for at, column in enumerate(columns):
        dtype = require_column(df, column)
        high, low = _digest(_quoted(column), dtype)
        cells.append(f"named_struct('at', {at}, 'state', {_state(_quoted(column), dtype)}, 'high', {high}, 'low', {low})")
    return df.select(F.expr(f"inline(array({', '.join(cells)}))"))


def _summed(df: DataFrame, columns: Sequence[str], measures: Mapping[str, Sequence[int]], distinct: tuple[str, Sequence[int]]) -> DataFrame:
    """(column_name, …) with the rows whose state is among each measure's, and the distinct values among `distinct`'s.

    Equal cells are counted before the shuffle; what is shuffled are digests, never values.
    """
    counts = _cells(df, columns).groupBy("at", "state", "high", "low").agg(F.count(F.lit(1)).alias("n"))
    # No rows of each column, so that the columns of an empty table are still there.
    none = df.sparkSession.range(0, len(columns), 1, 1).selectExpr(
        "CAST(id AS INT) AS at", f"{NULL} AS state", "0L AS high", "0L AS low", "0L AS n"
    )

    def among(states: Sequence[int]) -> str:
        return f"state IN ({', '.join(map(str, states))})"

    sums = [f"sum(CASE WHEN {among(states)} THEN n ELSE 0L END) AS {measure}" for measure, states in measures.items()]
    name, states = distinct
    sums.append(f"count_if({among(states)} AND n > 0) AS {name}")
    summed = counts.unionByName(none).groupBy("at").agg(*map(F.expr, sums))
    named = summed.withColumn("column_name", F.get(F.array(*map(F.lit, columns)), F.col("at")))
    return named.select("column_name", *measures, name)


ANY = (PLAIN, NULL, EMPTY, NAN)
TABLE_MEASURES = {"row_count": ANY, "null_count": (NULL,), "empty_string_count": (EMPTY,), "nan_count": (NAN,)}
TABLE_DISTINCT = ("distinct_count", (PLAIN, EMPTY, NAN))
# As in a pandas frame, a NaN also counts as null.
DATASET_MEASURES = {"total_rows": ANY, "null_count": (NULL, NAN), "nan_count": (NAN,)}
DATASET_DISTINCT = ("unique_count", (PLAIN, EMPTY))


COUNTS = ("null_count", "empty_string_count", "nan_count")


def _table_stats(measured: DataFrame, table: str) -> DataFrame:
    shares = [c for n in COUNTS for c in (n, _percent(F.col(n), F.col("row_count")).alias(n.replace("_count", "_pct")))]
    return measured.select(F.lit(table).alias("table_name"), "column_name", "row_count", *shares, "distinct_count")


def table_column_stats(df: DataFrame, table: str, columns: str | Sequence[str]) -> DataFrame:
    """One row per table column; the `_pct` fields are percents. Unknown columns are an error."""
    chosen = [columns] if isinstance(columns, str) else list(columns)
    for column in chosen:
        require_column(df, column, table)
    return _table_stats(_summed(df, chosen, TABLE_MEASURES, TABLE_DISTINCT), table)


def top_values(df: DataFrame, column: str, limit: int = DATASET_TOP) -> DataFrame:
    """The most frequent non-null values: value, n, pct as a fraction of all rows. Ties go to the smaller value."""
    dtype = require_column(df, column)
    counts = value_counts(df, column)
    total = counts.select(F.sum("n")).scalar()
    return (
        counts.where(F.col("value").isNotNull() & ~_nan(F.col("value"), dtype))
        .orderBy(F.desc("n"), F.asc("value"))
        .limit(limit)
        .select("value", "n", (F.col("n") / total).alias("pct"))
    )


def table_top_values(df: DataFrame, column: str) -> DataFrame:
    """Frequent values of a table column: a fifth of the distinct values, at least 1 and at most 10; percent of rows."""
    require_column(df, column)
    counts = value_counts(df, column)
    total = counts.select(F.sum("n")).scalar()
    distinct = counts.select(F.count("value")).scalar()
    keep = F.least(F.lit(10), F.greatest(F.lit(1), F.ceil(distinct * 0.2)))
    ten = counts.where(F.col("value").isNotNull()).orderBy(F.desc("n"), F.asc("value")).limit(10)
    # Ten rows at most, so packing them to number them costs nothing.
    ranked = ten.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "value"))).alias("rows"))
    return (
        ranked.select(F.posexplode("rows").alias("pos", "r"))
        .where(F.col("pos") < keep)
        .select(
            F.col("r.value").alias("value"),
            (-F.col("r.o")).alias("frequency"),
            (-F.col("r.o") / total * 100).alias("frequency_pct"),
        )
    )


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """min, max, mean and sample standard deviation per numeric column, all in one scan; NaN is left out."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    chosen = list(columns) if columns is not None else numeric
    for column in chosen:
        require_column(df, column)
    chosen = [c for c in chosen if c in numeric]
    if not chosen:
        raise ValueError("no numeric column to summarise")

    def summary(column: str) -> Column:
        value = F.col(column).cast("double")
        value = F.when(~F.isnan(value), value)
        return F.struct(
            F.lit(column).alias("column_name"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
        )

    row = df.agg(F.array(*[summary(c) for c in chosen]).alias("all"))
    return row.select(F.inline("all"))


def dataset_column_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: dtype, total_rows, null_count, nan_count, unique_count.

    As in a pandas frame, a NaN also counts as null; nulls do not count as NaN.
    """
    chosen = list(columns) if columns is not None else df.columns

    types = F.create_map(*[F.lit(x) for c in chosen for x in (c, require_column(df, c).simpleString())])
    dtype = F.try_element_at(types, F.col("column_name")).alias("dtype")
    return _summed(df, chosen, DATASET_MEASURES, DATASET_DISTINCT).select(
        "column_name", dtype, "total_rows", "null_count", "nan_count", "unique_count"
    )


def profile_all(tables: Mapping[str, DataFrame], approx: bool = False) -> DataFrame:
    """`table_column_stats` for every column of every table.

    `approx=True` swaps the exact distinct count for a sketch: then only sketches are shuffled.
    """
    parts = []
    for name, df in sorted(tables.items()):
        if approx:
            parts.append(profile_from_sketches(column_sketches(df), name))
        else:
            parts.append(table_column_stats(df, name, df.columns))
    return reduce(DataFrame.unionByName, parts)


# A sketch of 2^12 registers; its standard error is about 1.6 % of the distinct count.
SKETCH_BITS = 12


def column_sketches(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, row_count, null_count, empty_string_count, nan_count, sketch) of one batch, to be stored and merged.

    One scan and one row per task are all that it takes: nothing is laid out or grouped. Sketches of one column merge if it
    keeps its type from batch to batch. An empty batch gives counts of 0.
    """
    chosen = list(columns) if columns is not None else df.columns

    def measured(column: str) -> str:
        dtype = require_column(df, column)
        state, high = _state(_quoted(column), dtype), _digest(_quoted(column), dtype)[0]
        counts = "".join(f", '{name}', count_if({state} = {what})" for name, what in zip(COUNTS, (NULL, EMPTY, NAN), strict=True))
        sketch = f"hll_sketch_agg(CASE WHEN {_quoted(column)} IS NOT NULL THEN {high} END, {SKETCH_BITS})"
        return f"named_struct('row_count', count(1){counts}, 'sketch', {sketch})"

    rows = df.agg(F.expr(f"array({', '.join(map(measured, chosen))})").alias("all")).select(F.posexplode("all").alias("at", "m"))
    return rows.select(F.get(F.array(*map(F.lit, chosen)), F.col("at")).alias("column_name"), "m.*")


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ("column_name",)) -> DataFrame:
    """Rows of `column_sketches` of many batches as those of all their rows together."""
    counts = [F.sum(c).cast("bigint").alias(c) for c in ("row_count", *COUNTS)]
    return sketches.groupBy(*by).agg(*counts, F.hll_union_agg("sketch").alias("sketch"))


def profile_from_sketches(sketches: DataFrame, table: str) -> DataFrame:
    """`table_column_stats` from sketches, with an estimated `distinct_count`."""
    estimated = sketches.withColumn("distinct_count", F.hll_sketch_estimate("sketch"))
    return _table_stats(estimated, table)
