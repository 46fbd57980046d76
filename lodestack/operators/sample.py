"""Row samples and the types a sample suggests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME_FORMAT = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", "timestampFormat": "yyyy-MM-dd HH:mm:ss"}


def sample(df: DataFrame, order_by: str | Sequence[str], position: str = "head", limit: int = 5) -> DataFrame:
    """First or last `limit` rows in key order. Rows have no stored order in Spark, so the key must be given."""
    where = position.lower()
    if where not in ("head", "tail"):
        raise ValueError(f"neither head nor tail: {position!r}")
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    if where == "head":
        return df.orderBy(*keys).limit(limit)
    return df.orderBy(*[F.desc(k) for k in keys]).limit(limit).orderBy(*keys)


def sample_all_tables(
    tables: Mapping[str, DataFrame], order_by: Mapping[str, str | Sequence[str]], limit: int = 3
) -> DataFrame:
    """First rows of every table as JSON text: (table_name, row_json)."""
    picks = [
        sample(tables[name], order_by[name], "head", limit).select(
            F.lit(name).alias("table_name"), F.to_json(F.struct("*"), TIME_FORMAT).alias("row_json")
        )
        for name in sorted(tables)
    ]
    return reduce(DataFrame.unionByName, picks)


def _label(dtype: T.DataType, sampled: Column) -> Column:
    if isinstance(dtype, T.BooleanType):
        return F.lit("bool")
    if isinstance(dtype, T.IntegralType):
        return F.lit("int")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.lit("float")
    if isinstance(dtype, T.StringType):
        return F.when(sampled.rlike("[-/:]"), "datetime").otherwise("str")
    return F.lit("object")


def infer_sample_types(df: DataFrame, order_by: str | Sequence[str], n: int = 3) -> DataFrame:
    """(column_name, sample_type) for all columns, from the first non-null value among n head and n tail rows."""
    pick = reduce(
        DataFrame.unionByName,
        [
            sample(df, order_by, where, n).withColumn("_part", F.lit(part))
            for part, where in enumerate(("head", "tail"))
        ],
    )
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    place = F.struct("_part", *keys)

    def verdict(field: T.StructField) -> Column:
        value = F.col(field.name)
        text = value.cast("string") if isinstance(field.dataType, T.StringType) else F.lit("")
        first = F.min_by(F.when(value.isNotNull(), text), F.when(value.isNotNull(), place))
        return F.struct(
            F.lit(field.name).alias("column_name"),
            F.when(F.count(value) == 0, F.lit("unknown")).otherwise(_label(field.dataType, first)).alias("sample_type"),
        )

    return pick.agg(F.array(*[verdict(f) for f in df.schema.fields]).alias("all")).select(F.inline("all"))
