"""Chart data by intent, and checks of chart options against known series properties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import single_json


def comparison(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, total): totals per group."""
    return df.groupBy(group).agg(F.sum(value).alias("total"))


def trend(df: DataFrame, time: str, value: str, period: str = "month", group: Sequence[str] = ()) -> DataFrame:
    """(period, group…, total): totals per period and group."""
    return df.groupBy(F.date_trunc(period, time).cast("date").alias("period"), *group).agg(F.sum(value).alias("total"))


def distribution(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n): equal-width bins from minimum to maximum, the last one closed. Empty bins have no row."""
    known = df.where(F.col(value).isNotNull())
    low = known.select(F.min(value).cast("double")).scalar()
    high = known.select(F.max(value).cast("double")).scalar()
    width = (high - low) / bins
    place = F.when(high == low, F.lit(1)).otherwise(
        F.least(F.floor((F.col(value) - low) / width) + 1, F.lit(bins))
    )
    counted = known.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", (low + width * (F.col("bin") - 1)).alias("low"), (low + width * F.col("bin")).alias("high"), "n")


def correlation(df: DataFrame, x: str, y: str, group: Sequence[str] = ()) -> DataFrame:
    """(group…, correlation, n): Pearson correlation over rows that have both values."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*group).agg(F.corr(x, y).alias("correlation"), F.count(F.lit(1)).alias("n"))


def composition(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, total, share): each group's part of the whole."""
    totals = comparison(df, group, value)
    whole = totals.select(F.sum("total")).scalar()
    return totals.withColumn("share", F.col("total") / whole)


def hierarchy(df: DataFrame, levels: Sequence[str], value: str) -> DataFrame:
    """(levels…, depth, total): totals at every level of nesting; depth 0 is the grand total."""
    nested = df.rollup(*levels).agg(F.sum(value).alias("total"), F.grouping_id().alias("_id"))
    depth = F.lit(len(levels)) - F.bit_count("_id")
    return nested.select(*levels, depth.cast("int").alias("depth"), "total")


def mark_maximum(points: DataFrame, value: str) -> DataFrame:
    """Adds `is_max`, true on the points that hold the highest value."""
    return points.withColumn("is_max", F.col(value) == points.select(F.max(value)).scalar())


def _entries(option: Column) -> Column:
    """The `series` of an option as array<variant>; one object counts as a list of one, an empty value as none."""
    series = F.try_variant_get(single_json(option), "$.series", "variant")
    kind = F.schema_of_variant(series)
    empty = kind.isNull() | F.to_json(series).isin("null", "{}", "[]", '""', "0", "false")
    many = F.try_variant_get(series, "$", "array<variant>")
    return F.when(empty, F.array().cast("array<variant>")).when(kind.startswith("ARRAY"), many).otherwise(F.array(series))


def validate_options(options: DataFrame, series_props: DataFrame) -> DataFrame:
    """(option_id, valid, errors, warnings) of chart options (option_id, option JSON text).

    Errors: a series entry that is no object, has no type or an unknown one. Warnings: unknown properties. `series_props`
    holds (series, property); a type is known when it has a row there.
    """
    entries = options.select("option_id", F.posexplode(_entries(F.col("option"))).alias("pos", "entry"))
    is_object = F.schema_of_variant("entry").startswith("OBJECT")
    entries = entries.select(
        "option_id",
        "pos",
        is_object.alias("is_object"),
        F.when(is_object, F.try_variant_get("entry", "$.type", "string")).alias("series"),
        F.when(is_object, F.json_object_keys(F.to_json("entry"))).alias("names"),
    )
    known = series_props.select("series").distinct().withColumn("_known", F.lit(True))
    place = F.concat(F.lit("series["), F.col("pos").cast("string"), F.lit("]"))
    checked = entries.join(known, "series", "left").withColumn(
        "error",
        F.when(~F.col("is_object"), F.concat(place, F.lit(" must be an object")))
        .when(F.coalesce("series", F.lit("")) == "", F.concat(place, F.lit(" missing 'type'")))
        .when(F.col("_known").isNull(), F.concat(F.lit("Unknown series type: "), F.col("series"))),
    )
    named = checked.where(F.col("error").isNull()).select("option_id", "pos", "series", F.posexplode("names").alias("at", "property"))
    unknown = named.where(F.col("property") != "type").join(series_props, ["series", "property"], "left_anti")
    warning = F.concat(place, F.lit(" unknown property '"), F.col("property"), F.lit("'"))

    # Grouped per option, so a list is as long as its option has series or properties.
    errors = checked.where(F.col("error").isNotNull()).groupBy("option_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "error")))["error"].alias("errors")
    )
    warnings = unknown.groupBy("option_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "at", warning.alias("w"))))["w"].alias("warnings")
    )
    none = F.array().cast("array<string>")
    return (
        options.select("option_id")
        .join(errors, "option_id", "left")
        .join(warnings, "option_id", "left")
        .select(
            "option_id",
            F.col("errors").isNull().alias("valid"),
            F.coalesce("errors", none).alias("errors"),
            F.coalesce("warnings", none).alias("warnings"),
        )
    )
