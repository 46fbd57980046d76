"""Checks of declared keys against the data: orphans, cardinality and primary keys.

All three count per key first, so rows sharing a hot key meet as one partial count per task, never as rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)])


def _names(columns: Sequence[str]) -> list[str]:
    return [f"k{i}" for i in range(len(columns))]


def _all_set(names: Sequence[str]) -> Column:
    flag = F.lit(True)
    for name in names:
        flag = flag & F.col(name).isNotNull()
    return flag


def key_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(k0, k1, …, n): rows per complete key."""
    names = _names(columns)
    return _keys(df, columns).where(_all_set(names)).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def orphan_keys(child: DataFrame, parent: DataFrame, child_columns: Sequence[str], parent_columns: Sequence[str]) -> DataFrame:
    """Child keys without a parent row and how many child rows hold them. Incomplete keys are not orphans."""
    names = _names(child_columns)
    return key_counts(child, child_columns).join(_keys(parent, parent_columns), names, "left_anti")


def orphan_rows(child: DataFrame, parent: DataFrame, child_columns: Sequence[str], parent_columns: Sequence[str]) -> DataFrame:
    """The child rows themselves; AQE can split a hot child key, because the child is the streamed side."""
    condition = [F.col(f"c.{c}") == F.col(f"p.{p}") for c, p in zip(child_columns, parent_columns, strict=True)]
    keyed = child.alias("c").where(_all_set(child_columns))
    return keyed.join(parent.select(*parent_columns).alias("p"), condition, "left_anti")


def orphan_summary(child: DataFrame, parent: DataFrame, child_columns: Sequence[str], parent_columns: Sequence[str]) -> DataFrame:
    """One row: child_rows with a key, orphan_rows, orphan_keys."""
    names = _names(child_columns)
    parents = _keys(parent, parent_columns).where(_all_set(names)).distinct().withColumn("_found", F.lit(True))
    joined = key_counts(child, child_columns).join(parents, names, "left")
    orphan = F.col("_found").isNull()
    return joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("child_rows"),
        F.coalesce(F.sum(F.when(orphan, F.col("n"))), F.lit(0)).cast("bigint").alias("orphan_rows"),
        F.count_if(orphan).alias("orphan_keys"),
    )


@dataclass(frozen=True)
class Link:
    """A declared key between two tables, by their names."""

    child: str
    child_columns: Sequence[str]
    parent: str
    parent_columns: Sequence[str]

    @property
    def name(self) -> str:
        return f"{self.child}.{','.join(self.child_columns)}->{self.parent}.{','.join(self.parent_columns)}"


def _key_forms(tables: Mapping[str, DataFrame], link: Link) -> tuple[list[Column], list[Column]]:
    """(whole number, text) of either side's key: one integral column as a number, other keys as JSON of types common to both sides."""
    sides = [(tables[link.child], link.child_columns), (tables[link.parent], link.parent_columns)]
    types = [[df.schema[c].dataType for c in columns] for df, columns in sides]
    if len(types[0]) != len(types[1]):
        raise ValueError(f"{link.name}: both sides need the same number of columns")
    if len(types[0]) == 1 and all(isinstance(t[0], T.IntegralType) for t in types):
        return tuple([F.col(columns[0]).cast("bigint"), F.lit(None).cast("string")] for _, columns in sides)

    # Two empty columns brought together show the type that Spark would compare them in.
    pairs = [F.coalesce(F.lit(None).cast(a), F.lit(None).cast(b)) for a, b in zip(*types, strict=True)]
    common = [f.dataType for f in tables[link.child].sparkSession.range(0).select(*pairs).schema.fields]

    def text(columns: Sequence[str]) -> Column:
        values = []
        for i, (column, dtype) in enumerate(zip(columns, common, strict=True)):
            value = F.col(column).cast(dtype)
            if isinstance(dtype, (T.FloatType, T.DoubleType)):
                value = value + F.lit(0.0)  # -0.0 equals 0.0
            values.append(value.alias(f"k{i}"))
        return F.to_json(F.struct(*values))

    return tuple([F.lit(None).cast("bigint"), text(columns)] for _, columns in sides)


def orphan_summaries(tables: Mapping[str, DataFrame], links: Sequence[Link]) -> DataFrame:
    """`orphan_summary` of many links, one row per link with its name: each table is read once for all links it takes part in.

    Keys of one link meet as counts per task, all links in the same exchange. A link between empty tables counts 0.
    """
    wanted: dict[str, list[Column]] = {}
    for at, link in enumerate(links):
        forms = _key_forms(tables, link)
        for name, columns, form, child in ((link.child, link.child_columns, forms[0], 1), (link.parent, link.parent_columns, forms[1], 0)):
            cell = F.struct(F.lit(at).alias("at"), form[0].alias("number"), form[1].alias("text"), F.lit(child).alias("child"))
            wanted.setdefault(name, []).append(F.when(_all_set(columns), cell))
    some = next(iter(tables.values())).sparkSession
    none = some.range(0, len(links), 1, 1).selectExpr("CAST(id AS INT) AS at", "CAST(NULL AS BIGINT) AS number", "CAST(NULL AS STRING) AS text", "CAST(NULL AS INT) AS child")
    met = [tables[name].select(F.inline(F.array_compact(F.array(*cells)))) for name, cells in wanted.items()]
    rows = reduce(DataFrame.unionByName, [none, *met])
    n, parents = F.coalesce(F.sum("child"), F.lit(0)).alias("n"), F.count_if(F.col("child") == 0).alias("parents")
    counted = rows.groupBy("at", "number", "text").agg(n, parents)
    orphan = (F.col("parents") == 0) & (F.col("n") > 0)
    summed = counted.groupBy("at").agg(
        F.sum("n").alias("child_rows"), F.sum(F.when(orphan, F.col("n")).otherwise(0)).alias("orphan_rows"), F.count_if(orphan).alias("orphan_keys")
    )
    names = F.array(*[F.lit(link.name) for link in links])
    return summed.select(F.get(names, F.col("at")).alias("link"), "child_rows", "orphan_rows", "orphan_keys")


def cardinality(child: DataFrame, parent: DataFrame, child_columns: Sequence[str], parent_columns: Sequence[str]) -> DataFrame:
    """One row with the relationship the data shows, from how often a key repeats on either side."""
    sides = key_counts(child, child_columns).select(F.lit("child").alias("side"), "n").unionByName(
        key_counts(parent, parent_columns).select(F.lit("parent").alias("side"), "n")
    )
    most = sides.agg(
        F.coalesce(F.max(F.when(F.col("side") == "child", F.col("n"))), F.lit(0)).alias("child_max"),
        F.coalesce(F.max(F.when(F.col("side") == "parent", F.col("n"))), F.lit(0)).alias("parent_max"),
    )
    many_children, many_parents = F.col("child_max") > 1, F.col("parent_max") > 1
    return most.withColumn(
        "relationship_type",
        F.when(many_children & many_parents, "many-to-many")
        .when(many_children, "many-to-one")
        .when(many_parents, "one-to-many")
        .otherwise("one-to-one"),
    )


def primary_key_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that repeat or are incomplete: the key columns, n, and the reason."""
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    incomplete = ~_all_set(columns)
    return counted.where((F.col("n") > 1) | incomplete).withColumn(
        "reason", F.when(incomplete, F.lit("null")).otherwise(F.lit("duplicate"))
    )
