"""Catalog tables of many uploaded databases: definitions, details, spec validation and the relationship graph.

A catalog is a set of flat DataFrames keyed by the `DB` columns:
`columns` (table_name, column_name, ordinal, data_type, is_primary_key[, not_null, default_value]) and
`foreign_keys` (table_name, from_column, to_table, to_column, ordinal[, on_update, on_delete, relationship_type]).
A spec has the same tables plus `tables` (table_name, primary_key array<string>).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DB = ("user_id", "file_id")


def columns_from_tables(spark, tables: Mapping[str, DataFrame], user_id: str, file_id: str, keys: Mapping[str, Sequence[str]]):
    """`columns` rows of one table set. Parquet stores no keys, so the primary keys are given."""
    rows = [
        (user_id, file_id, name, field.name, i, field.dataType.simpleString(), field.name in keys.get(name, ()))
        for name, df in sorted(tables.items())
        for i, field in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(
        rows,
        "user_id string, file_id string, table_name string, column_name string, ordinal int, data_type string,"
        " is_primary_key boolean",
    )


def declared_type(dtype: Column) -> Column:
    """A blank declared type reads as TEXT."""
    return F.when(F.trim(F.coalesce(dtype, F.lit(""))) == "", F.lit("TEXT")).otherwise(dtype)


def describe_tables(columns: DataFrame, foreign_keys: DataFrame, db: Sequence[str] = DB) -> DataFrame:
    """One row per table: columns array, primary_keys array, foreign_keys array (all many-to-one)."""
    by = [*db, "table_name"]
    described = columns.groupBy(*by).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "ordinal", "column_name", declared_type(F.col("data_type")).alias("column_dtype"), "is_primary_key"
                )
            )
        ).alias("columns")
    )
    keys = foreign_keys.groupBy(*by).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "ordinal", "from_column", "to_table", "to_column", F.lit("many-to-one").alias("relationship_type")
                )
            )
        ).alias("foreign_keys")
    )
    primary = F.transform(F.filter("columns", lambda c: c["is_primary_key"]), lambda c: c["column_name"])
    return described.withColumn("primary_keys", primary).join(keys, by, "left")


def table_details(columns: DataFrame, foreign_keys: DataFrame, table_name: str) -> tuple[DataFrame, DataFrame]:
    """Column rows and foreign-key rows of one table name, with defaults and actions."""
    mine = columns.where(F.col("table_name") == table_name)
    if mine.isEmpty():
        raise ValueError(f"Table '{table_name}' not found")
    return mine, foreign_keys.where(F.col("table_name") == table_name)


def normalize_primary_key(key: Column) -> Column:
    """array<string> without blanks."""
    return F.filter(F.coalesce(key, F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("")) != "")


def validate_spec(
    spec_columns: DataFrame,
    spec_keys: DataFrame,
    spec_foreign_keys: DataFrame,
    columns: DataFrame,
    foreign_keys: DataFrame,
    db: Sequence[str] = DB,
) -> DataFrame:
    """(db…, table_name, check, kind, item, expected, found): specs against definitions, one row per disagreement.

    `spec_keys` holds (table_name, primary_key array<string>). Checks below table level run on tables that both
    sides know. Items that either side lists twice count once, with the larger of two types. Everything meets by table in
    one exchange. `issue_texts` turns the rows into sentences.
    """
    by = [*db, "table_name"]
    none = F.lit(None).cast("string")

    def listed(rows: DataFrame, check: str, ours: bool, name: Column, dtype: Column = none, to: Sequence[Column] = (none, none)) -> DataFrame:
        sides = [F.lit(ours).alias("expected"), F.lit(not ours).alias("found")]
        types = [(dtype if ours else none).alias("want"), (none if ours else dtype).alias("got")]
        return rows.select(*by, F.lit(check).alias("check"), name.alias("name"), to[0].alias("to_table"), to[1].alias("to_column"), *sides, *types)

    column, target = F.col("column_name"), (F.col("to_table"), F.col("to_column"))
    keys = spec_keys.select(*by, F.explode(normalize_primary_key(F.col("primary_key"))).alias("column_name"))
    parts = [
        listed(columns, "columns", True, column, F.col("data_type")),
        listed(spec_columns, "columns", False, column, F.col("data_type")),
        listed(columns.where("is_primary_key"), "primary_key", True, column),
        listed(keys, "primary_key", False, column),
        listed(foreign_keys, "foreign_keys", True, F.col("from_column"), to=target),
        listed(spec_foreign_keys, "foreign_keys", False, F.col("from_column"), to=target),
    ]
    item = ["check", "name", "to_table", "to_column"]
    sides = [F.max(c).alias(c) for c in ("expected", "found", "want", "got")]
    items = reduce(DataFrame.unionByName, parts).repartition(*by).groupBy(*by, *item).agg(*sides)

    check, expected, found = F.col("check"), F.col("expected"), F.col("found")
    ordered = Window.partitionBy(*by).orderBy(*item)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def keys_of(side: Column) -> Column:
        return F.sort_array(F.collect_list(F.when((check == "primary_key") & side, F.col("name"))).over(whole))

    # The first item of a table also stands for the table.
    placed = items.withColumns(
        {
            "first": F.row_number().over(ordered) == 1,
            "known": F.max(expected & (check == "columns")).over(whole),
            "specced": F.max(found & (check == "columns")).over(whole),
            "want_keys": keys_of(expected),
            "got_keys": keys_of(found),
        }
    )
    known, specced, first = F.col("known"), F.col("specced"), F.col("first")
    one_sided = F.when(expected, "missing").otherwise("extra")
    mismatch = F.lit("mismatch")

    def issue(when: Column, name: str, kind: Column, what: Column, want: Column = none, got: Column = none) -> Column:
        values = [F.lit(name).alias("check"), kind.alias("kind"), what.alias("item"), want.alias("expected"), got.alias("found")]
        return F.when(when, F.struct(*values))

    both, differ = known & specced, expected != found
    want, got = F.col("want"), F.col("got")
    link = F.format_string("%s->%s.%s", "name", "to_table", "to_column")
    issues = [
        issue(first & (known != specced), "tables", F.when(known, "missing").otherwise("extra"), F.col("table_name")),
        issue(
            first & both & (F.col("want_keys") != F.col("got_keys")),
            "primary_key",
            mismatch,
            none,
            F.array_join("want_keys", ", "),
            F.array_join("got_keys", ", "),
        ),
        issue(both & (check == "columns") & differ, "columns", one_sided, F.col("name")),
        issue(
            both & (check == "columns") & ~differ & (F.upper(F.coalesce(want, F.lit(""))) != F.upper(F.coalesce(got, F.lit("")))),
            "types",
            mismatch,
            F.col("name"),
            want,
            got,
        ),
        issue(both & (check == "foreign_keys") & differ, "foreign_keys", one_sided, link),
    ]
    return placed.select(*by, F.inline(F.array_compact(F.array(*issues))))


def issue_texts(issues: DataFrame, db: Sequence[str] = DB) -> DataFrame:
    """(db…, table_name, issue): one sentence per table and check, its items in order. Table checks are per database."""
    table = F.when(F.col("check") != "tables", F.col("table_name"))
    item = F.when(
        F.col("check") == "types", F.format_string("%s (expected %s, got %s)", "item", "expected", "found")
    ).otherwise(F.col("item"))
    grouped = (
        issues.select(
            *db,
            table.alias("table_name"),
            "check",
            "kind",
            item.alias("item"),
            F.when(F.col("check") == "primary_key", F.col("expected")).alias("expected"),
            F.when(F.col("check") == "primary_key", F.col("found")).alias("found"),
        )
        .groupBy(*db, "table_name", "check", "kind", "expected", "found")
        .agg(F.array_join(F.sort_array(F.collect_set("item")), ", ").alias("items"))
    )
    what = F.replace("check", F.lit("_"), F.lit(" "))
    lead = F.when(F.col("kind") == "missing", "missing ").otherwise("unexpected ")
    text = (
        F.when(
            F.col("check") == "tables",
            F.concat(F.when(F.col("kind") == "missing", "Missing tables: ").otherwise("Unexpected tables: "), "items"),
        )
        .when(F.col("check") == "types", F.concat("table_name", F.lit(": column_dtype mismatch for "), "items"))
        .when(
            F.col("check") == "primary_key",
            F.format_string("%s: primary_key mismatch (expected [%s], got [%s])", "table_name", "expected", "found"),
        )
        .otherwise(F.concat("table_name", F.lit(": "), lead, what, F.lit(" "), "items"))
    )
    return grouped.select(*db, "table_name", text.alias("issue"))


def _properties(**values: Column) -> Column:
    pairs = [F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in values.items()]
    return F.map_from_entries(F.array(*pairs))


def _node(db: Sequence[str], node_id: Column, kind: str, **values: Column) -> list[Column | str]:
    return [*db, node_id.alias("id"), F.lit(kind).alias("type"), _properties(**values).alias("properties")]


def _edge(db: Sequence[str], kind: str, source: Column, target: Column, **values: Column) -> list[Column | str]:
    properties = _properties(**values) if values else F.create_map().cast("map<string,string>")
    return [*db, F.lit(kind).alias("type"), source.alias("from_id"), target.alias("to_id"), properties.alias("properties")]


def _table_id(name: str) -> Column:
    return F.concat(F.lit("table:"), F.col(name))


def _column_id(table: str, column: str) -> Column:
    return F.concat(F.lit("column:"), F.col(table), F.lit("."), F.col(column))


def relationship_graph(
    tables: DataFrame,
    columns: DataFrame,
    foreign_keys: DataFrame,
    include_columns: bool = False,
    db: Sequence[str] = DB,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of specs. `foreign_keys` has fk_index and from_columns / to_columns arrays (composite keys).

    A REFERENCES edge is kept even if its target table is absent; FK_COLUMN edges need both columns to exist.
    """
    nodes = tables.select(*_node(db, _table_id("table_name"), "Table", name=F.col("table_name")))
    references = foreign_keys.where(F.coalesce("to_table", F.lit("")) != "")
    edges = references.select(
        *_edge(
            db,
            "REFERENCES",
            _table_id("table_name"),
            _table_id("to_table"),
            from_columns=F.array_join("from_columns", ","),
            to_columns=F.array_join("to_columns", ","),
            relationship_type=F.col("relationship_type"),
        )
    )
    if not include_columns:
        return nodes, edges

    column_id = _column_id("table_name", "column_name")
    nodes = nodes.unionByName(
        columns.select(
            *_node(
                db, column_id, "Column", table=F.col("table_name"), name=F.col("column_name"), data_type=F.col("data_type")
            )
        )
    )
    has = columns.select(*_edge(db, "HAS_COLUMN", _table_id("table_name"), column_id))
    pairs = references.select(
        *db, "table_name", "to_table", "fk_index", F.posexplode(F.arrays_zip("from_columns", "to_columns")).alias("ordinal", "pair")
    ).select(*db, "fk_index", "ordinal", "table_name", F.col("pair.from_columns").alias("from_column"), "to_table", F.col("pair.to_columns").alias("to_column"))
    existing = columns.select(*db, "table_name", "column_name").distinct()
    source = existing.withColumnsRenamed({"column_name": "from_column"})
    target = existing.withColumnsRenamed({"table_name": "to_table", "column_name": "to_column"})
    pairs = pairs.join(source, [*db, "table_name", "from_column"], "left_semi").join(
        target, [*db, "to_table", "to_column"], "left_semi"
    )
    linked = pairs.select(
        *_edge(
            db,
            "FK_COLUMN",
            _column_id("table_name", "from_column"),
            _column_id("to_table", "to_column"),
            ordinal=F.col("ordinal"),
            fk_index=F.col("fk_index"),
        )
    )
    return nodes, edges.unionByName(has).unionByName(linked)


def declared_key_graph(tables: DataFrame, foreign_keys: DataFrame, db: Sequence[str] = DB) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from declared keys when there is no spec; edges to absent tables are dropped."""
    nodes = tables.select(*_node(db, _table_id("table_name"), "Table", name=F.col("table_name")))
    targets = tables.select(*db, F.col("table_name").alias("to_table")).distinct()
    edges = foreign_keys.join(targets, [*db, "to_table"], "left_semi").select(
        *_edge(
            db,
            "REFERENCES",
            _table_id("table_name"),
            _table_id("to_table"),
            from_column=F.col("from_column"),
            to_column=F.col("to_column"),
            ordinal=F.col("ordinal"),
        )
    )
    return nodes, edges
