"""Catalog checks over many databases, and guarded SQL.

The databases are made from lineitem: a supplier's file holds a table per return flag and line status with a column per
line number. The definitions come from all lines, the specs from discounted lines, so both grow with the data and
disagree in places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators import catalog
from lodestack.operators.sql import open_database, run_readonly_sql
from workload.registry import query, table

DB_SQL = """
WITH lines AS (
  SELECT 'u' || (l_suppkey // 10) AS user_id, 'f' || l_suppkey AS file_id,
         't' || l_returnflag || l_linestatus AS table_name, l_linenumber, l_quantity, l_tax, l_discount,
         t_to
  FROM (SELECT *, CASE WHEN l_quantity > 25 THEN 'tAF' WHEN l_quantity > 10 THEN 'tRO' ELSE 'tXX' END AS t_to FROM lineitem)),
columns AS (
  SELECT user_id, file_id, table_name, 'c' || l_linenumber AS column_name, l_linenumber AS ordinal,
         CASE WHEN max(l_quantity) > 45 THEN 'REAL' WHEN min(l_tax) = 0 THEN '' ELSE 'INTEGER' END AS data_type,
         l_linenumber = 1 AS is_primary_key
  FROM lines GROUP BY ALL),
foreign_keys AS (
  SELECT user_id, file_id, table_name, 'c' || l_linenumber AS from_column, min(t_to) AS to_table,
         'c1' AS to_column, l_linenumber AS ordinal
  FROM lines WHERE l_linenumber > 4 GROUP BY user_id, file_id, table_name, l_linenumber),
cheap AS (SELECT * FROM lines WHERE l_discount >= 0.07),
spec_columns AS (
  SELECT user_id, file_id, table_name, 'c' || n AS column_name, n AS ordinal,
         CASE WHEN max(l_quantity) > 45 THEN 'real' ELSE 'INTEGER' END AS data_type
  FROM (SELECT *, l_linenumber + CASE WHEN l_tax >= 0.08 THEN 1 ELSE 0 END AS n FROM cheap) GROUP BY user_id, file_id, table_name, n),
spec_keys AS (
  SELECT user_id, file_id, table_name,
         CASE WHEN max(l_quantity) > 48 THEN ['c1', ''] ELSE ['c2', 'c1'] END AS primary_key
  FROM cheap GROUP BY user_id, file_id, table_name),
spec_foreign_keys AS (
  SELECT user_id, file_id, table_name, 'c' || l_linenumber AS from_column, min(t_to) AS to_table,
         'c1' AS to_column, l_linenumber AS ordinal
  FROM cheap WHERE l_linenumber > 4 GROUP BY user_id, file_id, table_name, l_linenumber)
"""

BY = ["user_id", "file_id", "table_name"]


def databases(spark, sf_dir) -> dict[str, DataFrame]:
    """The frames of DB_SQL."""
    quantity = F.col("l_quantity")
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("u"), F.expr("l_suppkey div 10").cast("string")).alias("user_id"),
        F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("file_id"),
        F.concat(F.lit("t"), "l_returnflag", "l_linestatus").alias("table_name"),
        "l_linenumber",
        "l_quantity",
        "l_tax",
        "l_discount",
        F.when(quantity > 25, "tAF").when(quantity > 10, "tRO").otherwise("tXX").alias("t_to"),
    )
    cheap = lines.where(F.col("l_discount") >= 0.07)
    c = lambda n: F.concat(F.lit("c"), F.col(n).cast("string"))

    def links(rows: DataFrame) -> DataFrame:
        late = rows.where(F.col("l_linenumber") > 4)
        return late.groupBy(*BY, "l_linenumber").agg(F.min("t_to").alias("to_table")).select(
            *BY, c("l_linenumber").alias("from_column"), "to_table", F.lit("c1").alias("to_column"), F.col("l_linenumber").alias("ordinal")
        )

    columns = lines.groupBy(*BY, "l_linenumber").agg(
        F.when(F.max("l_quantity") > 45, "REAL").when(F.min("l_tax") == 0, "").otherwise("INTEGER").alias("data_type")
    )
    spec = cheap.withColumn("n", F.col("l_linenumber") + F.when(F.col("l_tax") >= 0.08, 1).otherwise(0))
    spec_columns = spec.groupBy(*BY, "n").agg(F.when(F.max("l_quantity") > 45, "real").otherwise("INTEGER").alias("data_type"))
    two = F.when(F.max("l_quantity") > 48, F.array(F.lit("c1"), F.lit(""))).otherwise(F.array(F.lit("c2"), F.lit("c1")))
    return {
        "columns": columns.select(
            *BY, c("l_linenumber").alias("column_name"), F.col("l_linenumber").alias("ordinal"), "data_type",
            (F.col("l_linenumber") == 1).alias("is_primary_key"),
        ),
        "foreign_keys": links(lines),
        "spec_columns": spec_columns.select(*BY, c("n").alias("column_name"), F.col("n").alias("ordinal"), "data_type"),
        "spec_keys": cheap.groupBy(*BY).agg(two.alias("primary_key")),
        "spec_foreign_keys": links(cheap),
    }


@query(DB_SQL + """
SELECT c.user_id, c.file_id, c.table_name, c.columns, k.foreign_keys, c.primary_keys FROM
 (SELECT user_id, file_id, table_name,
   string_agg(column_name || ' ' || CASE WHEN data_type = '' THEN 'TEXT' ELSE data_type END, ',' ORDER BY ordinal) AS columns,
   coalesce(string_agg(column_name, ',' ORDER BY ordinal) FILTER (WHERE is_primary_key), '') AS primary_keys
  FROM columns GROUP BY ALL) c
 LEFT JOIN (SELECT user_id, file_id, table_name,
   string_agg(from_column || '->' || to_table || '.' || to_column || ' many-to-one', ',' ORDER BY ordinal) AS foreign_keys
  FROM foreign_keys GROUP BY ALL) k USING (user_id, file_id, table_name)""")
def table_columns(spark, sf_dir):
    db = databases(spark, sf_dir)
    described = catalog.describe_tables(db["columns"], db["foreign_keys"])
    pair = lambda c: F.concat_ws(" ", c["column_name"], c["column_dtype"])
    link = lambda k: F.concat(k["from_column"], F.lit("->"), k["to_table"], F.lit("."), k["to_column"], F.lit(" "), k["relationship_type"])
    return described.select(
        *BY,
        F.array_join(F.transform("columns", pair), ",").alias("columns"),
        F.array_join(F.transform("foreign_keys", link), ",").alias("foreign_keys"),
        F.array_join("primary_keys", ",").alias("primary_keys"),
    )


@query(DB_SQL + """
SELECT user_id, file_id, column_name, ordinal, CASE WHEN data_type = '' THEN 'TEXT' ELSE data_type END AS data_type,
       is_primary_key, to_table, to_column
FROM columns LEFT JOIN (SELECT user_id, file_id, table_name, from_column AS column_name, to_table, to_column FROM foreign_keys)
 USING (user_id, file_id, table_name, column_name) WHERE table_name = 'tRF'""")
def table_details(spark, sf_dir):
    db = databases(spark, sf_dir)
    columns, links = catalog.table_details(db["columns"], db["foreign_keys"], "tRF")
    links = links.select(*BY, F.col("from_column").alias("column_name"), "to_table", "to_column")
    joined = columns.join(links, [*BY, "column_name"], "left")
    return joined.withColumn("data_type", catalog.declared_type(F.col("data_type"))).drop("table_name")


# What a definition says of nulls, defaults and actions, from the lines behind a column or link.
@query("""
WITH lines AS (SELECT 'u' || (l_suppkey // 10) AS user_id, 'f' || l_suppkey AS file_id, l_linenumber AS n, l_quantity, l_tax
  FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'),
columns AS (SELECT user_id, file_id, 'c' || n AS column_name, n AS ordinal, min(l_tax) > 0 AS not_null,
    CASE WHEN max(l_quantity) < 40 THEN 'v' || max(l_quantity)::INTEGER END AS default_value FROM lines GROUP BY ALL),
links AS (SELECT user_id, file_id, 'c' || n AS column_name, CASE WHEN max(l_tax) > 0.07 THEN 'CASCADE' ELSE 'NO ACTION' END AS on_update,
    CASE WHEN min(l_quantity) < 5 THEN 'SET NULL' ELSE 'RESTRICT' END AS on_delete FROM lines WHERE n > 4 GROUP BY ALL)
SELECT user_id, file_id, column_name, ordinal, not_null, default_value, on_update, on_delete
FROM columns LEFT JOIN links USING (user_id, file_id, column_name)""")
def table_details_defaults(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("u"), F.expr("l_suppkey div 10").cast("string")).alias("user_id"),
        F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("file_id"),
        F.concat(F.lit("t"), "l_returnflag", "l_linestatus").alias("table_name"),
        F.col("l_linenumber").alias("ordinal"),
        "l_quantity",
        "l_tax",
    )
    most = F.max("l_quantity")
    name = F.concat(F.lit("c"), F.col("ordinal").cast("string"))
    columns = lines.groupBy(*BY, "ordinal").agg(
        (F.min("l_tax") > 0).alias("not_null"),
        F.when(most < 40, F.concat(F.lit("v"), most.cast("int").cast("string"))).alias("default_value"),
    )
    keys = lines.where(F.col("ordinal") > 4).groupBy(*BY, "ordinal").agg(
        F.when(F.max("l_tax") > 0.07, "CASCADE").otherwise("NO ACTION").alias("on_update"),
        F.when(F.min("l_quantity") < 5, "SET NULL").otherwise("RESTRICT").alias("on_delete"),
    )
    mine, links = catalog.table_details(columns.withColumn("column_name", name), keys.withColumn("column_name", name), "tRF")
    return mine.join(links.drop("ordinal"), [*BY, "column_name"], "left").drop("table_name")


ISSUES_SQL = DB_SQL + """, known AS (SELECT DISTINCT user_id, file_id, table_name FROM columns),
specced AS (SELECT DISTINCT user_id, file_id, table_name FROM spec_columns),
common AS (SELECT * FROM known INTERSECT SELECT * FROM specced),
ours AS (SELECT * FROM columns SEMI JOIN common USING (user_id, file_id, table_name)),
theirs AS (SELECT * FROM spec_columns SEMI JOIN common USING (user_id, file_id, table_name)),
oc AS (SELECT user_id, file_id, table_name, column_name FROM ours),
tc AS (SELECT user_id, file_id, table_name, column_name FROM theirs),
ok AS (SELECT user_id, file_id, table_name, from_column || '->' || to_table || '.' || to_column AS item
  FROM foreign_keys SEMI JOIN common USING (user_id, file_id, table_name)),
tk AS (SELECT user_id, file_id, table_name, from_column || '->' || to_table || '.' || to_column AS item
  FROM spec_foreign_keys SEMI JOIN common USING (user_id, file_id, table_name)),
keys AS (SELECT c.user_id, c.file_id, c.table_name,
   coalesce((SELECT list(column_name ORDER BY column_name) FROM ours o WHERE o.is_primary_key AND o.file_id = c.file_id AND o.table_name = c.table_name), []) AS want,
   coalesce((SELECT list_sort(list_filter(primary_key, lambda x: x <> '')) FROM spec_keys s WHERE s.file_id = c.file_id AND s.table_name = c.table_name), []) AS got
  FROM common c),
issues AS (
 SELECT *, 'tables' AS "check", 'missing' AS kind, table_name AS item, NULL AS expected, NULL AS found FROM (FROM known EXCEPT FROM specced)
 UNION ALL SELECT *, 'tables', 'extra', table_name, NULL, NULL FROM (FROM specced EXCEPT FROM known)
 UNION ALL SELECT user_id, file_id, table_name, 'columns', 'missing', column_name, NULL, NULL FROM (FROM oc EXCEPT FROM tc)
 UNION ALL SELECT user_id, file_id, table_name, 'columns', 'extra', column_name, NULL, NULL FROM (FROM tc EXCEPT FROM oc)
 UNION ALL SELECT user_id, file_id, table_name, 'types', 'mismatch', column_name, o.data_type, t.data_type
   FROM ours o JOIN theirs t USING (user_id, file_id, table_name, column_name) WHERE upper(o.data_type) <> upper(t.data_type)
 UNION ALL SELECT user_id, file_id, table_name, 'primary_key', 'mismatch', NULL, array_to_string(want, ', '), array_to_string(got, ', ')
   FROM keys WHERE want <> got
 UNION ALL SELECT user_id, file_id, table_name, 'foreign_keys', 'missing', item, NULL, NULL FROM (FROM ok EXCEPT FROM tk)
 UNION ALL SELECT user_id, file_id, table_name, 'foreign_keys', 'extra', item, NULL, NULL FROM (FROM tk EXCEPT FROM ok))
"""


def _issues(spark, sf_dir) -> DataFrame:
    db = databases(spark, sf_dir)
    return catalog.validate_spec(
        db["spec_columns"], db["spec_keys"], db["spec_foreign_keys"], db["columns"], db["foreign_keys"]
    )


@query(ISSUES_SQL + "SELECT * FROM issues")
def validate_spec(spark, sf_dir):
    return _issues(spark, sf_dir)


@query(ISSUES_SQL + """
SELECT user_id, file_id, NULL::VARCHAR AS table_name,
  CASE kind WHEN 'missing' THEN 'Missing tables: ' ELSE 'Unexpected tables: ' END || string_agg(item, ', ' ORDER BY item) AS issue
FROM issues WHERE "check" = 'tables' GROUP BY user_id, file_id, kind
UNION ALL
SELECT user_id, file_id, table_name, table_name || CASE WHEN "check" = 'types' THEN ': column_dtype mismatch for '
  ELSE CASE kind WHEN 'missing' THEN ': missing ' ELSE ': unexpected ' END || replace("check", '_', ' ') || ' ' END ||
  string_agg(CASE WHEN "check" = 'types' THEN item || ' (expected ' || expected || ', got ' || found || ')' ELSE item END, ', ' ORDER BY item)
FROM issues WHERE "check" IN ('columns', 'types', 'foreign_keys') GROUP BY user_id, file_id, table_name, "check", kind
UNION ALL
SELECT user_id, file_id, table_name, table_name || ': primary_key mismatch (expected [' || expected || '], got [' || found || '])'
FROM issues WHERE "check" = 'primary_key'""")
def spec_issue_texts(spark, sf_dir):
    return catalog.issue_texts(_issues(spark, sf_dir))


def _graph_rows(nodes: DataFrame, edges: DataFrame, *names: str) -> DataFrame:
    """Nodes and edges as one flat table; the properties become text in a fixed order."""
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    none = F.lit(None).cast("string")
    return nodes.select("user_id", "file_id", "type", "id", none.alias("to_id"), shown.alias("properties")).unionByName(
        edges.select("user_id", "file_id", "type", F.col("from_id").alias("id"), "to_id", shown.alias("properties"))
    )


@query(DB_SQL + """
, tabs AS (SELECT DISTINCT user_id, file_id, table_name FROM spec_columns)
SELECT user_id, file_id, 'Table' AS type, 'table:' || table_name AS id, NULL AS to_id, 'name=' || table_name AS properties FROM tabs
UNION ALL SELECT user_id, file_id, 'Column', 'column:' || table_name || '.' || column_name, NULL,
  'data_type=' || data_type || ';name=' || column_name || ';table=' || table_name FROM spec_columns
UNION ALL SELECT user_id, file_id, 'HAS_COLUMN', 'table:' || table_name, 'column:' || table_name || '.' || column_name, '' FROM spec_columns
UNION ALL SELECT user_id, file_id, 'REFERENCES', 'table:' || table_name, 'table:' || to_table,
  'from_columns=' || from_column || ',c2;relationship_type=many-to-one;to_columns=c1,c3' FROM spec_foreign_keys
UNION ALL SELECT f.user_id, f.file_id, 'FK_COLUMN', 'column:' || f.table_name || '.' || f.a, 'column:' || f.to_table || '.' || f.b,
  'fk_index=' || f.ordinal || ';ordinal=' || f.o
  FROM (SELECT *, from_column AS a, 'c1' AS b, 0 AS o FROM spec_foreign_keys
        UNION ALL SELECT *, 'c2', 'c3', 1 FROM spec_foreign_keys) f
  SEMI JOIN spec_columns s ON s.file_id = f.file_id AND s.table_name = f.table_name AND s.column_name = f.a
  SEMI JOIN spec_columns t ON t.file_id = f.file_id AND t.table_name = f.to_table AND t.column_name = f.b""")
def relationship_graph(spark, sf_dir):
    db = databases(spark, sf_dir)
    links = db["spec_foreign_keys"].select(
        *BY,
        "to_table",
        F.col("ordinal").alias("fk_index"),
        F.lit("many-to-one").alias("relationship_type"),
        F.array("from_column", F.lit("c2")).alias("from_columns"),
        F.array(F.lit("c1"), F.lit("c3")).alias("to_columns"),
    )
    tables = db["spec_columns"].select(*BY).distinct()
    return _graph_rows(*catalog.relationship_graph(tables, db["spec_columns"], links, include_columns=True))


@query(DB_SQL + """
, tabs AS (SELECT DISTINCT user_id, file_id, table_name FROM columns)
SELECT user_id, file_id, 'Table' AS type, 'table:' || table_name AS id, NULL AS to_id, 'name=' || table_name AS properties FROM tabs
UNION ALL SELECT user_id, file_id, 'REFERENCES', 'table:' || table_name, 'table:' || to_table,
  'from_column=' || from_column || ';ordinal=' || ordinal || ';to_column=' || to_column
  FROM foreign_keys f WHERE EXISTS (SELECT 1 FROM tabs t WHERE t.file_id = f.file_id AND t.table_name = f.to_table)""")
def declared_key_graph(spark, sf_dir):
    db = databases(spark, sf_dir)
    return _graph_rows(*catalog.declared_key_graph(db["columns"].select(*BY).distinct(), db["foreign_keys"]))


INNER = """
SELECT n.n_name, c.c_mktsegment, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total
FROM orders o INNER JOIN customer c ON c.c_custkey = o.o_custkey INNER JOIN nation n ON n.n_nationkey = c.c_nationkey
GROUP BY n.n_name, c.c_mktsegment"""
LEFT = """
SELECT c.c_custkey, c.c_name, count(o.o_orderkey) AS urgent_orders
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT'
GROUP BY c.c_custkey, c.c_name"""
PREVIOUS_MONTH = """
SELECT o_orderstatus, count(*) AS orders
FROM orders
WHERE o_orderdate >= (SELECT date_trunc('month', max(o_orderdate)) - INTERVAL 1 MONTH FROM orders)
  AND o_orderdate < (SELECT date_trunc('month', max(o_orderdate)) FROM orders)
GROUP BY o_orderstatus"""


def _sql(spark, sf_dir, text: str) -> DataFrame:
    return run_readonly_sql(open_database(spark, sf_dir), text)


@query(INNER)
def sql_inner_join_agg(spark, sf_dir):
    return _sql(spark, sf_dir, INNER)


@query(LEFT)
def sql_left_join_on_filter(spark, sf_dir):
    return _sql(spark, sf_dir, LEFT)


@query(PREVIOUS_MONTH)
def sql_previous_month_count(spark, sf_dir):
    return _sql(spark, sf_dir, PREVIOUS_MONTH)
