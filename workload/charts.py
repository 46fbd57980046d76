"""Chart data by intent, and chart options."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.operators import charts as ch
from workload.registry import query, table


def _orders_by_nation(spark, sf_dir):
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )


NATION_SQL = """FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


@query(f"""
WITH t AS (SELECT n_name, round(sum(o_totalprice), 2) AS total {NATION_SQL} GROUP BY n_name)
SELECT *, total = (SELECT max(total) FROM t) AS is_max FROM t""")
def chart_comparison(spark, sf_dir):
    totals = ch.comparison(_orders_by_nation(spark, sf_dir), "n_name", "o_totalprice").withColumn("total", F.round("total", 2))
    return ch.mark_maximum(totals, "total")


@query(f"""SELECT date_trunc('quarter', o_orderdate)::DATE AS period, r_name, round(sum(o_totalprice), 2) AS total {NATION_SQL} GROUP BY ALL""")
def chart_trend(spark, sf_dir):
    points = ch.trend(_orders_by_nation(spark, sf_dir), "o_orderdate", "o_totalprice", "quarter", ["r_name"])
    return points.withColumn("total", F.round("total", 2))


@query("""
WITH r AS (SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem),
b AS (SELECT least(floor((l_extendedprice - low) / ((high - low) / 20)) + 1, 20)::INTEGER AS bin, count(*) AS n FROM lineitem, r GROUP BY ALL)
SELECT bin, round(low + (high - low) / 20 * (bin - 1), 4) AS low, round(low + (high - low) / 20 * bin, 4) AS high, n FROM b, r""")
def chart_histogram(spark, sf_dir):
    bins = ch.distribution(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20)
    return bins.withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS correlation, count(*) AS n FROM lineitem GROUP BY ALL")
def chart_correlation(spark, sf_dir):
    found = ch.correlation(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return found.withColumn("correlation", F.round("correlation", 6))


@query("""
SELECT event_type, round(sum(value), 2) AS total, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY event_type""")
def chart_composition(spark, sf_dir):
    parts = ch.composition(table(spark, sf_dir, "events"), "event_type", "value")
    return parts.withColumns({"total": F.round("total", 2), "share": F.round("share", 6)})


@query(f"""
SELECT r_name, n_name, (2 - (grouping(r_name) + grouping(n_name)))::INTEGER AS depth, round(sum(o_totalprice), 2) AS total
{NATION_SQL} GROUP BY ROLLUP (r_name, n_name)""")
def chart_hierarchy(spark, sf_dir):
    nested = ch.hierarchy(_orders_by_nation(spark, sf_dir), ["r_name", "n_name"], "o_totalprice")
    return nested.withColumn("total", F.round("total", 2))


# An option per event: by type a good series, an unknown property, no type, no object, or an unknown series. The known
# properties are those of the signup events' names.
@query("""
SELECT event_id AS option_id, event_type IN ('view', 'click') AS valid,
  CASE event_type WHEN 'purchase' THEN 'series[0] missing ''type''' WHEN 'error' THEN 'series[0] must be an object|Unknown series type: s' || user_id
    WHEN 'signup' THEN 'Unknown series type: pie' ELSE '' END AS errors,
  CASE event_type WHEN 'click' THEN 'series[0] unknown property ''extra''|series[1] unknown property ''value''' WHEN 'error' THEN '' ELSE '' END AS warnings
FROM events""")
def validate_options(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    user, value = F.col("user_id").cast("string"), F.col("value").cast("string")
    text = (
        F.when(F.col("event_type") == "view", F.format_string('{"series": {"type": "click", "data": [%s]}}', value))
        .when(
            F.col("event_type") == "click",
            F.format_string('{"series": [{"type": "view", "data": [1], "extra": %s}, {"type": "click", "value": 1}]}', user),
        )
        .when(F.col("event_type") == "purchase", F.format_string('{"series": [{"data": [%s]}]}', value))
        .when(F.col("event_type") == "error", F.format_string('{"series": [%s, {"type": "s%s"}]}', value, user))
        .otherwise(F.lit('{"series": [{"type": "pie", "radius": 3}], "title": {}}'))
    )
    options = events.select(F.col("event_id").alias("option_id"), text.alias("option"))
    known = events.select(F.col("event_type").alias("series"), F.lit("data").alias("property")).distinct()
    found = ch.validate_options(options, known)
    return found.withColumns({"errors": F.array_join("errors", "|"), "warnings": F.array_join("warnings", "|")})
