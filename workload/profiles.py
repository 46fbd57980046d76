"""Profiles, samples, casts and key checks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.casts import cast_by_name
from lodestack.operators import keys, profile
from lodestack.operators import sample as samples
from lodestack.session import shared_folder
from lodestack.sources.tables import TableSet
from workload.registry import query, table

# Events with the gaps a real upload has: missing and empty labels, missing and NaN scores.
GAPPY_SQL = """
SELECT event_id, user_id,
       CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN '' ELSE event_type END AS label,
       CASE WHEN value < 2 THEN 'NaN'::DOUBLE WHEN value > 40 THEN NULL ELSE value END AS score
FROM events"""


def gappy(spark, sf_dir) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.when(kind == "view", "").when(kind != "error", kind).alias("label"),
        F.when(value < 2, F.lit(float("nan"))).when(value <= 40, value).alias("score"),
    )


def _each(template: str, items: list[dict[str, str]]) -> str:
    return "\nUNION ALL ".join(template.format(**item) for item in items)


@query(
    f"WITH g AS ({GAPPY_SQL})\n"
    + _each(
        """SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) AS total_rows,
       count(*) FILTER (WHERE {c} IS NULL OR {nan}) AS null_count, count(*) FILTER (WHERE {nan}) AS nan_count,
       count(DISTINCT CASE WHEN NOT ({nan}) THEN {c} END) AS unique_count FROM g""",
        [
            {"c": "event_id", "t": "bigint", "nan": "false"},
            {"c": "user_id", "t": "bigint", "nan": "false"},
            {"c": "label", "t": "string", "nan": "false"},
            {"c": "score", "t": "double", "nan": "coalesce(isnan(score), false)"},
        ],
    )
)
def dataset_column_stats(spark, sf_dir):
    return profile.dataset_column_stats(gappy(spark, sf_dir))


NUMERIC = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()


@query(
    _each(
        """SELECT '{c}' AS column_name, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
       round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std FROM lineitem""",
        [{"c": c} for c in NUMERIC],
    )
)
def numeric_summary(spark, sf_dir):
    stats = profile.numeric_summary(table(spark, sf_dir, "lineitem"))
    return stats.select("column_name", "min", "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


TOP = [("lineitem", "l_quantity"), ("orders", "o_orderpriority"), ("part", "p_brand"), ("events", "user_id")]


@query(
    _each(
        """(SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS n,
       round(count(*) / (SELECT count(*) FROM {t}), 8) AS pct
FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} LIMIT 10)""",
        [{"t": t, "c": c} for t, c in TOP],
    )
)
def top_values(spark, sf_dir):
    parts = [
        profile.top_values(table(spark, sf_dir, t), c).select(
            F.lit(c).alias("column_name"), F.col("value").cast("string").alias("value"), "n", F.round("pct", 8).alias("pct")
        )
        for t, c in TOP
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    _each(
        """(WITH v AS (SELECT {c} AS value, count(*) AS frequency FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}),
 r AS (SELECT *, row_number() OVER (ORDER BY frequency DESC, value) AS p, count(*) OVER () AS d FROM v)
SELECT '{c}' AS column_name, value::VARCHAR AS value, frequency,
       round(frequency / (SELECT count(*) FROM {t}) * 100, 6) AS frequency_pct
FROM r WHERE p <= least(10, greatest(1, ceil(d * 0.2))))""",
        [{"t": t, "c": c} for t, c in TOP],
    )
)
def table_top_values(spark, sf_dir):
    parts = [
        profile.table_top_values(table(spark, sf_dir, t), c).select(
            F.lit(c).alias("column_name"),
            F.col("value").cast("string").alias("value"),
            "frequency",
            F.round("frequency_pct", 6).alias("frequency_pct"),
        )
        for t, c in TOP
    ]
    return reduce(DataFrame.unionByName, parts)


STATS = """SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count,
 count(*) FILTER (WHERE {c} IS NULL) AS null_count,
 round(count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100, 6) AS null_pct,
 count(*) FILTER (WHERE {empty}) AS empty_string_count,
 round(count(*) FILTER (WHERE {empty}) / count(*) * 100, 6) AS empty_string_pct,
 count(*) FILTER (WHERE {nan}) AS nan_count,
 round(count(*) FILTER (WHERE {nan}) / count(*) * 100, 6) AS nan_pct,
 count(DISTINCT {c}) AS distinct_count FROM {t}"""


def _rounded(stats: DataFrame) -> DataFrame:
    percents = ["null_pct", "empty_string_pct", "nan_pct"]
    return stats.withColumns({c: F.round(c, 6) for c in percents})


def _stats_sql(name: str, column: str, dtype: str) -> dict[str, str]:
    return {
        "t": name,
        "c": column,
        "empty": f"{column} = ''" if dtype == "string" else "false",
        "nan": f"isnan({column})" if dtype == "double" else "false",
    }


@query(
    f"WITH gappy AS ({GAPPY_SQL})\n"
    + _each(STATS, [_stats_sql("gappy", "label", "string"), _stats_sql("gappy", "score", "double")])
)
def table_column_stats(spark, sf_dir):
    return _rounded(profile.table_column_stats(gappy(spark, sf_dir), "gappy", ["label", "score"]))


PROFILED = {
    "customer": "c_custkey c_name:string c_nationkey c_acctbal:double c_mktsegment:string",
    "orders": "o_orderkey o_custkey o_orderstatus:string o_totalprice:double o_orderdate o_orderpriority:string",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity:double l_extendedprice:double l_discount:double"
    " l_tax:double l_returnflag:string l_linestatus:string l_shipdate",
    "events": "event_id ts user_id event_type:string value:double props:string",
    "documents": "doc_id text:string lang:string source:string n_chars",
    "region": "r_regionkey r_name:string",
    "nation": "n_nationkey n_name:string n_regionkey",
    "supplier": "s_suppkey s_name:string s_nationkey s_acctbal:double",
    "part": "p_partkey p_name:string p_brand:string p_type:string p_size p_retailprice:double",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url:string html:string",
    "benchmark": "item_id text:string",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role:string text:string",
}
PROFILED_COLUMNS = [(t, *(c.split(":") + [""])[:2]) for t, columns in PROFILED.items() for c in columns.split()]


@query(_each(STATS, [_stats_sql(*c) for c in PROFILED_COLUMNS]))
def profile_all_columns(spark, sf_dir):
    tables = TableSet.from_folder(spark, sf_dir, list(PROFILED))
    return _rounded(profile.profile_all(tables))


SKETCH = STATS.rsplit("count(DISTINCT", 1)[0].rstrip().rstrip(",")


@query(_each(SKETCH + " FROM {t}", [_stats_sql(*c) for c in PROFILED_COLUMNS]))
def profile_sketch(spark, sf_dir):
    tables = TableSet.from_folder(spark, sf_dir, list(PROFILED))
    # The estimate itself has no exact oracle; a test bounds its error.
    return _rounded(profile.profile_all(tables, approx=True)).drop("distinct_count")


BATCHED = {"lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id"}
BATCHED_SQL = [_stats_sql(*c) for c in PROFILED_COLUMNS if c[0] in BATCHED]


@query(_each(SKETCH + ", true AS distinct_close FROM {t}", BATCHED_SQL))
def profile_batches(spark, sf_dir):
    """Sketches stored batch by batch and merged; the estimates are held against the exact counts, within four standard errors."""
    path = f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}"
    parts = []
    for name, key in BATCHED.items():
        rows = table(spark, sf_dir, name)
        for batch in range(3):
            profile.column_sketches(rows.where(F.col(key) % 3 == batch)).write.parquet(f"{path}/{name}/batch={batch}")
        merged = profile.merge_sketches(spark.read.parquet(f"{path}/{name}"))
        parts.append(profile.profile_from_sketches(merged, name))
    keys = ["table_name", "column_name"]
    exact = profile.profile_all(TableSet.from_folder(spark, sf_dir, list(BATCHED))).select(*keys, F.col("distinct_count").alias("exact"))
    both = _rounded(reduce(DataFrame.unionByName, parts)).join(exact, keys)
    close = F.abs(F.col("distinct_count") - F.col("exact")) <= F.col("exact") * 0.065
    return both.withColumn("distinct_close", close).drop("distinct_count", "exact")


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def sample_head(spark, sf_dir):
    return samples.sample(table(spark, sf_dir, "orders"), "o_orderkey", "head")


@query("SELECT * FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 5) ORDER BY o_orderkey")
def sample_tail(spark, sf_dir):
    return samples.sample(table(spark, sf_dir, "orders"), "o_orderkey", "TAIL")


SAMPLED = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
}


@query(
    _each(
        """SELECT '{t}' AS table_name, to_json({t})::VARCHAR AS row_json
FROM (SELECT * FROM {t} ORDER BY {k} LIMIT 3) AS {t}""",
        [{"t": t, "k": k} for t, k in SAMPLED.items()],
    )
)
def sample_all_tables(spark, sf_dir):
    tables = TableSet.from_folder(spark, sf_dir, list(SAMPLED))
    return samples.sample_all_tables(tables, SAMPLED)


TYPED = {"orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "customer": "c_custkey"}
TYPED_COLUMNS = {
    "orders": "o_orderkey:int o_custkey:int o_orderstatus:text o_totalprice:float o_orderdate:object o_orderpriority:text",
    "events": "event_id:int ts:object user_id:int event_type:text value:float props:text",
    "documents": "doc_id:int text:text lang:text source:text n_chars:int",
    "customer": "c_custkey:int c_name:text c_nationkey:int c_acctbal:float c_mktsegment:text",
}


@query(
    _each(
        """SELECT '{t}' AS table_name, '{c}' AS column_name,
 coalesce((SELECT {label} FROM {t} WHERE {c} IS NOT NULL ORDER BY {k} LIMIT 1), 'unknown') AS sample_type""",
        [
            {
                "t": t,
                "k": TYPED[t],
                "c": c.split(":")[0],
                "label": f"CASE WHEN regexp_matches({c.split(':')[0]}, '[-/:]') THEN 'datetime' ELSE 'str' END"
                if c.endswith(":text")
                else f"'{c.split(':')[1]}'",
            }
            for t, columns in TYPED_COLUMNS.items()
            for c in columns.split()
        ],
    )
)
def sample_types(spark, sf_dir):
    parts = [
        samples.infer_sample_types(table(spark, sf_dir, t), key).select(F.lit(t).alias("table_name"), "*")
        for t, key in TYPED.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query("""
SELECT o_orderkey, o_orderdate::DATE AS o_orderdate, o_totalprice::DECIMAL(18,2) AS o_totalprice,
       min(l_shipdate)::DATE AS first_shipdate, max(l_shipdate)::TIMESTAMP AS shipped_at
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def cast_columns(spark, sf_dir):
    text = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    grouped = text.groupBy("o_orderkey", F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_totalprice").agg(
        F.min("l_shipdate").cast("string").alias("first_shipdate"), F.max("l_shipdate").cast("string").alias("shipped_at")
    )
    return cast_by_name(grouped, {"o_totalprice": "DECIMAL(18,2)", "shipped_at": "timestamp_ntz"})


LINKS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("customer", "c_custkey", "orders", "o_custkey"),
    ("events", "user_id", "customer", "c_custkey"),
    ("documents", "doc_id", "labels", "doc_id"),
    ("part", "p_partkey", "lineitem", "l_partkey"),
]
LINK_ITEMS = [{"c": c, "ck": ck, "p": p, "pk": pk} for c, ck, p, pk in LINKS]


def _per_link(spark, sf_dir, check):
    parts = [
        check(table(spark, sf_dir, c), table(spark, sf_dir, p), [ck], [pk]).select(
            F.lit(f"{c}.{ck}->{p}.{pk}").alias("link"), "*"
        )
        for c, ck, p, pk in LINKS
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    _each(
        """SELECT '{c}.{ck}->{p}.{pk}' AS link, count({ck}) AS child_rows,
 count({ck}) FILTER (WHERE {ck} NOT IN (SELECT {pk} FROM {p} WHERE {pk} IS NOT NULL)) AS orphan_rows,
 count(DISTINCT {ck}) FILTER (WHERE {ck} NOT IN (SELECT {pk} FROM {p} WHERE {pk} IS NOT NULL)) AS orphan_keys
FROM {c}""",
        LINK_ITEMS,
    )
)
def fk_orphans(spark, sf_dir):
    tables = TableSet.from_folder(spark, sf_dir, sorted({name for c, _, p, _ in LINKS for name in (c, p)}))
    return keys.orphan_summaries(tables, [keys.Link(c, [ck], p, [pk]) for c, ck, p, pk in LINKS])


# Keys of two columns, of whole numbers and of text.
@query("""
SELECT 'events.user_id,event_type->orders.o_custkey,o_orderpriority' AS link, count(*) AS child_rows, count(*) AS orphan_rows,
 count(DISTINCT (user_id, event_type)) AS orphan_keys FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL
UNION ALL SELECT 'lineitem.l_orderkey,l_linenumber->orders.o_orderkey,o_custkey', count(*), count(*) FILTER (WHERE o_orderkey IS NULL),
 count(DISTINCT (l_orderkey, l_linenumber)) FILTER (WHERE o_orderkey IS NULL)
 FROM lineitem LEFT JOIN (SELECT DISTINCT o_orderkey, o_custkey FROM orders) ON o_orderkey = l_orderkey AND o_custkey = l_linenumber
UNION ALL SELECT 'documents.source,lang->documents.source,lang', count(*), 0, 0 FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def fk_orphans_composite(spark, sf_dir):
    tables = TableSet.from_folder(spark, sf_dir, ["events", "orders", "lineitem", "documents"])
    links = [
        keys.Link("events", ["user_id", "event_type"], "orders", ["o_custkey", "o_orderpriority"]),
        keys.Link("lineitem", ["l_orderkey", "l_linenumber"], "orders", ["o_orderkey", "o_custkey"]),
        keys.Link("documents", ["source", "lang"], "documents", ["source", "lang"]),
    ]
    return keys.orphan_summaries(tables, links)


@query("SELECT d.* FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def fk_orphan_rows(spark, sf_dir):
    return keys.orphan_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"], ["doc_id"])


@query(
    _each(
        """SELECT *, CASE WHEN child_max > 1 AND parent_max > 1 THEN 'many-to-many' WHEN child_max > 1 THEN 'many-to-one'
 WHEN parent_max > 1 THEN 'one-to-many' ELSE 'one-to-one' END AS relationship_type
FROM (SELECT '{c}.{ck}->{p}.{pk}' AS link,
 (SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM {c} GROUP BY {ck})) AS child_max,
 (SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM {p} GROUP BY {pk})) AS parent_max)""",
        LINK_ITEMS,
    )
)
def fk_cardinality(spark, sf_dir):
    return _per_link(spark, sf_dir, keys.cardinality)


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS n, 'duplicate' AS reason
FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def pk_duplicates(spark, sf_dir):
    return keys.primary_key_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
