"""Ingest, profiles, catalog, metadata, logs and user functions."""

import datetime
from decimal import Decimal
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.casts import cast_by_name, casts_by_name, spark_type
from lodestack.operators import metadata as md
from lodestack.operators.catalog import validate_spec
from lodestack.operators.charts import validate_options
from lodestack.operators.keys import Link, orphan_summaries, orphan_summary
from lodestack.operators.logs import check_response, extract_json
from lodestack.operators.profile import (
    column_sketches,
    dataset_column_stats,
    merge_sketches,
    numeric_summary,
    profile_all,
    profile_from_sketches,
    table_column_stats,
    top_values,
)
from lodestack.operators.sample import infer_sample_types, sample
from lodestack.operators.search import search_terms
from lodestack.operators.sql import open_database, run_readonly_sql, validate_sql
from lodestack.operators.udf import run_grouped_aggregate, run_grouped_function, verify_transform
from lodestack.plans.csv_ingest import csv_to_parquet
from lodestack.sources.csv import CsvJob, CsvReadError, ends_open, read_csv, sniff
from lodestack.sources.files import hash_files
from lodestack.sources.tables import TableSet, find_dataset, list_datasets, read_snapshot, write_snapshot


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_to_parquet(spark, tmp_path):
    path = write(tmp_path / "in.csv", "id,order_date,created_at,price,name\n1,2024-01-02,2024-01-02 03:04:05,1.5,a\n2,2024-01-03,2024-01-03 00:00:00,2,b\n")
    done = csv_to_parquet(spark, CsvJob(path, dtype_overrides={"price": "DECIMAL(10,2)"}))
    assert done["rows"] == 2 and done["output_path"] == str(tmp_path / "in.parquet")
    assert done["column_types"] == {
        "id": "bigint", "order_date": "date", "created_at": "timestamp", "price": "decimal(10,2)", "name": "string"
    }
    assert spark.read.parquet(done["output_path"]).count() == 2


def test_csv_errors(spark, tmp_path):
    with pytest.raises(CsvReadError, match="nothing to read"):
        read_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(CsvReadError, match="no .csv ending"):
        read_csv(spark, write(tmp_path / "a.txt", "x\n1\n"))
    with pytest.raises(CsvReadError, match="is a folder"):
        read_csv(spark, str(tmp_path))
    with pytest.raises(ValueError):
        CsvJob("a.csv", sample_size=0)
    # Types come from the first line only, and a later value does not fit.
    path = write(tmp_path / "b.csv", "x\n1\nword\n")
    assert read_csv(spark, path).schema["x"].dataType.simpleString() == "string"
    with pytest.raises(CsvReadError):
        csv_to_parquet(spark, CsvJob(path, sample_size=1))


def test_cast_rules(spark):
    names = ["updated_at", "start_time", "ts_TIMESTAMP", "birthDate", "id", "plain"]
    assert casts_by_name(names, {"id": "HUGEINT"}) == {
        "updated_at": "date", "start_time": "timestamp", "ts_TIMESTAMP": "timestamp", "birthDate": "date", "id": "decimal(38,0)"
    }
    assert spark_type("VARCHAR[]") == "array<string>"
    df = spark.createDataFrame([("c-1", "2024-01-01")], "candidate_id string, a_date string")
    with pytest.raises(Exception):
        cast_by_name(df).collect()
    kept = cast_by_name(df, strict=False)
    assert [f.dataType.simpleString() for f in kept.schema] == ["string", "date"]


def test_profiles_of_gaps(spark):
    rows = [(1, 1.0, "a"), (1, float("nan"), ""), (2, None, None), (3, -0.0, "a"), (3, 0.0, "b")]
    df = spark.createDataFrame(rows, "i int, x double, s string")
    table = {r.column_name: r for r in table_column_stats(df, "t", ["i", "x", "s"]).collect()}
    assert (table["x"].nan_count, table["x"].null_count, table["x"].distinct_count) == (1, 1, 3)
    assert (table["s"].empty_string_count, table["s"].empty_string_pct) == (1, 20.0)
    data = {r.column_name: r for r in dataset_column_stats(df).collect()}
    assert (data["x"].null_count, data["x"].nan_count, data["x"].unique_count, data["i"].dtype) == (2, 1, 2, "int")
    assert [(r.value, r.n, r.pct) for r in top_values(df, "x", 1).collect()] == [(0.0, 2, 0.4)]
    summary = {r.column_name: r for r in numeric_summary(df).collect()}
    assert summary["x"].max == 1.0 and set(summary) == {"i", "x"}
    with pytest.raises(ValueError, match="not found"):
        table_column_stats(df, "t", "nope")


def test_empty_table_profile(spark):
    df = spark.createDataFrame([], "i int, s string")
    rows = profile_all({"t": df}).collect()
    assert [(r.column_name, r.row_count, r.null_pct, r.distinct_count) for r in rows] == [("i", 0, 0.0, 0), ("s", 0, 0.0, 0)]
    assert numeric_summary(df).first().mean is None


def test_sketch_is_close(spark):
    df = spark.range(20000).select((F.col("id") % 5000).alias("k"), F.lit("x").alias("s"))
    counts = {r.column_name: r.distinct_count for r in profile_all({"t": df}, approx=True).collect()}
    assert abs(counts["k"] - 5000) < 500 and counts["s"] == 1


def test_samples(spark):
    df = spark.createDataFrame([(i, None if i < 3 else f"v-{i}", None) for i in range(9)], "id int, s string, n string")
    assert [r.id for r in sample(df, "id", "Tail", 3).collect()] == [6, 7, 8]
    with pytest.raises(ValueError):
        sample(df, "id", "middle")
    types = {r.column_name: r.sample_type for r in infer_sample_types(df, "id", 2).collect()}
    assert types == {"id": "int", "s": "datetime", "n": "unknown"}


def test_datasets(spark):
    files = spark.createDataFrame(
        [("f1", "a", "pdf", "one", "p1"), ("f2", "a", "csv", "two", "p2"), ("f2", "b", "csv", "two", "p3"), ("f3", "b", "csv", "x", None)],
        "file_id string, user string, file_type string, original_filename string, artifact_path string",
    )
    assert [(r.user_id, r.file_id) for r in list_datasets(files).collect()] == [("a", "f1"), ("a", "f2"), ("b", "f2")]
    assert find_dataset(files, "f2", "b") == ("p3", "b")
    assert find_dataset(files, "f1", "zz") == ("p1", "a")
    with pytest.raises(ValueError, match="several users"):
        find_dataset(files, "f2")
    with pytest.raises(FileNotFoundError):
        find_dataset(files, "f3")
    tables = TableSet({"b": files, "a": files, "sqlite_x": files})
    assert tables.list_tables() == ["a", "b"]


@pytest.mark.parametrize(
    "sql,risk",
    [
        ("SELECT 1 AS x;", "low"),
        ("WITH a AS (SELECT 1 AS x) SELECT * FROM a -- end", "low"),
        ("drop table t", "high"),
        ("WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "medium"),
        ("SELECT 1) q; DROP TABLE t", "medium"),
        ("SET x = 1", "medium"),
        ("SELECT nope FROM range(3)", "medium"),
    ],
)
def test_sql_guard(spark, sql, risk):
    verdict = validate_sql(spark, sql)
    assert (verdict["risk_level"], verdict["is_valid"]) == (risk, risk == "low")
    if risk != "low":
        with pytest.raises(ValueError):
            run_readonly_sql(spark, sql)


def test_sql_reaches_one_database_only(spark, tmp_path):
    for name, value in (("a", 1), ("b", 2)):
        spark.range(value).write.parquet(f"{tmp_path}/{name}/orders.parquet")
    sessions = [open_database(spark, f"{tmp_path}/{name}") for name in "ab"]
    assert [run_readonly_sql(s, "SELECT count(*) AS n FROM orders").first().n for s in sessions] == [1, 2]
    for sql in (
        f"SELECT * FROM text.`{tmp_path}/a`",
        f"SELECT (SELECT max(id) FROM parquet.`{tmp_path}/a/orders.parquet`)",
        "SELECT reflect('java.lang.System', 'lineSeparator')",
        "SELECT `java_method` ('java.lang.System', 'lineSeparator')",
        "SELECT * FROM nothing",
    ):
        assert not validate_sql(sessions[0], sql)["is_valid"], sql
    assert validate_sql(sessions[0], "SELECT 'reflect(' AS text FROM orders -- reflect()")["is_valid"]


def test_csv_as_people_write_it(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id;note;n\n1;"say ""hi; there"" now";2\n2;"two\nlines";3\n3;plain;4\n')
    rows = read_csv(spark, str(path)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'say "hi; there" now', 2), (2, "two\nlines", 3), (3, "plain", 4)]
    assert sniff(['a,"b', 'c",d', '1,"x;y;z",2']) == (",", True) and sniff(["a|b", "1|2"]) == ("|", False) and sniff([]) == (",", False)
    with pytest.raises(CsvReadError, match="nothing to read"):
        read_csv(spark, str(tmp_path / "none.csv"))


def small_ranges(spark, size):
    """Files are read in ranges of so many bytes."""
    for key, value in {"maxPartitionBytes": f"{size}b", "openCostInBytes": "1b", "minPartitionNum": "1"}.items():
        spark.conf.set(f"spark.sql.files.{key}", value)


@pytest.fixture
def ranges(spark):
    yield lambda size: small_ranges(spark, size)
    for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{key}")


ROWS = [
    ("a", "plain"), ("b", 'two\nlines'), ("c", 'say ""hi""; so'), ("d", "\n\n\n"), ("e", "x" * 300 + "\n" + "y" * 300), ("f", 'a\n;"";\nb'), ("g", ""), ("h", '5" pipe'), ("i", "ü\r\né"), ("j", "end"),
] * 2


@pytest.mark.parametrize("size", [150, 1_000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_breaks_in_fields_and_ranges(spark, tmp_path, ranges, size, end):
    def field(x):
        return x if x == '5" pipe' else '"' + x + '"' if any(c in x for c in '\n;"') else x

    path = tmp_path / "a.csv"
    path.write_bytes(("\ufeffname;n;note" + end + "".join(f"{n};{i};{field(x)}{end}" for i, (n, x) in enumerate(ROWS))).encode())
    ranges(size)
    rows = read_csv(spark, str(path))
    assert [f.dataType.simpleString() for f in rows.schema] == ["string", "bigint", "string"] and rows.columns == ["name", "n", "note"]
    want = [(n, i, x.replace('""', '"') or None) for i, (n, x) in enumerate(ROWS)]
    assert [tuple(r) for r in rows.orderBy("n").collect()] == want
    if size < 1_000:
        assert rows.select(F.spark_partition_id()).distinct().count() > 4


def test_files_are_hashed_as_streams(spark, tmp_path):
    import hashlib

    (tmp_path / "a b%20.bin").write_bytes(b"abc" * 10_000)
    with open(tmp_path / "large.bin", "wb") as f:  # sparse, beyond what one cell holds
        f.truncate((1 << 31) + 7)
    got = {r.path.rpartition("/")[2]: (r.length, r.file_hash) for r in hash_files(spark, f"{tmp_path}/*.bin").collect()}
    zeros = hashlib.sha256()
    for _ in range(1 << 11):
        zeros.update(bytes(1 << 20))
    zeros.update(bytes(7))
    assert got == {
        "a b%20.bin": (30_000, hashlib.sha256(b"abc" * 10_000).hexdigest()),
        "large.bin": ((1 << 31) + 7, zeros.hexdigest()),
    }


def test_a_failed_snapshot_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "snap")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string")
    schema = "key string, record struct<id: bigint, name: string>"
    with pytest.raises(FileNotFoundError):
        read_snapshot(spark, path, schema)
    assert write_snapshot(rows, "id", path) == path
    broken = rows.withColumn("name", F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="no"):
        write_snapshot(broken, "id", path)
    assert sorted((r.key, r.record.name) for r in read_snapshot(spark, path, schema).collect()) == [("1", "a"), ("2", "b")]
    before = read_snapshot(spark, path, schema)
    for n in range(3):
        write_snapshot(rows.where("id = 1").withColumn("name", F.lit(f"c{n}")), "id", path)
        if not n:
            assert before.count() == 2  # a reader of the version before is not disturbed
    assert [tuple(r.record) for r in read_snapshot(spark, path, schema).collect()] == [(1, "c2")]
    assert len([p for p in (tmp_path / "snap").iterdir() if p.name.startswith("version-")]) == 2


def test_quotes_open_only_at_the_start_of_a_field():
    assert [ends_open(x, False, ",") for x in ('a,"b', 'a,b"', '5",6', '"a""', '"a"",b', '"a","b', "", ",", '""', '"')] == [True, False, False, True, True, True, False, False, False, True]
    assert [ends_open(x, True, "||") for x in ("a", 'a"', 'a"||"', '""', '"||b"', 'a""||"')] == [True, False, True, True, False, False]


def test_csv_of_little(spark, tmp_path, ranges):
    ranges(20)
    only = write(tmp_path / "h.csv", 'a,"b\nc"\n')
    assert read_csv(spark, only).columns == ["a", "b\nc"] and read_csv(spark, only).count() == 0
    bare = write(tmp_path / "n.csv", '1,"b\nc"\n2,d')
    assert sorted(tuple(r) for r in read_csv(spark, bare, header=False).collect()) == [(1, "b\nc"), (2, "d")]
    folder = tmp_path / "f.csv"
    folder.mkdir()
    for n in range(3):
        (folder / f"p{n}.csv").write_text(f'x,y\n{n},"l\n{n}"\n')
    assert sorted(tuple(r) for r in read_csv(spark, str(folder), folder=True).collect()) == [(n, f"l\n{n}") for n in range(3)]
    # the break comes long after the first lines
    late = write(tmp_path / "l.csv", "x,y\n" + "1,a\n" * 1500 + '2,"b\nc"\n')
    ranges(2_000)
    assert read_csv(spark, late).count() == 1501


def test_long_words_and_blanks_take_linear_time(spark):
    from lodestack.functions.text import clean_markup, strip
    from lodestack.operators.documents import normalized_text
    from lodestack.operators.search import containing_words

    word = "ab" * 50_000
    found = containing_words(spark.createDataFrame([("abab",), ("bb",), ("ba" * 20,)], "needle string"), spark.createDataFrame([(word,)], "word string"))
    assert sorted(r.needle for r in found.select("needle").collect()) == ["abab", "ba" * 20]
    blanks = spark.createDataFrame([("x" + " " * 1_000_000 + "y",)], "text string")
    row = blanks.select(F.length(strip(F.col("text"))).alias("a"), F.length(clean_markup(F.col("text"))).alias("b"), F.length(normalized_text(F.col("text"))).alias("c")).first()
    assert tuple(row) == (1_000_002,) * 3


def test_empty_sql(spark):
    with pytest.raises(ValueError, match="empty"):
        validate_sql(spark, "  ")


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "s1", "c1", "u1"), (2, "b", "s2", "c2", "u2")], "job_id int, state string, started_at string, created_at string, updated_at string")
    new = spark.createDataFrame([(2, "done", None, "c9", "u9"), (3, "new", None, "c3", "u3")], old.schema)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(md.upsert_jobs(old, new, F.lit("now"))) == [(1, "a", "s1", "c1", "u1"), (2, "done", None, "c2", "now"), (3, "new", None, "c3", "now")]
    assert rows(md.upsert_jobs(old, new, F.lit("now"), keep_started=True))[1] == (2, "done", "s2", "c2", "now")
    once = md.upsert_jobs(old, new, F.lit("now"))
    assert rows(md.upsert_jobs(once, new, F.lit("now"))) == rows(once)


def test_map_merge(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "9", "c": "3"})], "s map<string,string>, g map<string,string>")
    assert df.select(md.merge_maps(F.col("s"), F.col("g"))).first()[0] == {"a": "1", "b": "9", "c": "3"}


def test_uploads_against_a_listing(spark):
    uploads = spark.createDataFrame([("csv", "/a.csv", None), ("csv", "/b.csv", None), ("sqlite", "/d.sqlite", "/s.sql")], "upload_type string, source_path string, schema_sql_path string")
    there = spark.createDataFrame([("/a.csv",), ("/d.sqlite",)], "path string")
    reasons = {r.source_path: r.reason for r in md.validate_uploads(uploads, there).collect()}
    assert reasons == {"/a.csv": None, "/b.csv": "source file not found", "/d.sqlite": "schema file not found"}


def test_responses(spark):
    good = '{"misleading": false, "reasoning": ["a {b"], "response_type": null}'
    cases = {
        "bare": (f" {good} ", "direct", None),
        "braces in a string break the count": (f"x {good} y", None, "no JSON object found"),
        "second form": ('x {"misleading": "yes", "reasoning": []} y', "braces", None),
        "third form": ('{} {"misleading": true, "reasoning": []}', "pattern", None),
        "list": ("[1]", "direct", "not an object"),
        "numbers are no strings": ('{"misleading": 0, "reasoning": [1]}', "direct", "reasoning: list of strings required"),
        "none": ("nothing here", None, "no JSON object found"),
        "text type": ('{"misleading": true, "reasoning": [], "sql": null}', "direct", "sql: string expected"),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "name string, text string")
    got = {r.name: (r.how, r.reason) for r in extract_json(df).collect()}
    assert got == {k: v[1:] for k, v in cases.items()}
    viz = spark.createDataFrame([('{"misleading": false, "reasoning": ["x"], "chart_specs": [{}, 1]}',)], "text string")
    assert check_response(viz, "viz").first().reason == "chart_specs: list of objects expected"


def test_chart_options(spark):
    props = spark.createDataFrame([("line", "data"), ("bar", "data")], "series string, property string")
    options = {
        "good": '{"series": [{"type": "line", "data": [1]}]}',
        "single": '{"series": {"type": "bar", "width": 1}}',
        "none": '{"title": 1}',
        "bad": '{"series": [1, {"data": 2}, {"type": "pie"}]}',
    }
    rows = validate_options(spark.createDataFrame(list(options.items()), "option_id string, option string"), props).collect()
    got = {r.option_id: (r.valid, r.errors, r.warnings) for r in rows}
    assert got["good"] == (True, [], []) and got["none"] == (True, [], [])
    assert got["single"] == (True, [], ["series[0] unknown property 'width'"])
    assert got["bad"][1] == ["series[0] must be an object", "series[1] missing 'type'", "Unknown series type: pie"]


def test_search_terms_limit_before_dedup(spark):
    index = [("bar", 1, 0, "c", "x"), ("barn", 2, 0, "c", "x"), ("crowbar", 3, 0, "c", "y"), ("other", 0, 0, "c", "z")]
    postings = spark.createDataFrame(index, "term string, term_pos int, hit_pos int, type string, path string")
    keywords = spark.createDataFrame([(" BAR ",), ("  ",)], "keyword string")
    assert [(r.pos, r.path) for r in search_terms(postings, keywords, 2).collect()] == [(1, "x")]
    assert sorted(r.path for r in search_terms(postings, keywords, 3).collect()) == ["x", "y"]


def test_user_functions(spark):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("k"))
    assert verify_transform(df, lambda d: d.where("id > 1")) == {"success": True, "error": None}
    assert not verify_transform(df, lambda d: d.select("nope"))["success"]
    with pytest.raises(TypeError):
        verify_transform(df, "d.count()")
    total = run_grouped_function(df, ["k"], lambda key, frames: [{"k": key[0], "s": int(sum(f.id.sum() for f in frames))}], "k bigint, s bigint")
    assert {(r.k, r.s) for r in total.collect()} == {(0, 20), (1, 25)}
    with pytest.raises(Exception, match="must return an object"):
        run_grouped_function(df, ["k"], lambda key, frames: 5, "k bigint").collect()


def test_grouped_aggregate_sends_states(spark, monkeypatch):
    rows = [("a" if n % 3 else None, n % 2, float(n)) for n in range(1, 1001)] + [("b", None, 5.0), ("c", 7, None)]
    df = spark.createDataFrame(rows, "k string, g int, x double").repartition(6)

    def partial(frame):
        return {"n": len(frame), "total": float(frame.x.sum()), "seen": 1}

    def merge(a, b):
        return {c: a[c] + b[c] for c in a}

    def finish(key, held):
        return [{"k": key[0], "g": key[1], **held}] if held["n"] else []

    got = run_grouped_aggregate(df, ["k", "g"], partial, merge, finish, "n bigint, total double, seen bigint", "k string, g int, n bigint, total double, seen bigint")
    found = {(r.k, r.g): (r.n, r.total) for r in got.collect()}
    want = {}
    for k, g, x in rows:
        n, total = want.get((k, g), (0, 0.0))
        want[k, g] = n + 1, total + (x or 0.0)
    assert found == want
    with pytest.raises(ValueError, match="named like keys: k"):
        run_grouped_aggregate(df, ["k"], partial, merge, finish, "k string, n bigint", "k string")
    with pytest.raises(Exception, match="must return an object"):
        run_grouped_aggregate(df, ["k"], partial, merge, lambda key, held: 5, "n bigint, total double, seen bigint", "k string").collect()
    assert run_grouped_aggregate(df.limit(0), ["k", "g"], partial, merge, finish, "n bigint, total double, seen bigint", "k string, n bigint").count() == 0


ODD_TYPES = "`at` bigint, `we``ird` string, score double, parts array<double>, words array<string>, pair struct<a:int,b:string>, sum decimal(30,2), raw binary, day date"


def odd_rows(spark):
    long, day = "x" * 5000, datetime.date(2024, 1, 1)
    rows = [
        (1, "", float("nan"), [], [], (1, None), Decimal("1.00"), b"", day),
        (1, None, 0.0, None, ["a, b"], (None, "1"), Decimal("1.00"), b"\x00", None),
        (2, long, -0.0, [None], ["a", "b"], None, None, None, day),
        (None, long + "y", None, [0.0], ["ab", ""], (1, None), Decimal("2.00"), b"", day),
        (2, "short", 1.5, [-0.0], ["a", "b"], (1, ""), Decimal("1.00"), b"\x00\x00", day),
        (3, "short", float("nan"), [0.0, None], None, (1, ""), None, b"", day),
    ]
    return spark.createDataFrame(rows, ODD_TYPES)


def test_profile_of_odd_values_and_names(spark):
    want = {
        "at": (1, 0, 0, 3), "we`ird": (1, 1, 0, 4), "score": (1, 0, 2, 3), "parts": (1, 0, 0, 4), "words": (1, 0, 0, 4),
        "pair": (1, 0, 0, 3), "sum": (2, 0, 0, 2), "raw": (1, 0, 0, 3), "day": (1, 0, 0, 1),
    }
    df = odd_rows(spark)
    for approx in (False, True):
        got = profile_all({"t": df}, approx=approx).collect()
        assert {r.column_name: (r.null_count, r.empty_string_count, r.nan_count, r.distinct_count) for r in got} == want
        assert {r.row_count for r in got} == {6}
        empty = profile_all({"t": df.limit(0)}, approx=approx).collect()
        assert sorted(r.column_name for r in empty) == sorted(want)
        assert all(r.row_count == r.distinct_count == r.null_count == r.null_pct == 0 for r in empty)


def test_values_do_not_reach_the_shuffle(spark):
    df = spark.createDataFrame([("x" * 100,)], "text string")
    plan = profile_all({"t": df})._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanged and not any("text" in line for line in exchanged)


def test_sketches_of_batches_merge(spark):
    df = spark.range(0, 30000, 1, 4).select(F.col("id"), (F.col("id") % 700).cast("string").alias("name"), F.lit(None).cast("string").alias("none"))
    batches = [column_sketches(df.where(F.col("id") % 3 == n)) for n in range(3)]
    batches.append(column_sketches(df.limit(0)))
    merged = profile_from_sketches(merge_sketches(reduce(DataFrame.unionByName, batches)), "t").collect()
    whole = profile_from_sketches(column_sketches(df), "t").collect()
    plain = lambda rows: sorted((r.column_name, r.row_count, r.null_count) for r in rows)
    assert plain(merged) == plain(whole) == [("id", 30000, 0), ("name", 30000, 0), ("none", 30000, 30000)]
    estimates = {r.column_name: r.distinct_count for r in merged}
    assert abs(estimates["id"] - 30000) <= 30000 * 0.065 and abs(estimates["name"] - 700) <= 700 * 0.065
    assert estimates["none"] == 0


def test_orphans_of_many_links_in_one_pass(spark):
    child = spark.createDataFrame(
        [(1, "a", 0.0, 1), (1, "b", -0.0, 2), (2, None, 1.5, 3), (None, "a", float("nan"), None), (9, "z", 7.0, 9)],
        "id int, `at` string, score double, small int",
    )
    parent = spark.createDataFrame(
        [(1, "a", 0.0, 1.0), (1, "a", 0.0, 2.0), (2, "b", float("nan"), None), (None, None, None, None)],
        "id bigint, `at` string, score double, wide double",
    )
    links = [
        Link("c", ["id"], "p", ["id"]),
        Link("c", ["at"], "p", ["at"]),
        Link("c", ["id", "at"], "p", ["id", "at"]),
        Link("c", ["score"], "p", ["score"]),
        Link("c", ["small"], "p", ["wide"]),
        Link("c", ["id"], "c", ["small"]),
    ]
    one = {r.link: r[1:] for r in orphan_summaries({"c": child, "p": parent}, links).collect()}
    frames = {"c": child, "p": parent}
    each = {x.name: tuple(orphan_summary(frames[x.child], frames[x.parent], x.child_columns, x.parent_columns).first()) for x in links}
    assert one == each
    assert one["c.id->p.id"] == (4, 1, 1) and one["c.at->p.at"] == (4, 1, 1) and one["c.id,at->p.id,at"] == (3, 2, 2)
    none = orphan_summaries({"c": child.limit(0), "p": parent.limit(0)}, links).collect()
    assert sorted(r.link for r in none) == sorted(each) and all(tuple(r[1:]) == (0, 0, 0) for r in none)
    with pytest.raises(ValueError, match="same number"):
        orphan_summaries(frames, [Link("c", ["id"], "p", ["id", "at"])])


def test_spec_against_definitions(spark):
    db = "user_id string, file_id string, table_name string"
    columns = spark.createDataFrame(
        [("u", "f", "a", "x", 1, "INT", True), ("u", "f", "a", "y", 2, None, True), ("u", "f", "a", "z", 3, "TEXT", False), ("u", "f", "only", "x", 1, "INT", True)],
        f"{db}, column_name string, ordinal int, data_type string, is_primary_key boolean",
    )
    spec = spark.createDataFrame(
        [("u", "f", "a", "x", 1, "int"), ("u", "f", "a", "y", 2, "REAL"), ("u", "f", "a", "w", 3, "TEXT"), ("u", "g", "a", "x", 1, "INT")],
        f"{db}, column_name string, ordinal int, data_type string",
    )
    spec_keys = spark.createDataFrame([("u", "f", "a", ["x", "", "x"]), ("u", "f", "only", ["q"]), ("u", "f", "gone", None)], f"{db}, primary_key array<string>")
    link = f"{db}, from_column string, to_table string, to_column string, ordinal int"
    keys = spark.createDataFrame([("u", "f", "a", "x", "b", "i", 0), ("u", "f", "a", "y", "b", None, 1), ("u", "f", "only", "x", "b", "i", 0)], link)
    spec_links = spark.createDataFrame([("u", "f", "a", "y", "b", None, 0), ("u", "f", "a", "z", "b", "i", 1)], link)
    got = validate_spec(spec, spec_keys, spec_links, columns, keys)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(
        map(
            str,
            [
                ("u", "f", "only", "tables", "missing", "only", None, None),
                ("u", "g", "a", "tables", "extra", "a", None, None),
                ("u", "f", "a", "columns", "missing", "z", None, None),
                ("u", "f", "a", "columns", "extra", "w", None, None),
                ("u", "f", "a", "types", "mismatch", "y", None, "REAL"),
                ("u", "f", "a", "primary_key", "mismatch", None, "x, y", "x"),
                ("u", "f", "a", "foreign_keys", "missing", "x->b.i", None, None),
                ("u", "f", "a", "foreign_keys", "extra", "z->b.i", None, None),
            ],
        )
    )
    assert validate_spec(spec.limit(0), spec_keys.limit(0), spec_links.limit(0), columns.limit(0), keys.limit(0)).isEmpty()


def test_terms_out_of_reach_are_dropped_before_hits_are_looked_up(spark):
    rows = [(f"{'ab'[i % 2]}{i % 13}a{'b' * (i % 3)}", i % 5 or None, i, "t", f"p{i % 4}") for i in range(200)]
    postings = spark.createDataFrame(rows, "term string, term_pos bigint, hit_pos bigint, type string, path string")
    keywords = spark.createDataFrame([("a",), (" B ",), ("a0a",), ("1",), ("zz",)], "keyword string")
    for limit in (1, 3, 20):
        want = set()
        for keyword in ("a", " B ", "a0a", "1", "zz"):
            needle = keyword.strip().lower()
            hits = sorted((r[0] != needle, r[1] is not None, r[1] or 0, r[2], r[3], r[4]) for r in rows if needle in r[0])[:limit]
            for pos, hit in reversed(list(enumerate(hits, 1))):
                want = {w for w in want if (w[0], *w[2:]) != (keyword, *hit[4:])} | {(keyword, pos, *hit[4:])}
        found = search_terms(postings, keywords, limit)
        assert {tuple(r) for r in found.collect()} == want
        assert "windowspecdefinition(needle" in found._jdf.queryExecution().toString()
