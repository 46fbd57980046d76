"""Tables of micro-batches: folding, replays and readers."""

import os

import pytest
from pyspark.sql import functions as F

from lodestack.streaming import jobs as st
from lodestack.streaming.compaction import fold_batches, read_batches
from workload import streams


def put(spark, out, number, rows):
    spark.createDataFrame(rows, "run_id bigint, seq bigint, final_message string").coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={number}")


def seen(spark, out):
    return {r.run_id: (r.seq, r.final_message) for r in st.current_final_messages(spark, out).collect()}


def files(spark, out):
    return len(read_batches(spark, out).inputFiles())


def test_many_batches_read_as_few_files(spark, tmp_path):
    out = str(tmp_path / "t")
    assert read_batches(spark, out) is None and fold_batches(spark, out) == 0
    many = 200
    put(spark, out, 0, [(0, 0, "m0")])
    for n in range(1, many):  # copies of what a batch writes, which is quicker than 200 jobs
        os.makedirs(f"{out}/batch={n}")
    spark.range(1, many).select((F.col("id") % 7).alias("run_id"), F.col("id").alias("seq"), F.concat(F.lit("m"), F.col("id")).alias("final_message"), F.col("id").alias("batch")).repartition(1).write.mode("overwrite").partitionBy("batch").parquet(f"{out}-all")
    for n in range(1, many):
        for name in os.listdir(f"{out}-all/batch={n}"):
            os.rename(f"{out}-all/batch={n}/{name}", f"{out}/batch={n}/{name}")
        open(f"{out}/batch={n}/_SUCCESS", "w").close()
    want = {run: (max(n for n in range(many) if n % 7 == run), f"m{max(n for n in range(many) if n % 7 == run)}") for run in range(7)}
    assert seen(spark, out) == want and files(spark, out) == many
    assert st.fold_final_messages(spark, out) == many - 1
    assert seen(spark, out) == want and files(spark, out) == 2
    put(spark, out, 5, [(0, 10**6, "replayed after its fold")])
    put(spark, out, many - 1, [((many - 1) % 7, many - 1, f"m{many - 1}")])  # the last batch, replayed
    assert seen(spark, out) == want
    before = read_batches(spark, out)
    put(spark, out, many, [(3, many, "new")])
    assert st.fold_final_messages(spark, out) == 1
    assert seen(spark, out) == {**want, 3: (many, "new")} and files(spark, out) == 2
    assert before.count() == 8  # what a reader had opened is still there
    assert [n for n in os.listdir(out) if n.startswith("batch=")] != [] and len(os.listdir(out)) < 6
    assert st.fold_final_messages(spark, out) == 0


def test_batches_that_have_not_ended_stay(spark, tmp_path):
    out = str(tmp_path / "t")
    for n in range(4):
        put(spark, out, n, [(n, n, "x")])
    os.remove(f"{out}/batch=1/_SUCCESS")
    assert fold_batches(spark, out) == 1
    assert {r.batch for r in read_batches(spark, out).collect()} == {0, 1, 2, 3}
    assert {r.run_id for r in read_batches(spark, out, before=2).collect()} == {0, 1}


@pytest.mark.parametrize("fold", [False, True])
def test_dropped_files_are_known_after_a_fold(spark, tmp_path, fold):
    drops, out, check = (str(tmp_path / n) for n in ("drops", "out", "check"))
    os.makedirs(drops)
    schema = spark.createDataFrame([], "id bigint, note string").schema
    for n in range(3):
        for copy in range(2):
            with open(f"{drops}/f{n}-{copy}.csv", "w") as f:
                f.write(f'id,note\n{n},"a\n{n}"\n')
        with open(f"{drops}/again{n}.csv", "w") as f:
            f.write('id,note\n0,"a\n0"\n')
        st.stream_csv_drops(spark, drops, schema, "u", out, check).awaitTermination()
        if fold:
            assert st.fold_drops(spark, out) == min(n, 1)
    assert sorted((r.id, r.note) for r in st.dropped_rows(spark, out).collect()) == [(n, f"a\n{n}") for n in range(3)]
    assert read_batches(spark, f"{out}/arrivals").count() == 9


def test_dropped_texts_come_in_more_files_where_the_table_has_more_splits(spark, monkeypatch):
    drops = []
    plain = st.stream_csv_drops
    monkeypatch.setattr(st, "stream_csv_drops", lambda session, folder, *rest: (drops.append(folder), plain(session, folder, *rest))[1])
    sizes = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (1 << 22, 1 << 18):
            for key in sizes:
                spark.conf.set(key, size)
            assert streams.stream_csv_texts(spark, "/root/testdata/sf0.01").count() == 1000
    finally:
        for key, size in sizes.items():
            spark.conf.set(key, size)
    few, many = (len(spark.read.format("binaryFile").load(folder).select("path").collect()) for folder in drops)
    assert 3 <= few < many
