"""Pairs of packed blocks against brute force, and what knowledge entries leave behind."""

import glob
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_similarity import clustered, replay

from lodestack.operators import knowledge as kn
from lodestack.operators import pairs as pr
from lodestack.operators.similarity import pick_pivots
from lodestack.session import cut_lineage, drop_cut

ENTRIES = "entry_id string, arrival bigint, force boolean, collection_name string, vector array<double>"


def near_pairs():
    def near(left, right, a, b):
        rows, columns, products = pr.near_products(a, b, 0.9)
        i, j = np.nonzero(products >= 0.9)
        return pd.DataFrame({"l": left["id"].to_numpy()[rows[i]], "r": right["id"].to_numpy()[columns[j]]})

    return near


@pytest.mark.parametrize("cells", [False, True])
def test_pairs_of_blocks_are_all_pairs(spark, cells):
    rng = np.random.default_rng(11)
    scopes = [f"s{i % 5}" for i in range(900)]
    vectors = clustered(rng, 900, d=6, centres=30, noise=0.05)
    frame = spark.createDataFrame([(i, s, i % 90, v.tolist()) for i, (s, v) in enumerate(zip(scopes, vectors))], "id bigint, s string, t bigint, vector array<double>")
    angle = float(np.arccos(0.9))
    chosen = pr.useful_cells(pick_pivots(frame, "vector", 30), angle / 8) if cells else None
    assert (chosen is not None) == cells
    packed = pr.pack_blocks(frame, ["s"], "t", chosen, 256)
    assert packed.count() >= 4
    scores = vectors @ vectors.T
    whole = {(i, j) for i, j in zip(*np.nonzero(scores >= 0.9)) if scopes[i] == scopes[j]}
    assert {tuple(r) for r in pr.block_pairs(packed, packed, near_pairs(), "l bigint, r bigint", angle).collect()} == whole
    met = {tuple(r) for r in pr.block_pairs(packed, packed, near_pairs(), "l bigint, r bigint", angle, earlier=True).collect()}
    assert {(i, j) for i, j in whole if j % 90 < i % 90} <= met <= whole


def test_packed_vectors_keep_all_digits_and_sizes(spark):
    rows = [(0, [0.1, 0.2]), (1, [0.5, 0.25]), (2, [1.0, 2.0, 3.0]), (3, [float(np.float32(0.1)), 1.0, 0.0])]
    frame = spark.createDataFrame([(i, f"s{len(v)}", i, v) for i, v in rows], "id bigint, s string, t bigint, vector array<double>")
    blocks = pr.pack_blocks(frame.coalesce(1), ["s"], "t").collect()
    assert sorted((b.width, len(b.vectors)) for b in blocks) in ([(2, 32), (3, 24)], [(2, 8), (2, 16), (3, 24)], [(2, 8), (2, 16), (3, 12), (3, 12)], [(2, 32), (3, 12), (3, 12)])
    both = pr.block_pairs(*[pr.pack_blocks(frame, ["s"], "t")] * 2, lambda l, r, a, b: pd.DataFrame({"i": l["id"].repeat(len(r)).to_numpy(), "x": (a @ b.T).ravel()}), "i bigint, x double", 0.0)
    units = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    # Blocks beyond the angle are passed over; a block always meets itself.
    got = {(r.i, round(r.x, 12)) for r in both.collect()}
    assert {(i, round(float(u @ u), 12)) for i, u in enumerate(units)} <= got


def test_rough_products_lose_nothing():
    rng = np.random.default_rng(12)
    a, b = (pr.units(rng.standard_normal((n, 64))) for n in (200, 300))
    b[:50] = 0.95 * a[:50] + np.sqrt(1 - 0.95**2) * pr.units(b[:50] - (a[:50] * b[:50]).sum(1, keepdims=True) * a[:50])
    for least in (0.95, 0.3, float((a @ b.T)[3, 7])):
        rows, columns, products = pr.near_products(a, b, least)
        i, j = np.nonzero(a @ b.T >= least + 1e-12)
        assert set(i) <= set(rows) and set(j) <= set(columns) and products.shape == (len(rows), len(columns))


def test_knowledge_by_scope_with_vectors_of_several_sizes(spark):
    rng = np.random.default_rng(13)
    rows, want_log, want_alive = [], {}, set()
    for c, d in (("a", 6), ("b", 8), ("c", 6)):
        vectors, force = clustered(rng, 60, d=d, noise=0.2), rng.random(60) < 0.2
        log, alive = replay(vectors, force, [], 0.93)
        name = lambda e: e and f"{c}{e}"  # noqa: B023, E731
        want_log |= {name(e): (i, name(m), r) for e, (i, m, r) in log.items()}
        want_alive |= {name(e) for e in alive}
        rows += [(f"{c}e{i:03d}", i, bool(force[i]), c, v.tolist()) for i, v in enumerate(vectors)]
    entries = spark.createDataFrame(rows, ENTRIES)
    empty = entries.limit(0).select(F.col("entry_id").alias("point_id"), "collection_name", "vector")
    log, alive = kn.ingest_knowledge(entries, empty, 0.93)
    assert {r.entry_id: (r.inserted, r.match_id, r.replaced) for r in log.collect()} == want_log
    assert {r.point_id for r in alive.collect()} == want_alive


def test_entries_are_not_copied_and_rounds_leave_little(spark):
    rng = np.random.default_rng(14)
    vectors = rng.standard_normal((3000, 32))
    entries = spark.createDataFrame([(f"e{i}", i, False, "c", v.tolist()) for i, v in enumerate(vectors)], ENTRIES)
    empty = entries.limit(0).select(F.col("entry_id").alias("point_id"), "collection_name", "vector")
    folder = spark.sparkContext._jvm.java.net.URI(cut_lineage(spark.range(1)).inputFiles()[0]).getPath().rsplit("/cut-", 1)[0]
    before = {*glob.glob(f"{folder}/cut-*")}
    log, alive = kn.ingest_knowledge(entries, empty)
    # Vectors once as points and once in blocks for the last look; those of the entries and of the rounds are gone.
    size = sum(os.path.getsize(f) for d in {*glob.glob(f"{folder}/cut-*")} - before for f in glob.glob(f"{d}/*.parquet"))
    assert log.count() == alive.count() == 3000 and size < 3 * 3000 * 32 * 8
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" not in plan and not any("Exchange" in line and "vectors" in line for line in plan.split("\n") if "Broadcast" not in line)


def test_dropped_rows_are_gone(spark):
    rows = cut_lineage(spark.range(10))
    file = spark.sparkContext._jvm.java.net.URI(rows.inputFiles()[0]).getPath()
    assert glob.glob(file)
    drop_cut(rows.where("id > 3"))
    assert not glob.glob(file)


def test_many_partitions_make_no_more_blocks(spark):
    frame = spark.createDataFrame([(i, "s", i, [float(i), 1.0]) for i in range(600)], "id bigint, s string, t bigint, vector array<double>")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert pr.pack_blocks(frame.repartition(40), ["s"], "t").count() == 1
        assert pr.pack_blocks(frame.repartition(40), ["s"], "t", block_rows=256).count() == 3
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
