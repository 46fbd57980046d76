"""The manifest, the hash index and hard negatives against plain Python, with odd rows, extra columns and empty tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm.exact import Directory, build_index, exact_duplicates
from lodestack.llm.manifest import audit, prove, write_manifest
from lodestack.llm.negatives import Block, Codes, codebook, hard_negatives, multi_sequence, nearest

LOWER = {c: c + 32 for c in range(65, 91)}


# ---- manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"].translate(LOWER) if lower and row["text"] else row["text"]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def heights(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def around(levels, i):
    for level in levels[:-1]:
        start = i // 16 * 16
        yield level[start:i], level[i + 1 : start + 16]
        i //= 16


def brute_manifest(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row["source"], []).append(row)
    for some in sources.values():
        some.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: heights([leaf(r) for r in sources[s]]) for s in order}
    upper = heights([trees[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for i, row in enumerate(sources[s]):
            path = [*around(trees[s], i), *around(upper, place)]
            node = leaf(row, row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)
            for before, after in path:
                node = sha("".join(before) + node + "".join(after))
            root = upper[-1][0]
            out.append((row["doc_id"], leaf(row), trees[s][-1][0], root, sha("".join("".join(b + a) for b, a in path)), node, node == root))
    return Counter(out)


def test_manifest_of_odd_rows(spark, scratch, make_docs, odd_rows):
    docs = make_docs([*odd_rows, (20, "ÀB", "Ä"), (21, "A", "a"), (-5, "Minus", "a"), (2**62, "Far", "a")])
    assert Counter(tuple(r) for r in audit(docs, scratch).collect()) == brute_manifest([r.asDict() for r in docs.collect()])
    assert audit(make_docs([]), scratch).count() == 0


@pytest.mark.parametrize("sizes", [[1], [16], [17], [257], [300, 1, 16, *[2] * 16]])
def test_manifest_of_many_shapes(spark, scratch, make_docs, sizes):
    docs = make_docs([(100 * n + i, f"Text {n} {i}", f"s{n}") for n, size in enumerate(sizes) for i in range(size)], extra=False)
    assert Counter(tuple(r) for r in audit(docs, scratch).collect()) == brute_manifest([r.asDict() for r in docs.collect()])


def test_tampering_is_found_and_named_requests_are_proved(spark, scratch, make_docs):
    docs = make_docs([(i, f"Text {i}", "s" if i % 3 else "t") for i in range(80)])
    got = audit(docs, scratch, tampered=F.col("doc_id") == 40).collect()
    assert [r.doc_id for r in got if not r.verified] == [40]
    manifest = write_manifest(docs, scratch, ("doc_id", "text"), "source", "doc_id")
    some = manifest.leaves.where("key in (0, 41, 79)")
    proved = prove(manifest, some, scratch).collect()
    assert sorted(r.key for r in proved) == [0, 41, 79]
    for r in proved:
        node = bytes(r.digest)
        for step in r.path:
            node = hashlib.sha256((bytes(step.before) + node + bytes(step.after)).hex().encode()).digest()
        assert node == manifest.root


def test_equal_rows_share_records(spark, scratch, make_docs):
    docs = make_docs([(1, "same", "s")] * 600, extra=False)
    assert Counter(tuple(r) for r in audit(docs, scratch).collect()) == brute_manifest([r.asDict() for r in docs.collect()])


# ---- exact duplicates


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER).encode(), []).append(i)
    out = []
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        first = ids.index(best)
        out += [(i, best, len(ids), n == first, hashlib.sha256(t).hexdigest()) for n, i in enumerate(ids)]
    return Counter(out)


@pytest.mark.parametrize("index", [{}, {"few": 2}, {"key_bits": 3, "capacity": 2}, {"key_bits": 1, "few": 2}])
def test_exact_duplicates_of_odd_rows(spark, scratch, make_docs, odd_rows, index):
    rows = [*odd_rows, *odd_rows, (None, "q", "a"), (None, "Q", "a"), *[(50 + n % 40, "Hot  text", "a") for n in range(300)], (60, "hot text", "a"), (61, "ÀB", "a"), (62, "àb", "a"), (63, "Àb", "a")]
    got = exact_duplicates(make_docs(rows).repartition(9), scratch, **index).drop("place").collect()
    assert Counter(tuple(r) for r in got) == brute_exact([r[:2] for r in rows])
    assert exact_duplicates(make_docs([]), scratch, **index).count() == 0


def test_exact_duplicates_on_given_table(spark, scratch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_exact([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter(tuple(r) for r in exact_duplicates(docs, scratch).drop("place").collect()) == want


def test_texts_that_share_a_key_are_chained(spark, scratch, make_docs):
    docs = make_docs([(n, f"text {n % 50}", "a") for n in range(100)])
    index = build_index(docs, scratch, key_bits=2, capacity=4)
    places = Counter((r.key, r.place) for r in index.entries.collect())
    assert len(places) == 50 and set(places.values()) == {1} and max(p for _, p in places) > 5
    assert index.directory.count() == 1 << index.depth


def test_directory_doubles_for_overfull_buckets_only():
    loads = np.zeros(256, np.int64)
    loads[3], loads[2], loads[200], loads[255] = 9, 5, 4, 1
    found = Directory(loads, 9)
    assert found.depth == 8 and len(found.slots) == 256
    assert {(b.prefix, b.depth): b.load for b in found.slots if b.load} == {(2, 8): 5, (3, 8): 9, (1, 1): 5}
    assert sum(b.load for b in {id(b): b for b in found.slots}.values()) == 19
    for slot, first, depth, owner in found.rows(4):
        assert first == slot >> 8 - depth << 8 - depth and 0 <= owner < 4
    assert [r[3] for r in found.rows(4)] == sorted(r[3] for r in found.rows(4))
    whole = Directory(np.full(256, 1), 10_000)
    assert whole.depth == 0 and len(whole.slots) == 1


# ---- hard negatives


def brute_negatives(rows, labels=10):
    fine = [(i, l, tuple(int(np.floor(256 * np.float64(x))) for x in v)) for i, l, v, *_ in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, l, v in fine:
        if i % 50 == 0:
            anchors[i] = min(anchors.get(i, (l, v)), (l, v))
    out = []
    for a, (l, v) in anchors.items():
        scores = [(-sum(x * y for x, y in zip(v, w)), i, m) for i, m, w in fine if i != a and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scores if x[2] == l)[:5]:
            negatives = sorted(x for x in scores if x[2] != l and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(negatives)]
    return Counter(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], "vec_id bigint, label int, embedding array<double>, id string, v string, b string, home string")


def mined(df, scratch, **index):
    return Counter(tuple(r) for r in hard_negatives(df, F.col("id") % 50 == 0, F.col("label"), scratch, **index).collect())


@pytest.mark.parametrize("block", [128, 8192])
def test_hard_negatives(spark, scratch, block):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    rows = [(i, int(rng.integers(3)), [float(x) for x in centres[i % 12] + 0.1 * rng.normal(size=8)]) for i in range(1500)]
    rows += [(6000 + i, i % 3, [1.0] * 8) for i in range(600)]  # ties, more than a block
    rows += [(None, 1, [1.0] * 8), (5000, None, [1.0] * 8), (5001, 1, None), (5050, 1, [1.0, None, 1.0]), (5100, 1, [math.nan] * 8), (5110, 1, [math.inf] * 8)]
    rows += [(5150, 1, [1.0, 2.0]), (5151, 2, [0.6, 1.9]), (5152, 1, [1.2, 2.0]), (5200, 1, []), (5201, 1, []), (5202, 3, []), (50, 0, [0.0] * 8), (50, 0, [0.0] * 8), (51, 0, [3.0] * 8)]
    rows += [(5250, 2, [1e5, 3e9, 7.0]), (5251, 2, [1e5 + 1, 2.0, 1.0]), (5252, 4, [3e4, 1.0, 1.0])]  # beyond 53 bits
    want = brute_negatives(rows)
    assert len(want) > 300 and mined(vectors(spark, rows), scratch, block=block) == want


def test_hard_negatives_of_little(spark, scratch):
    assert not mined(vectors(spark, []), scratch)
    assert not mined(vectors(spark, [(50, 1, [1.0, 0.0]), (51, 1, [1.0, 0.0])]), scratch)  # one label
    opposite = [(50, 1, [1.0, 0.0]), (51, 1, [-1.0, 0.0]), (52, 2, [-0.7, 0.0]), (53, 2, [0.0, 0.0])]
    assert not mined(vectors(spark, opposite), scratch) and not brute_negatives(opposite)
    zero = [(50, 1, [1.0, 0.0]), (51, 1, [0.0, 1.0]), (52, 2, [0.0, 2.0]), (53, 2, [0.5, 0.0])]
    assert mined(vectors(spark, zero), scratch) == brute_negatives(zero) == Counter([(50, 51, 1, 52, 0, 0)])


def test_cells_come_in_the_order_of_their_sums():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 5, 7).astype(float), rng.normal(size=5)
    walk = list(multi_sequence(a, b))
    assert sorted((i, j) for i, j, _ in walk) == [(i, j) for i in range(7) for j in range(5)]
    sums = [s for *_, s in walk]
    assert sums == sorted(sums, reverse=True) and all(s == a[i] + b[j] for i, j, s in walk)


def test_most_cells_of_clustered_vectors_are_not_visited():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 256
    x = np.floor(centres[np.arange(20_000) % 40] + 5 * rng.normal(size=(20_000, 16)))
    codes = Codes((codebook(x[:, :8], 40), codebook(x[:, 8:], 40)))
    (i, r1), (j, r2) = (nearest(h, w) for h, w in zip(codes.halves(x), codes.words))
    np.maximum.at(codes.radii[0], i, r1)
    np.maximum.at(codes.radii[1], j, r2)
    block = Block(codes, np.arange(20_000), np.arange(20_000) % 2, x, i, j)
    found = block.search(x[7], [(m[0], s[0]) for m, s in codes.bounds(x[7:8])], 7, 1, True, 5, [(-(2**62), 2**62, None)])
    scores = x.astype(int) @ x[7].astype(int)
    want = sorted((-scores[n], n) for n in range(1, 20_000, 2) if n != 7)[:5]
    assert [(-int(s), int(block.ids[r])) for r, s in zip(found[0][1], found[0][2])] == want
    assert block.visited < len(block.cells) / 4
