"""Vector operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.operators import search as se
from lodestack.operators.knowledge import _links, connected, ingest_knowledge
from lodestack.operators.search import containing_words, hybrid_search, neighbors, search, text_hits
from lodestack.operators.similarity import band_keys, band_plan, check_vector_size, nearest_above, vector_top_k


def clustered(rng, n, d=8, centres=6, noise=0.15):
    base = rng.normal(size=(centres, d))
    vectors = base[rng.integers(centres, size=n)] + noise * rng.normal(size=(n, d))
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def frame(spark, vectors, key, **columns):
    rows = [(i, v.tolist(), *[c[i] for c in columns.values()]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, ", ".join([f"{key} bigint", "vector array<double>", *[f"{c} string" for c in columns]]))


def best_matches(new, stored, t):
    scores = new @ stored.T
    return {i: int(row.argmax()) for i, row in enumerate(scores) if row.max() >= t}


@pytest.mark.parametrize("how", [{"exact": True}, {"bits": 0}, {"bits": 3}, {"bits": 8, "recall": 0.999999}, {}])
def test_nearest_above_finds_all(spark, how):
    rng = np.random.default_rng(1)
    stored, new = clustered(rng, 300), clustered(rng, 200)
    found = nearest_above(frame(spark, new, "new_id"), frame(spark, stored, "stored_id"), 0.95, block_rows=32, **how)
    assert {r.new_id: r.match_id for r in found.collect()} == best_matches(new, stored, 0.95)


def test_nearest_above_with_a_hot_vector(spark):
    rng = np.random.default_rng(2)
    stored, new = clustered(rng, 90), clustered(rng, 90)
    new[30:60] = stored[3]
    stored[10:40] = stored[3]
    found = nearest_above(frame(spark, new, "new_id"), frame(spark, stored, "stored_id"), 0.9, bits=2, block_rows=8)
    got = {r.new_id: (r.match_id, round(r.similarity, 9)) for r in found.collect()}
    scores = new @ stored.T
    want = {i: round(float(row.max()), 9) for i, row in enumerate(scores) if row.max() >= 0.9}
    assert {k: v[1] for k, v in got.items()} == want
    assert all(got[i][0] == 3 for i in range(30, 60))


def spread_pairs(rng, n, d, cosine):
    """n directions and, for each, another at that cosine."""
    a, b = rng.normal(size=(2, n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


def test_recall_at_the_threshold(spark):
    stored, new = spread_pairs(np.random.default_rng(8), 1500, 24, 0.951)
    for recall in (0.9, 0.999):
        found = nearest_above(frame(spark, new, "new_id"), frame(spark, stored, "stored_id"), 0.95, bits=9, recall=recall)
        right = sum(r.new_id == r.match_id for r in found.collect())
        assert right >= (recall - 0.02) * 1500  # two standard deviations of 1,500 draws at 0.9


def test_candidates_grow_about_linearly(spark):
    load = {}
    for n in (4_000, 16_000, 64_000):
        planes, bands = band_plan(n, 0.95, 0.99)
        stored, new = spread_pairs(np.random.default_rng(9), n, 24, 0.96)
        sides = [frame(spark, x, "id").select(F.explode(band_keys(planes, bands)("vector")).alias("k")).groupBy("k").count() for x in (stored, new)]
        load[n] = sides[0].join(sides[1].withColumnRenamed("count", "other"), "k").agg(F.sum(F.col("count") * F.col("other"))).first()[0]
    assert load[64_000] / load[4_000] < 16**1.35  # all pairs grow by 256
    assert load[64_000] < 64_000**2 / 40


def test_plan_of_bands():
    assert band_plan(100, 0.95, 0.999) == (0, 1)
    assert band_plan(10**9, 0.3, 0.9999)[0] < band_plan(10**9, 0.95, 0.9999)[0]
    planes, bands = band_plan(10**6, 0.95, 0.999)
    assert (1 - (1 - np.arccos(0.95) / np.pi) ** planes) ** bands <= 0.001
    assert band_plan(10**6, 1.0, 0.999)[1] == 1


def test_vectors_that_match_nothing(spark):
    new = frame(spark, np.array([[0.0, 0.0], [1.0, 0.0], [-1.0, 0.0]]), "new_id")
    stored = frame(spark, np.array([[0.0, 0.0], [1.0, 0.0]]), "stored_id")
    for how in ({"exact": True}, {"bits": 4}):
        assert [(r.new_id, r.match_id) for r in nearest_above(new, stored, 0.9, **how).collect()] == [(1, 1)]
        assert nearest_above(new.limit(0), stored, 0.9, **how).count() == nearest_above(new, stored.limit(0), 0.9, **how).count() == 0


def test_nearest_above_stays_in_scope(spark):
    v = np.eye(3)[[0, 0, 1]]
    new = frame(spark, v, "new_id", user=["a", "b", "b"])
    stored = frame(spark, np.eye(3)[[0, 1]], "stored_id", user=["a", "b"])
    found = nearest_above(new, stored, 0.95, ["user"]).collect()
    assert {(r.new_id, r.match_id) for r in found} == {(0, 0), (2, 1)}


def test_top_k_paths_agree(spark):
    rng = np.random.default_rng(3)
    stored, asked = clustered(rng, 120), clustered(rng, 9)
    ones = lambda n: ["all"] * n
    small = vector_top_k(frame(spark, asked, "query_id"), frame(spark, stored, "stored_id"), 4)
    blocked = vector_top_k(
        frame(spark, asked, "query_id", s=ones(9)), frame(spark, stored, "stored_id", s=ones(120)), 4, ["s"]
    )
    want = {(i, int(j), r + 1) for i, row in enumerate(asked @ stored.T) for r, j in enumerate(np.argsort(-row)[:4])}
    assert {(r.query_id, r.stored_id, r["rank"]) for r in small.collect()} == want
    assert {(r.query_id, r.stored_id, r["rank"]) for r in blocked.collect()} == want


def test_vector_size_mismatch_fails(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "vector array<double>")
    with pytest.raises(Exception, match="vector size 1 does not match required 2"):
        check_vector_size(df, 2).collect()


def replay(vectors, force, stored, t):
    """One entry after the other, as a single process would do it."""
    alive = {f"s{i}": v for i, v in enumerate(stored)}
    log = {}
    for i, v in enumerate(vectors):
        names = sorted(alive)
        scores = [float(alive[n] @ v) for n in names]
        best = max(range(len(names)), key=lambda j: (scores[j], -j), default=None)
        match = names[best] if best is not None and scores[best] >= t else None
        if match and not force[i]:
            log[f"e{i:03d}"] = (False, match, False)
            continue
        if match:
            del alive[match]
        alive[f"e{i:03d}"] = v
        log[f"e{i:03d}"] = (True, match, match is not None)
    return log, set(alive)


@pytest.mark.parametrize("n,share,rounds", [(60, 0.0, 3), (150, 0.4, 0), (150, 0.4, 1), (150, 0.1, 3)])
def test_knowledge_equals_one_by_one(spark, n, share, rounds):
    rng = np.random.default_rng(4)
    vectors, stored = clustered(rng, n, noise=0.2), clustered(rng, 5, noise=0.2)
    force = rng.random(n) < share
    rows = [(f"e{i:03d}", i, bool(force[i]), "c", v.tolist()) for i, v in enumerate(vectors)]
    entries = spark.createDataFrame(rows, "entry_id string, arrival bigint, force boolean, collection_name string, vector array<double>")
    points = spark.createDataFrame([(f"s{i}", "c", v.tolist()) for i, v in enumerate(stored)], "point_id string, collection_name string, vector array<double>")
    log, alive = ingest_knowledge(entries, points, 0.93, rounds=rounds)
    want_log, want_alive = replay(vectors, force, stored, 0.93)
    assert {r.entry_id: (r.inserted, r.match_id, r.replaced) for r in log.collect()} == want_log
    assert {r.point_id for r in alive.collect()} == want_alive


def test_unforced_copies_settle_at_once(spark):
    rows = [(f"e{i:03d}", i, False, "c", [1.0, 0.0]) for i in range(200)]
    entries = spark.createDataFrame(rows, "entry_id string, arrival bigint, force boolean, collection_name string, vector array<double>")
    empty = entries.limit(0).select(F.col("entry_id").alias("point_id"), "collection_name", "vector")
    log, alive = ingest_knowledge(entries, empty)
    assert [r.point_id for r in alive.collect()] == ["e000"]
    assert log.where("reused AND match_id = 'e000'").count() == 199


def test_forced_copies_take_no_more_rounds(spark, monkeypatch):
    looks = []
    import lodestack.operators.knowledge as module

    look = module._look_around
    monkeypatch.setattr(module, "_look_around", lambda *a: looks.append(1) or look(*a))
    rows = [(f"e{i:03d}", i, True, "c", [1.0, 0.001 * i]) for i in range(200)]
    entries = spark.createDataFrame(rows, "entry_id string, arrival bigint, force boolean, collection_name string, vector array<double>")
    empty = entries.limit(0).select(F.col("entry_id").alias("point_id"), "collection_name", "vector")
    log, alive = ingest_knowledge(entries, empty)
    assert [r.point_id for r in alive.collect()] == ["e199"]
    assert {(r.entry_id, r.match_id) for r in log.collect()} == {("e000", None), *((f"e{i:03d}", f"e{i - 1:03d}") for i in range(1, 200))}
    assert len(looks) == 4  # three rounds and the final look
    with pytest.raises(ValueError, match="197 entries and points|19[0-9] entries|200 entries"):
        ingest_knowledge(entries, empty, group_rows=50)


def test_connected_chains_and_stars(spark):
    links = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("z", f"y{i}") for i in range(9)] + [("q", "q")]
    got = {r.node: r.head for r in connected(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {**{f"n{i:03d}": "n000" for i in range(61)}, **{f"y{i}": "y0" for i in range(9)}, "z": "y0"}


def test_links_hang_together_like_all_pairs():
    rng = np.random.default_rng(7)
    near = rng.random((40, 50)) < 0.03
    ids = np.array([f"a{i:02d}" for i in range(40)]), np.array([f"b{i:02d}" for i in range(50)])
    found = _links(near.astype(float), 0.5, *ids)
    assert len(found) <= 90

    def groups(pairs):
        top = {}

        def find(x):
            while top.setdefault(x, x) != x:
                x = top[x]
            return x

        for a, b in pairs:
            top[find(a)] = find(b)
        out = {}
        for x in list(top):
            out.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, out.values()))

    assert groups(zip(found["a"], found["b"])) == groups((ids[0][i], ids[1][j]) for i, j in zip(*np.nonzero(near)))


CHUNKS = [
    (1, 0, "c0", "Red apple apple", "p"),
    (1, 1, "c1", "green pear", "p"),
    (1, 3, "c3", "pineapple RED red", "pai"),
    (1, 4, "c0", "blue", "p"),
    (2, 0, "d0", "apple", "p"),
]


def chunk_frame(spark):
    return spark.createDataFrame(CHUNKS, "doc_id bigint, chunk_order int, chunk_id string, chunk string, original_tag_type string")


def test_text_hits_count_substrings(spark):
    queries = spark.createDataFrame([(7, 1, " apple  RED red "), (8, 2, "pear a"), (9, 3, "x")], "query_id bigint, doc_id bigint, query string")
    got = {(r.query_id, r.doc_id, r.chunk_order): r.score for r in text_hits(chunk_frame(spark), queries).collect()}
    assert got == {(7, 1, 0): 3.0, (7, 1, 3): 3.0, (8, 2, 0): 1.0}


def test_long_tokens_and_overlaps(spark):
    long = "abcdefghijklmnop"
    chunks = spark.createDataFrame([(1, 0, "c", f"xx{long}yy {long[:9]}z aaaa", "p")], "doc_id bigint, chunk_order int, chunk_id string, chunk string, original_tag_type string")
    queries = spark.createDataFrame([(1, 1, long), (2, 1, "aa"), (3, 1, "bcdefghijz")], "query_id bigint, doc_id bigint, query string")
    assert {r.query_id: r.score for r in text_hits(chunks, queries).collect()} == {1: 1.0, 2: 2.0}


def brute_hits(chunks, queries):
    out = {}
    for d, order, text in chunks:
        for q, scope, query in queries:
            n = sum((text or "").lower().count(t) for t in set((query or "").lower().split())) if d is not None and d == scope else 0
            if n:
                out[q, d, order] = out.get((q, d, order), 0) + n
    return out


@pytest.mark.parametrize("small", [False, True])
def test_text_hits_in_many_blocks(spark, monkeypatch, small):
    if small:  # cells of a few texts and a few tokens on either side
        monkeypatch.setattr("lodestack.operators.search.TEXT_BYTES", 300)
        monkeypatch.setattr("lodestack.operators.search.NEEDLE_BYTES", 200)
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abAé"), rng.integers(1, 5)))
    chunks = [(int(rng.integers(3)), i, " ".join(word() for _ in range(rng.integers(0, 40)))) for i in range(120)]
    chunks += [(0, 500, None), (0, 501, ""), (1, 502, "abab"), (1, 502, "ababab"), (9, 503, "ab"), (None, 504, "ab")]
    queries = [(q, int(rng.integers(4)), " ".join(word() for _ in range(rng.integers(0, 9)))) for q in range(60)] + [(90, 1, None), (91, 1, " "), (92, None, "ab")]
    frames = [
        spark.createDataFrame([(*c, "c", "p") for c in chunks], "doc_id bigint, chunk_order int, chunk string, chunk_id string, original_tag_type string"),
        spark.createDataFrame(queries, "query_id bigint, doc_id bigint, query string"),
    ]
    assert {(r.query_id, r.doc_id, r.chunk_order): r.score for r in text_hits(*frames).collect()} == brute_hits(chunks, queries)
    assert text_hits(frames[0].limit(0), frames[1]).count() == text_hits(frames[0], frames[1].limit(0)).count() == 0


def test_words_that_contain_needles_by_scope(spark):
    needles = spark.createDataFrame([("u", "ab"), ("v", "b"), ("v", "")], "user string, needle string")
    words = spark.createDataFrame([("u", "cab"), ("u", "b"), ("v", "ab"), ("v", "a")], "user string, word string")
    assert {tuple(r) for r in containing_words(needles, words, ["user"]).collect()} == {("u", "ab", "cab"), ("v", "b", "ab")}


def test_hybrid_ties_and_shared_ids(spark):
    queries = spark.createDataFrame([(1, 1, "apple", [1.0, 0.0])], "query_id bigint, doc_id bigint, query string, vector array<double>")
    vectors = spark.createDataFrame([(1, "c0", [0.0, 1.0]), (1, "c3", [0.0, -1.0]), (1, "gone", [1.0, 0.0])], "doc_id bigint, chunk_id string, vector array<double>")
    best = hybrid_search(queries, chunk_frame(spark), 5, vectors=vectors).orderBy("rank").collect()
    # c0 is in orders 0 and 4: the last text score (order 0 is the only hit) and the last order speak for it.
    assert [(r.chunk_id, r.chunk_order, round(r.score, 6)) for r in best] == [("c0", 4, 2.0), ("c3", 3, 1.0)]
    text_only = hybrid_search(queries, chunk_frame(spark), 1).collect()
    assert [(r.chunk_id, r.score) for r in text_only] == [("c0", 2.0)]


def test_context_and_strict_clipping(spark):
    hits = spark.createDataFrame([(1, 3)], "doc_id bigint, chunk_order int")
    near = lambda strict: sorted(r.near_order for r in neighbors(hits, chunk_frame(spark), strict=strict).collect())
    assert near(False) == [1, 3, 4]
    assert near(True) == [1, 3]
    queries = spark.createDataFrame([(1, 1, "pear")], "query_id bigint, doc_id bigint, query string")
    row = search(queries, chunk_frame(spark)).first()
    assert [c.chunk_order for c in row.context] == [0, 1, 3]


def shared_words(spark, texts: int = 60, queries: int = 40):
    """One scope in which nearly every query shares a token with every chunk, and ids are reused by several chunks."""
    rng = np.random.default_rng(17)
    word = lambda: "".join(rng.choice(list("abc"), rng.integers(1, 4)))
    chunks = [(1, i, f"c{rng.integers(texts)}", " ".join(word() for _ in range(rng.integers(0, 12))), "p") for i in range(texts)]
    asked = [(q, 1, " ".join(word() for _ in range(6)), [float(q % 7), 1.0]) for q in range(queries)]
    return (
        spark.createDataFrame(chunks, "doc_id bigint, chunk_order int, chunk_id string, chunk string, original_tag_type string"),
        spark.createDataFrame(asked, "query_id bigint, doc_id bigint, query string, vector array<double>"),
    )


def test_only_the_best_word_hits_leave_a_cell(spark):
    chunks, queries = shared_words(spark)
    assert text_hits(chunks, queries).count() > 40 * 30
    nothing = queries.limit(0).select("query_id", "doc_id", F.lit("").alias("chunk_id"))
    assert se.best_text_hits(chunks, queries, nothing, 3).count() == 40 * 3


def test_hybrid_search_is_the_best_of_all_pairs(spark, monkeypatch):
    chunks, queries = shared_words(spark)
    rng = np.random.default_rng(18)
    points = [(1, f"c{i}", rng.standard_normal(2).tolist()) for i in range(0, 70)]
    vectors = spark.createDataFrame(points, "doc_id bigint, chunk_id string, vector array<double>")
    hits = vector_top_k(queries, vectors.withColumnRenamed("chunk_id", "stored_id"), 4, ["doc_id"]).withColumnRenamed("stored_id", "chunk_id")
    whole = {tuple(r) for r in se.merge_scores(hits, text_hits(chunks, queries), chunks, 4).collect()}
    assert {tuple(r) for r in hybrid_search(queries, chunks, 4, vectors=vectors).collect()} == whole and len(whole) == 160
    monkeypatch.setattr(se, "RANKED_BYTES", 1_500)  # several blocks on either side
    monkeypatch.setattr(se, "ASKED_ROWS", 7)
    assert {tuple(r) for r in hybrid_search(queries, chunks, 4, vectors=vectors).collect()} == whole


def test_windows_are_put_together_once_for_all_hits(spark, monkeypatch):
    chunks, queries = shared_words(spark)
    asked, plain = [], se.neighbors
    monkeypatch.setattr(se, "neighbors", lambda hits, *args, **more: (asked.append(hits.count()), plain(hits, *args, **more))[1])
    found = search(queries, chunks, 4).collect()
    by_id = {r.chunk_order: r for r in chunks.collect()}
    assert len(found) == 160 and asked[0] == len({r.chunk_order for r in found}) < 160
    for r in found:
        near = [by_id[i] for i in range(r.chunk_order - 2, r.chunk_order + 3) if i in by_id]
        assert [(c.chunk_order, c.chunk_id, c.text) for c in r.context] == [(n.chunk_order, n.chunk_id, n.chunk) for n in near]
