"""Vector searches, language identification, and the pipeline as a whole."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestack.llm.dualtree import Search, cover_tree, exact_top_k
from lodestack.llm.langid import identify
from lodestack.llm.permutation import approximate_top_k
from lodestack.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def every():
    return F.col("id") % 5 == 0


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, id string, v string, b string")


def rows_of(x, start=0):
    return [(start + n, [float(np.float32(c)) for c in v], 1, "x", "x", "x") for n, v in enumerate(x)]


ODD = [
    (None, [1.0, 2.0], 1, "x", "x", "x"), (900, None, 1, "x", "x", "x"), (905, [1.0, None], 1, "x", "x", "x"), (910, [1.0, math.nan], 1, "x", "x", "x"), (915, [math.inf, 1.0], 1, "x", "x", "x"),
    (920, [], 1, "x", "x", "x"), (925, [1.0, 2.0, 3.0], 1, "x", "x", "x"), (930, [2.0, 1.0, 0.5], 1, "x", "x", "x"), (931, [2.0, 1.0, 0.5], 1, "x", "x", "x"), (931, [2.0, 1.0, 0.5], 1, "x", "x", "x"), (935, [0.0, 0.0, 0.0], 1, "x", "x", "x"),
]


def brute(rows, k, whole, zero_out):
    fine = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    fine = [(i, np.floor(256 * v) if whole else v) for i, v in fine if not zero_out or v.any()]
    out = {}
    for q, x in fine:
        if q % 5 == 0:
            scores = [(-sum(float(a) * float(b) for a, b in zip(x, y)), i) for i, y in fine if i != q and len(y) == len(x)]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("block", [64, 100_000])
def test_exact_search(spark, block):
    x = np.random.default_rng(1).normal(size=(300, 3)).round(1)
    rows = [*[(i, v, *t) for i, v, *t in rows_of(x)], *[(400 + n, [0.5, 0.5, 0.5], 1, "x", "x", "x") for n in range(120)], *ODD]
    got = found(exact_top_k(frame(spark, rows), every(), k=5, block=block, group=32))
    want = {q: v for q, v in brute(rows, 5, True, False).items() if v}
    assert got == want
    assert exact_top_k(frame(spark, []), every()).count() == 0


def test_trees_prune_and_cover():
    draw = np.random.default_rng(2)
    x = np.concatenate([draw.normal(c, 0.05, (900, 3)) for c in (-8, 0, 9)])
    tree = cover_tree(x)

    def covered(node):
        assert np.sqrt(((x[node.rows] - node.centre) ** 2).sum(1)).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
        return 1 if not node.children else sum(covered(c) for c in node.children)

    leaves = covered(tree)
    search = Search(np.floor(256 * x[:5]), np.floor(256 * x), np.arange(5), 5)
    search.run(np.arange(len(x)))
    assert 0 < search.visited < leaves


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, [2.0**22, 3.0], 1, "x", "x", "x"), (1, [2.0**22, 5.0], 1, "x", "x", "x"), (2, [2.0**22, 4.0], 1, "x", "x", "x")]
    assert found(exact_top_k(frame(spark, rows), every())) == {0: [(1, (2**30) ** 2 + 768 * 1280), (2, (2**30) ** 2 + 768 * 1024)]}


def test_permutation_index(spark):
    x = np.random.default_rng(3).normal(size=(3000, 16))
    rows = [*rows_of(x / np.linalg.norm(x, axis=1, keepdims=True)), *[(i + 9000 if i is not None else None, *t) for i, *t in ODD]]
    rows = [r for r in rows if r[0] is None or r[0] < 9000] + ODD[:5]
    got, want = found(approximate_top_k(frame(spark, rows), every(), k=20, block=1024)), brute(rows, 20, False, True)
    assert got.keys() == {q for q, v in want.items() if v}
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in got)
    assert hits >= 0.9 * sum(len(want[q]) for q in got)
    exact = {(q, i): s for q, v in brute(rows, 10**6, False, True).items() for i, s in v}
    assert all(math.isclose(s, exact[q, i], rel_tol=1e-12, abs_tol=1e-12) for q, v in got.items() for i, s in v)


@pytest.mark.parametrize("spread, reranked, least", [(0.25, 0.15, 0.9), (0.5, 0.15, 0.9), (1.0, 0.15, 0.9), (1.0, 1.0, 1.0)])
def test_permutation_index_of_varied_lengths(spark, spread, reranked, least):
    draw = np.random.default_rng(11)
    x = draw.normal(size=(6000, 32))
    x *= np.exp(spread * draw.normal(size=(6000, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    rows = rows_of(x)
    got = found(approximate_top_k(frame(spark, rows), F.col("id") % 60 == 0, k=20, reranked=reranked))
    x, hits = np.array([r[1] for r in rows]), 0
    for q, v in got.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len({i for i, _ in v} & set(np.argsort(-scores)[:20].tolist()))
    assert len(got) == 100 and hits >= least * 20 * len(got)


def test_permutation_index_with_few_and_odd_rows(spark):
    rows = [*ODD, *[(1000 + n, [1.0, 0.0, 0.5], 1, "x", "x", "x") for n in range(30)]]
    got, want = found(approximate_top_k(frame(spark, rows), every(), k=20)), brute(rows, 20, False, True)
    assert got == {q: v for q, v in want.items() if v}
    assert approximate_top_k(frame(spark, []), every()).count() == 0


def test_permutation_index_with_a_third_of_copies(spark):
    """Copies near a query are found by the smallest ids; for other queries they take no place of nearer rows."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[draw.permutation(3000)[:1000]] = x[0]
    rows = rows_of(x)
    got, want = found(approximate_top_k(frame(spark, rows), every(), k=20)), brute(rows, 20, False, True)
    copies = {i for i, v, *_ in rows if v == rows[0][1]}
    same = [q for q in got if q in copies]
    assert len(same) > 100 and all([i for i, _ in got[q]] == sorted(copies - {q})[:20] for q in same)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert sum(hits) >= 0.9 * 20 * len(want)


def test_permutation_index_of_a_rare_width(spark):
    y = np.random.default_rng(6).normal(size=(3000, 24))
    rows = rows_of(y / np.linalg.norm(y, axis=1, keepdims=True), 100_000)
    many = spark.range(60_000).selectExpr("id as vec_id", "array(cast(id + 1 as float)) as embedding")
    both = many.unionByName(frame(spark, rows).select("vec_id", "embedding"))
    got = found(approximate_top_k(both, (F.col("id") % 50 == 0) & (F.col("id") >= 100_000), k=20, block=100_000))
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert sorted(got) == [i for i in ids if i % 50 == 0]
    hits = 0
    for q, v in got.items():
        scores = np.where(ids == q, -np.inf, x @ x[ids == q][0])
        hits += len({i for i, _ in v} & set(ids[np.argsort(-scores)[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(got)


def test_recall_on_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = found(approximate_top_k(table, F.col("id") % 20 == 0, k=20))
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hits = 0
    for q, v in got.items():
        scores = x @ x[ids == q][0]
        scores[ids == q] = -np.inf
        hits += len({i for i, _ in v} & set(ids[np.argsort(-scores)[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(got)


# ---- language identification


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, own string, text string")


def test_evidence_is_fused(spark, scratch):
    docs = spark.createDataFrame([(1, "the and of was " * 40, "en"), (2, "der die und das " * 40, "de"), (3, None, "fr"), (4, "x", None), (5, "y", "")], "doc_id bigint, text string, lang string")
    german, english = "<p>der und die das</p>", "<p>the of and was</p>"
    rows = [(n, f"http://a.beispiel.de/{n}", f'<html lang="de">{german}</html>') for n in range(30)] + [(100 + n, f"http://b.example.com/{n}", f"<html lang=en>{english}</html>") for n in range(30)]
    rows += [(200, "http://a.beispiel.de/x", "<p>zzz</p>"), (201, "http://new.beispiel.de/x", "<p>zzz</p>"), (202, "http://b.example.com/y", "<p>zzz</p>"), (203, None, '<html lang="de">'), (204, "", None), (205, "no address", "")]
    rows += [(206, "http://b.example.com/z", f'<html lang="en"><!-- the of --><script>the of and</script>{german * 5}</html>'), (None, "http://a.beispiel.de", german)]
    got = {r.page_id: r for r in identify(pages_of(spark, [(*r, "x", "x", "x") for r in rows]), docs, scratch).collect()}
    assert len(got) == len(rows) and all(0 < r.confidence <= 1 for r in got.values())
    assert all(got[n].lang == "de" for n in (*range(30), 200, 201, 203, 206, None)) and all(got[n].lang == "en" for n in (*range(100, 130), 202))
    assert got[206].text_lang == "de" and got[206].declared == "en" and got[204].host is None and got[205].declared == ""
    assert got[201].confidence < got[200].confidence


def test_language_of_nothing(spark, scratch):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id bigint, text string, lang string")
    page = pages_of(spark, [(1, "http://h.com", "<p>a</p>", "x", "x", "x")])
    assert identify(page.where("false"), docs, scratch).count() == 0
    row = identify(page, docs.where("false"), scratch).first()
    assert (row.lang, row.text_lang, row.confidence) == (None, None, 0.0)
    row = identify(page, docs, scratch).first()
    assert (row.lang, row.confidence) == ("en", 1.0)


def test_every_language_of_the_texts_takes_part(spark, scratch):
    letters = [chr(97 + n // 26) + chr(97 + n % 26) for n in range(70)]
    said = {"l" + x: " ".join(f"{x}{y}" for y in ("qu", "ra", "sti", "to")) for x in letters}
    docs = spark.createDataFrame([(0, f"{t} " * 20, x) for x, t in said.items()], "doc_id bigint, text string, lang string")
    rows = [(n, f"http://{x}.org/{n}", f'<html lang="{x}"><p>{t}</p></html>', "x", "x", "x") for n, (x, t) in enumerate(said.items())]
    rows += [(n + 100, f"http://{x}.org/y", f"<p>{t}</p>", "x", "x", "x") for n, (x, t) in enumerate(said.items())]
    pages = pages_of(spark, [*rows, (None, None, None, "x", "x", "x")])
    got = identify(pages, docs, scratch).collect()
    assert len(got) == 141 and {r.page_id: r.lang for r in got if r.page_id is not None} == {n + m: x for n, x in enumerate(said) for m in (0, 100)}
    passes = identify(pages, docs, scratch, model_bytes=30 << 18).collect()  # three runs of languages
    assert sorted(map(repr, passes)) == sorted(map(repr, got))


def test_languages_of_given_pages(spark, scratch):
    pages, docs = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("pages", "documents"))
    got = identify(pages, docs, scratch).collect()
    assert len(got) == pages.count()
    assert sum(r.lang == r.declared for r in got) > 0.95 * len(got)


# ---- pipeline


def test_pipeline_stages(spark, scratch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before, counts = docs.columns, docs, []
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "byte-level BPE"]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = scratch.put(stage(spark, before, SMALL))
        if n < 4:
            assert after.columns == columns and after.dtypes == docs.dtypes
            assert after.join(before, "doc_id", "left_anti").count() == 0
        counts.append(after.count())
        before = after
    assert 0 < counts[2] <= counts[1] <= counts[0] < docs.count() and counts[4] == counts[3] > 0
    assert corpus_pipeline.run(spark, SMALL).count() == counts[4]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    """The registered query gives the rows of its SQL on the smallest tables."""
    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = connection.execute(ORACLES[name]).to_arrow_table()
    got = QUERIES[name](spark, SMALL).toArrow()
    names = sorted(want.column_names)
    assert names == sorted(got.column_names) and want.num_rows == got.num_rows > 0
    rows = [sorted(zip(*[t[c].to_pylist() for c in names]), key=repr) for t in (got, want)]
    assert rows[0] == rows[1]


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 11))
