"""Each stage of the pipeline against a plain Python result on the stage's own input."""

import hashlib
import math
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken
from test_llm_documents import RANKS, SMALL, brute_components, brute_lines, resharing, split

import corpus_pipeline
from lodestack.llm.bpe import read_ranks
from lodestack.llm.mixing import SIGNS
from lodestack.llm.quality import fit, score


def copies(rows):
    """How often each row is taken: whole epochs, and the rest from the smallest keys of its source."""
    sizes, keyed, out = defaultdict(int), defaultdict(list), Counter()
    for r in rows:
        size = len(split(r.text))
        clean = len([c for c in r.text if c not in SIGNS]) / len(r.text) if r.text else 0.0
        u = (int(hashlib.md5(f"7:{r.doc_id}".encode()).hexdigest()[:13], 16) + 1) / 2**52
        keyed[r.source].append((math.floor(-math.log(u) / (0.25 + clean**3 * 0.75) * 2**32), str(r.doc_id), size, r))
        sizes[r.source] += size
    for source, target in resharing(sizes).items():
        whole = math.floor(round(target / sizes[source], 9)) if sizes[source] else 0
        rest, before = target - whole * sizes[source], 0
        for _, _, size, r in sorted(keyed[source], key=lambda x: x[:2]):
            before += size
            out[r] += whole + (rest > 1e-6 and before - size / 2 <= rest)
    return +out


def test_stages_equal_plain_results(spark, scratch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tables, before = [docs.collect()], docs
    for _, stage in corpus_pipeline.STAGES:
        before = scratch.put(stage(spark, before, SMALL))
        tables.append(before.collect())
    given, accepted, lines, near, mixed, encoded = tables

    scores = score(docs, *fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet")), ["doc_id"]).collect()
    passed = {r.doc_id for r in scores if r.score >= 0.7}
    assert Counter(accepted) == Counter(r for r in given if r.doc_id in passed)

    kept = {i: t for i, (_, t) in brute_lines([(r.doc_id, r.text) for r in accepted]).items()}
    left = [r for r in accepted if kept[r.doc_id] == r.text or kept[r.doc_id].strip(" ")]
    assert Counter(lines) == Counter(type(r)(**{**r.asDict(), "text": kept[r.doc_id], "n_chars": None if r.text is None else len(kept[r.doc_id])}) for r in left)

    top = brute_components([(r.doc_id, r.text) for r in lines])
    assert Counter(near) == Counter(r for r in lines if top[r.doc_id] == r.doc_id)

    assert Counter(mixed) == copies(near)

    reference = tiktoken.Encoding("reference", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    ids = [(r.doc_id, len(reference.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in mixed]
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in encoded) == Counter(ids)


def test_near_dedup_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    given = docs.collect()
    top = brute_components([(r.doc_id, r.text) for r in given])
    left = [r for r in given if top[r.doc_id] == r.doc_id]
    assert len(left) < len(given) and Counter(corpus_pipeline.near_dedup(spark, docs, SMALL).collect()) == Counter(left)


def test_near_dedup_goes_by_row(spark):
    """Repeated ids, null ids and texts, names that clash, and no other columns than these."""
    a, b = " ".join(f"w{n}" for n in range(60)), " ".join(f"v{n}" for n in range(60))
    rows = [(3, a, "x", 1), (5, a + " tail", "x", 2), (5, b, "x", 3), (7, None, "x", 4), (7, None, "x", 5), (None, b, "x", 6), (None, "", "x", 7), (9, a, "x", 8), (9, "one", "x", 9), (9, "one", "x", 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row string, component_id int")
    left = sorted(r.component_id for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect())
    assert left[:-1] == [1, 3, 4, 5, 7] and left[-1] in (9, 10)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), SMALL).columns == docs.columns


def test_stages_of_odd_rows(spark, scratch, odd_rows):
    given = [(i, t, "en", s, "x", "x", "x") for i, t, s in odd_rows]
    docs = spark.createDataFrame(given, "doc_id bigint, text string, lang string, source string, score string, kept_text string, r string")
    for table in (docs, docs.limit(0)):
        before = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = scratch.put(stage(spark, before, SMALL))
            assert after.columns == docs.columns and after.count() <= 2 * before.count(), name
            if before.count() == 0:
                assert after.count() == 0
            before = after
    lines = corpus_pipeline.line_dedup(spark, docs, SMALL).collect()
    assert sum(r.text is None for r in lines) == 1 and all(r.kept_text == "x" for r in lines)
    kept = {(r.doc_id, r.text) for r in lines}
    want = {(i, t) for i, (_, t) in brute_lines([(i, t) for i, t, _ in odd_rows if i is not None and i != 5]).items()}
    assert (1, None) in kept and (2, "") in kept and {i for i, _ in kept} <= {i for i, _, _ in odd_rows} and want
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == len(odd_rows)


def test_mixing_runs_no_python_on_executors(spark, monkeypatch):
    def no_python(session):
        raise AssertionError("mixing starts Python workers")

    monkeypatch.setattr(corpus_pipeline, "give_back_memory", no_python)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    mixed = corpus_pipeline.mix(spark, docs, SMALL)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert mixed.count() > docs.count() and not [name for name in ("MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython") if name in plan]
