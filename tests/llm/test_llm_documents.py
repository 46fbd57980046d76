"""Operators on documents against brute force, with odd rows, extra columns and empty tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from sample_words import words

from lodestack.llm import lines
from lodestack.llm.bpe import Codec, build_model, encode_documents, read_ranks
from lodestack.llm.components import components
from lodestack.llm.lines import dedupe_lines
from lodestack.llm.minhash import near_duplicates, shingle_sets
from lodestack.llm.mixing import draw_key, mix_documents, plan_mix, source_targets
from lodestack.llm.quality import classify, train
from lodestack.llm.sharding import difference, shard_documents
from lodestack.llm.substrings import LENGTH, SuffixFamily, remove_repeats

SMALL = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def small(name):
    return pq.read_table(f"{SMALL}/{name}.parquet").to_pylist()


def split(text):
    return (text or "").encode().lower().split()


# ---- near duplicates


def shingles(text):
    w = split(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    rows = [r for r in rows if r[0] is not None]
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return {i: find(i) for i in top}


def variants(count, edits, seed):
    import random

    draw, base = random.Random(seed), words(seed, 150, 10**6)
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(draw.randrange(edits + 1)):
            w[draw.randrange(len(w))] = f"n{draw.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates(spark, scratch, make_docs, odd_rows):
    rows = [*odd_rows, *[(100 + n, t, "e") for n, t in enumerate(variants(60, 8, 3))], *[(300 + n, t, "e") for n, t in enumerate(variants(8, 2, 4))]]
    got = near_duplicates(make_docs(rows), scratch).collect()
    assert len(got) == len(rows)
    want = brute_components([(i, t) for i, t, _ in rows])
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    sizes = Counter((r.doc_id, r.n_shingles) for r in got)
    assert sizes == Counter((i, len(shingles(t))) for i, t, _ in rows)
    assert near_duplicates(make_docs([]), scratch).count() == 0


def test_near_duplicates_on_given_table(spark, scratch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute_components([(d["doc_id"], d["text"]) for d in small("documents")])
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, scratch).collect()} == want


def test_shingle_hashes_are_sets():
    import pyarrow as pa

    texts = ["a b c d e f", "", None, "a", "a b c d", "a b c d e a b c d e a b c d e"]
    sets, first = shingle_sets(pa.array(texts))
    assert np.diff(first).tolist() == [len(shingles(t)) for t in texts]


def test_components_of_chains_and_stars(spark, scratch):
    links = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint"), scratch).collect()}
    assert got == {**{n: 0 for n in range(41)}, **{n: 100 for n in range(100, 140)}}


# ---- quality


def test_quality_on_held_out_rows(spark, scratch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    marks = {r.doc_id: r.quality for r in labels.collect()}
    held = [(got[i].predicted, q) for i, q in marks.items() if i in got and got[i].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.95


def test_quality_of_odd_rows(spark, make_docs, odd_rows):
    labels = spark.createDataFrame([(None, 1), (4, None), (6, 1), (6, 0), (9, 0)], "doc_id bigint, quality int")
    got = classify(make_docs(odd_rows), labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in odd_rows) and all(0 < r.score < 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1 and not [r for r in got if r.doc_id is None][0].held_out
    none = classify(make_docs(odd_rows), labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert classify(make_docs([]), labels).count() == 0


def test_temperature_calibrates():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(4000, 5))
    y = (draw.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    s = train(x, y).scores(x)
    for low in (0.1, 0.4, 0.7):
        inside = (s >= low) & (s < low + 0.2)
        assert abs(y[inside].mean() - s[inside].mean()) < 0.06


# ---- shards


def test_differencing_is_tight_and_whole():
    import random

    draw = random.Random(5)
    units = [[draw.randrange(1, 1000)] for _ in range(400)] + [sorted((draw.randrange(500) for _ in range(6)), reverse=True) for _ in range(20)]
    placed = difference(units, 6)
    assert all(len(set(p)) == len(p) == len(u) for p, u in zip(placed, units))
    loads = Counter()
    for p, u in zip(placed, units):
        for place, load in zip(p, u):
            loads[place] += load
    assert max(loads.values()) - min(loads.values()) <= 5
    assert difference([], 3) == [] and difference([[4]], 3) == [[0]]


def test_shards(spark, scratch, make_docs, odd_rows):
    rows = [r for r in odd_rows if r[0] != 9] + [*[(1000 + n, " ".join(words(n, 5 + n % 60)), "s") for n in range(600)], *[(5000 + n, "copy of one text " * 9, "s") for n in range(300)]]
    got = shard_documents(make_docs(rows), scratch, shards=4).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    texts = defaultdict(list)
    for i, t, _ in rows:
        texts[i].append((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())))
    assert all((r["size"], r.text_crc32) in texts[r.doc_id] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    loads = [sum(r["size"] for r in x) for x in by.values()]
    assert len(by) == 4 and max(loads) - min(loads) < 0.03 * sum(loads) / 4
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    assert len({r.shard for r in got if r.doc_id in (6, 7)}) == 1
    assert shard_documents(make_docs([]), scratch).count() == 0


# ---- repeated passages


def brute_repeats(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[s : s + LENGTH] for b in raw for s in range(len(b) - LENGTH + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - LENGTH + 1):
            if seen[b[s : s + LENGTH]] > 1:
                gone[s : s + LENGTH] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("wide", [20_000, 1])
def test_repeats(spark, scratch, make_docs, odd_rows, monkeypatch, wide):
    monkeypatch.setattr("lodestack.llm.substrings.WIDE", wide)
    passage = " ".join(words(8, 60, 10**6))
    rows = [(i, t, s) for i, t, s in odd_rows if i != 9]
    rows += [(100 + n, " ".join([*words(50 + n, 5 * n), passage[n * 3 :], *words(80 + n, 40)]), "p") for n in range(12)]
    rows += [(200, "ab" * 300, "p"), (201, passage + passage, "p"), (202, "é" * 150 + "ü" * 90, "p")]
    got = remove_repeats(make_docs(rows), scratch).collect()
    want = Counter((i, *x) for (i, _, _), x in zip(rows, brute_repeats([t for _, t, _ in rows])))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert remove_repeats(make_docs([]), scratch).count() == 0


def test_repeats_on_given_table(spark, scratch):
    docs = small("documents")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(spark.read.parquet(f"{SMALL}/documents.parquet"), scratch).collect()}
    assert got == {d["doc_id"]: x for d, x in zip(docs, brute_repeats([d["text"] for d in docs]))}


def test_kept_bytes_are_returned(spark, scratch, make_docs):
    row = remove_repeats(make_docs([(1, "y" * 300 + "end", "a")]), scratch, keep_text=True).first()
    assert bytes(row.kept) == b"end" and [(s.start, s.end) for s in row.spans] == [(0, 300)]


def test_suffix_family_levels_grow_geometrically():
    draw, family = np.random.default_rng(3), SuffixFamily()
    keys = draw.integers(0, 3000, 4096).astype(np.uint64)
    for n in range(0, 4096, 64):
        family.add(keys[n : n + 64], np.arange(n, n + 64), np.zeros(64, int))
        sizes = [len(level[0]) for level in family.levels]
        assert all(a > b for a, b in zip(sizes, sizes[1:]))
    first, _ = family.repeated(4096)
    counts = Counter(keys.tolist())
    assert [f == 0 for f in first] == [counts[int(k)] > 1 for k in keys]


# ---- byte-level BPE


def test_encoding_equals_tiktoken(spark, make_docs, odd_rows):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    rows = [*odd_rows, (50, "  two  spaces\n\n\r\n<|endoftext|> don't I'LL  　 ٣٤ é́ ퟿", "q"), *[(100 + d["doc_id"], d["text"], "r") for d in small("documents")]]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in encode_documents(make_docs(rows), RANKS, public_tokenizers.PATTERN, keep_ids=True).collect())
    want = Counter()
    for i, t, _ in rows:
        ids = own.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), tuple(ids))] += 1
    assert got == want
    assert encode_documents(make_docs([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_offsets_and_split_characters():
    codec = Codec(build_model(RANKS), public_tokenizers.PATTERN)
    text = "Zoë 🙂 東京!"
    ids, offsets = codec.encode([text])[0], codec.offsets(text)
    tokens = [codec.tokens[n] for n in np.frombuffer(ids, "<u4")]
    assert b"".join(tokens) == text.encode() == codec.decode(ids)
    assert offsets[0][0] == 0 and offsets[-1][1] == len(text)
    assert all(t in text[a:b].encode() for t, (a, b) in zip(tokens, offsets))
    assert any(not _is_text(t) for t in tokens)


def _is_text(raw):
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


# ---- lines


def brute_lines(rows, percent=80):
    """(n_lines, kept text) of rows with distinct ids, in the order of ids."""
    seen, out = [], {}
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        kept = []
        for line in [] if t is None else t.split("\n"):
            own = frozenset(line.encode().lower().split())
            if not own or not any(100 * len(own & s) >= percent * len(own | s) for s in seen):
                kept.append(line)
            if own:
                seen.append(own)
        out[i] = (0 if t is None else len(t.split("\n")), None if t is None else "\n".join(kept))
    return out


def test_lines(spark, scratch, make_docs, odd_rows):
    base = words(21, 20, 10**6)
    near = [(100 + n, "common line here\n" + " ".join([*base[: 20 - n % 4], f"v{n}"]) + f"\n\nown {n} line {n * 7}", "l") for n in range(40)]
    rows = [r for n, r in enumerate(odd_rows) if r[0] != 5 or n % 2] + near
    rows = list({i: (i, t, s) for i, t, s in rows}.values())
    got = {r.row.doc_id: r for r in dedupe_lines(make_docs(rows), scratch).collect()}
    for i, (n, text) in brute_lines(rows).items():
        assert (got[i].n_lines, got[i].kept_text) == (n, text), i
    assert got[100].row.size == "x"
    assert dedupe_lines(make_docs([]), scratch).count() == 0


def test_lines_of_repeated_rows_stay_in_both(spark, scratch, make_docs):
    got = dedupe_lines(make_docs([(1, "a b c\nd", "x"), (1, "a b c\nd", "x"), (2, "a b c", "x")]), scratch).collect()
    assert sorted((r.row.doc_id, r.kept_text) for r in got) == [(1, "a b c\nd"), (1, "a b c\nd"), (2, "")]


def test_alike_lines_cost_one_comparison_each(spark, scratch, make_docs):
    base = words(21, 20, 10**6)
    rows = [(n, " ".join([*base, f"v{n}"]), "l") for n in range(40)]
    put, compared = scratch.put, []

    def counted(df, *more):
        out = put(df, *more)
        if out.columns == ["x", "y"]:
            compared.append(out.count())
        return out

    scratch.put = counted
    got = {r.row.doc_id: r.kept_text for r in dedupe_lines(make_docs(rows), scratch).collect()}
    assert got == {i: text for i, (_, text) in brute_lines(rows).items()}
    assert 0 < max(compared) <= len(rows)


def test_full_sets_tokenise_chosen_lines_only(monkeypatch):
    texts = ["", "a b\nB a c\n\nd", "\n", "e f", "g\nh h\n"]
    seen, line_words = [], lines.line_words
    monkeypatch.setattr(lines, "line_words", lambda column, rank: seen.extend(column.to_pylist()) or line_words(column, rank))
    monkeypatch.setattr(lines, "passes", lambda _, o: np.isin(o, wanted))
    wanted = lines.places(np.array([1, 1, 3, 4]), np.array([1, 2, 0, 1]))
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(np.arange(5))], names=["text", "r"])
    out = pa.Table.from_batches(lines._full_sets(SimpleNamespace(value=None))([batch])).to_pylist()
    assert seen == [b"B a c", b"", b"e f", b"h h"]
    assert [(x["r"], x["line"], len(x["words"])) for x in out] == [(1, 1, 3), (3, 0, 2), (4, 1, 1)]


def test_met_over_batches_of_any_size():
    rng = np.random.default_rng(5)
    size, word = rng.integers(1, 12, 400), rng.integers(-2, 3, 400)
    meet = np.sort((word << 32) + size)
    rows = np.zeros(400, lines._POSTING)
    rows["name"], rows["order"], rows["open"] = rng.permutation(400), rng.integers(0, 300, 400), rng.integers(0, 2, 400)
    n = meet & 0xFFFFFFFF
    i, j = (x.ravel() for x in np.meshgrid(np.arange(400), np.arange(400)))
    fits = lines.could_match(n, rows, n, rows, i, j, 80)
    want = {(rows["name"][a], rows["name"][b]) for a, b in zip(i[fits], j[fits]) if meet[a] >> 32 == meet[b] >> 32 and rows["open"][a] and rows["order"][b] <= rows["order"][a]}
    for step in (1, 7, 400):
        batches = [pa.RecordBatch.from_arrays([pa.array(meet[k : k + step]), lines._packed(rows[k : k + step], rows.itemsize)], names=["meet", "posting"]) for k in range(0, 400, step)]
        got = [(x["x"], x["y"]) for b in lines._met(80)([batches[0].slice(0, 0), *batches]) for x in b.to_pylist()]
        assert set(got) == want and len(got) == len(want) > 1000


def test_lines_on_given_table(spark, scratch):
    docs = [(d["doc_id"], d["text"]) for d in small("documents")]
    got = {r.row.doc_id: (r.n_lines, r.kept_text) for r in dedupe_lines(spark.read.parquet(f"{SMALL}/documents.parquet"), scratch).collect()}
    assert got == brute_lines(docs)


# ---- mixing


def resharing(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by sharing again and again what is above a cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_targets_equal_repeated_resharing(spark):
    import random

    draw = random.Random(2)
    for n in (1, 2, 7, 30):
        sizes = {f"s{i}": draw.choice([0, 1, 10, 1000, 10**6]) + draw.randrange(50) for i in range(n)} | ({None: 77} if n > 2 else {})
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r.source: r.target for r in source_targets(frame, (3, 1, 2), 1.5, 2.0).collect()}
        assert got.keys() == sizes.keys() and all(math.isclose(got[s], t, rel_tol=1e-9, abs_tol=1e-6) for s, t in resharing(sizes).items())


def test_mix_takes_smallest_keys(spark, scratch, make_docs, odd_rows):
    rows = [*odd_rows, *[(100 + n, " ".join(words(n, 3 + n % 40)), f"s{n % 5}") for n in range(800)], *[(2000 + n, " ".join(words(n, 30)), "big") for n in range(900)]]
    docs = make_docs(rows)
    got = plan_mix(docs, scratch).collect()
    sizes = defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(split(t))
    want = resharing(sizes)
    source = {i: s for i, _, s in rows}
    taken, largest = Counter(), Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-6) and r.taken <= 2 * r["size"]
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes if s != "b")  # b holds a repeated row
    from pyspark.sql import functions as F

    from lodestack.llm.mixing import sign_free

    keys = {r.doc_id: r.key for r in docs.select("doc_id", draw_key(F.col("doc_id"), sign_free(F.col("text")), 7).alias("key")).collect()}
    big = sorted((keys[r.doc_id], r.copies) for r in got if source[r.doc_id] == "big")
    assert [c for _, c in big] == sorted((c for _, c in big), reverse=True)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, plan_mix(docs, scratch).collect()), key=str)
    mixed = Counter(r.doc_id for r in mix_documents(docs, scratch).collect())
    copies = Counter()
    for r in got:
        copies[r.doc_id] += r.copies
    assert mixed == +copies
    assert plan_mix(make_docs([]), scratch).count() == 0 and mix_documents(make_docs([]), scratch).count() == 0


def test_sizes_agree_with_sql(spark, scratch):
    got = {r.doc_id: r["size"] for r in plan_mix(spark.read.parquet(f"{SMALL}/documents.parquet"), scratch).collect()}
    want = dict(duckdb.sql(rf"SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM '{SMALL}/documents.parquet'").fetchall())
    assert got == want
