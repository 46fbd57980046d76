"""Exact removal of repeated passages: a logarithmic family of suffix arrays over anchored suffixes.

Every window of `LENGTH` bytes has an anchor: the leftmost of its `ANCHOR`-byte strings with the smallest hash. Equal
windows have equal anchors at equal places, and neighbouring windows mostly share theirs, so a text falls into runs of
windows with one anchor, about one run for fifty bytes. Runs are counted by (anchor, run) hashes with partial sums, which
collapses copies and common passages on the way. A run that occurs twice is repeated as a whole; an anchor that occurs once
has no repeated window. What is left are runs whose anchor occurs elsewhere in another run: only their bytes move.

Those meet by anchor. Each arriving batch of runs gets a suffix array of its window starts, ordered by a hash of the
window's bytes; it is merge-scanned against the existing levels, matches are marked on both sides, and levels of about the
same size are merged, so a level is touched a logarithmic number of times. Anchors with more than `WIDE` different runs
do not meet in one task: their windows are counted by hash, each on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.filters import bit_filter, passes
from lodestack.llm.words import _VALUES, BLOCK, byte_view, mixed, powers, slices

LENGTH = 200
ANCHOR = 100
WIDE = 20_000
FILTER_BITS = 24

_U = np.uint64
_LOW = _U((1 << 21) - 1)
_RUN = _U(0xD6E8FEB86659FD93)


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of byte values times powers, and the inverse powers: the hash of any span in two look-ups."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return sums, down


def _runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(segment, lo, hi, anchor hash, run hash) of the runs of window starts lo to hi, counted from the segment's start.

    Segments follow each other in `data`, which is shorter than 2^21 bytes.
    """
    if len(data) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    sums, down = _sums(data)
    grams = (sums[ANCHOR:] - sums[:-ANCHOR]) * down[: len(data) - ANCHOR + 1] * _U(0x9E3779B97F4A7C15)
    width = LENGTH - ANCHOR + 1
    keys = np.full(-(-len(grams) // width) * width, np.iinfo(np.uint64).max, _U)
    keys[: len(grams)] = grams & ~_LOW | np.arange(len(grams), dtype=_U)
    blocks = keys.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(data) - LENGTH + 1
    at = (np.minimum(after[:count], before[width - 1 : width - 1 + count]) & _LOW).astype(np.int64)
    marks = np.zeros(len(data) + 2, np.int32)
    np.add.at(marks, np.maximum(ends - LENGTH + 1, starts), 1)
    np.add.at(marks, ends, -1)
    owned = np.cumsum(marks[:count]) == 0
    turn = np.ones(count + 1, bool)
    turn[1:-1] = (at[1:] != at[:-1]) | (owned[1:] != owned[:-1])
    edges = np.flatnonzero(turn)
    lo, hi = edges[:-1][owned[edges[:-1]]], (edges[1:] - 1)[owned[edges[:-1]]]
    segment = np.searchsorted(starts, lo, "right") - 1
    runs = (sums[hi + LENGTH] - sums[lo]) * down[lo] + (hi - lo).astype(_U) * _RUN
    return segment, lo - starts[segment], hi - starts[segment], mixed(grams[at[lo]]), mixed(runs)


def runs_of(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, lo, hi, anchor hash, run hash) of all texts; one longer than `BLOCK` is cut into overlapping segments."""
    data, offsets = byte_view(column)
    if len(data) <= BLOCK + LENGTH:
        return _runs(data, offsets[:-1], offsets[1:])
    parts = []
    for row in range(len(offsets) - 1):
        for low in range(offsets[row], offsets[row + 1], BLOCK):
            piece = data[low : min(low + BLOCK + LENGTH - 1, offsets[row + 1])]
            _, lo, hi, h, c = _runs(piece, np.array([0]), np.array([len(piece)]))
            shift = low - offsets[row]
            parts.append((np.full(len(lo), row), lo + shift, hi + shift, h, c))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _names(rows: np.ndarray, lo: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A 64-bit name of a run within its row."""
    return mixed(mixed(rows.view(_U)) + lo.astype(_U) * _RUN ^ c)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", BLOCK):
        yield pa.RecordBatch.from_arrays([_long(runs_of(batch.column(0))[3])], names=["h"])


def _located(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK):
            row, lo, hi, h, c = (x for x in runs_of(batch.column(0)))
            keep = passes(shipped.value, h)
            row, lo, hi, h, c = row[keep], lo[keep], hi[keep], h[keep], c[keep]
            r = np.array(batch.column(1), np.int64)[row]
            yield pa.RecordBatch.from_arrays([_long(_names(r, lo, c)), _long(h), _long(c), _long(r), _long(lo), _long(hi)], names=["u", "h", "c", "r", "lo", "hi"])

    return run


def _bytes_of_runs(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, wanted = shipped.value
        for batch in slices(batches, "text", BLOCK):
            row, lo, hi, h, c = runs_of(batch.column(0))
            keep = np.flatnonzero(passes(anchors, h))
            u = _names(np.array(batch.column(1), np.int64)[row[keep]], lo[keep], c[keep])
            chosen = passes(wanted, u)
            keep, u = keep[chosen], u[chosen]
            data, offsets = byte_view(batch.column(0))
            begin = offsets[row[keep]] + lo[keep]
            raw = [data[b : b + n].tobytes() for b, n in zip(begin, hi[keep] - lo[keep] + LENGTH)]
            yield pa.RecordBatch.from_arrays([_long(u), pa.array(raw, pa.binary())], names=["u", "bytes"])

    return run


def _windows(column: pa.Array, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, owner, offset) of every window of every run; the anchor salts the hash."""
    data, offsets = byte_view(column)
    sums, down = _sums(data)
    counts = np.diff(offsets) - LENGTH + 1
    owner = np.repeat(np.arange(len(counts)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = offsets[owner] + offset
    return mixed((sums[at + LENGTH] - sums[at]) * down[at] ^ salt[owner]), owner, offset


class SuffixFamily:
    """Suffix arrays of window starts: one per level, levels merged when the newer is as large as the older."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []  # hash in order, owner, offset, repeated

    def add(self, keys: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        batch = [keys[order], owner[order], offset[order], np.zeros(len(keys), bool)]
        self._mark_neighbours(batch)
        for level in self.levels:
            self._merge_scan(batch, level)
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            last, older = self.levels.pop(), self.levels.pop()
            joined = [np.concatenate(x) for x in zip(older, last)]
            order = np.argsort(joined[0], kind="stable")  # two runs in order: one merge
            self.levels.append([x[order] for x in joined])

    @staticmethod
    def _mark_neighbours(batch: list[np.ndarray]) -> None:
        same = batch[0][1:] == batch[0][:-1]
        batch[3][1:] |= same
        batch[3][:-1] |= same

    @staticmethod
    def _merge_scan(batch: list[np.ndarray], level: list[np.ndarray]) -> None:
        at = np.minimum(np.searchsorted(level[0], batch[0]), len(level[0]) - 1)
        met = level[0][at] == batch[0]
        batch[3] |= met
        level[3][at[met]] = True  # of equal ones in a level, all but a lone one are marked already

    def repeated(self, owners: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) repeated window of each owner; first is past last where there is none."""
        first, last = np.full(owners, np.iinfo(np.int64).max), np.full(owners, -1)
        for _, owner, offset, mark in self.levels:
            np.minimum.at(first, owner[mark], offset[mark])
            np.maximum.at(last, owner[mark], offset[mark])
        return first, last


def _family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    family, names, count = SuffixFamily(), [], 0
    for batch in slices(batches, "bytes", BLOCK):
        if batch.num_rows:
            keys, owner, offset = _windows(batch.column(2), np.array(batch.column(1), np.int64).view(_U))
            family.add(keys, owner + count, offset)
            names.append(np.array(batch.column(0), np.int64))
            count += batch.num_rows
    if count:
        first, last = family.repeated(count)
        found = last >= 0
        yield pa.RecordBatch.from_arrays([_long(np.concatenate(names)[found]), _long(first[found]), _long(last[found])], names=["u", "first", "last"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "bytes", BLOCK // 8):
        if batch.num_rows:
            keys, owner, offset = _windows(batch.column(2), np.array(batch.column(1), np.int64).view(_U))
            yield pa.RecordBatch.from_arrays([_long(keys), _long(np.array(batch.column(0), np.int64)[owner]), _long(offset)], names=["k", "u", "o"])


def repeated_spans(texts: DataFrame, scratch) -> DataFrame:
    """(r, start, end): byte spans covered by repeated windows, overlapping ones not yet merged; texts has text and r."""
    context = texts.sparkSession.sparkContext
    anchors = texts.select("text").mapInArrow(_anchors, "h bigint").groupBy("h").agg(F.count("*").alias("t")).where("t > 1")
    anchor_filter = bit_filter(anchors, F.col("h"), FILTER_BITS)
    located = scratch.put(texts.select("text", "r").mapInArrow(_located(context.broadcast(anchor_filter)), "u bigint, h bigint, c bigint, r bigint, lo bigint, hi bigint"))
    counted = scratch.put(located.groupBy("h", "c").agg(F.count("*").alias("n"), F.min("u").alias("u")))
    several = scratch.put(counted.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"))
    open_runs = scratch.put(counted.join(several, "h").select("u", "h", "m"))
    wanted = bit_filter(open_runs, F.col("u"), FILTER_BITS)
    read = texts.select("text", "r").mapInArrow(_bytes_of_runs(context.broadcast((anchor_filter, wanted))), "u bigint, bytes binary")
    runs = scratch.put(read.join(open_runs, "u").select("u", "h", "bytes", "m"))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = runs.where(F.col("m") <= WIDE).select("u", "h", "bytes").repartition(parts, "h").mapInArrow(_family, "u bigint, first bigint, last bigint")
    windows = runs.where(F.col("m") > WIDE).select("u", "h", "bytes").mapInArrow(_exploded, "k bigint, u bigint, o bigint")
    twice = windows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    wide = windows.join(twice, "k").groupBy("u").agg(F.min("o").alias("first"), F.max("o").alias("last"))
    found = scratch.put(narrow.unionByName(wide).groupBy("u").agg(F.min("first").alias("first"), F.max("last").alias("last")))
    whole = located.join(counted.where("n > 1").select("h", "c"), ["h", "c"]).select("r", F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("end"))
    partly = located.join(found, "u").select("r", (F.col("lo") + F.col("first")).alias("start"), (F.col("lo") + F.col("last") + LENGTH).alias("end"))
    return whole.unionByName(partly)


def _merged(spans: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK):
            data, offsets = byte_view(batch.column(1))
            rows = []
            for i, spans in enumerate(batch.column(2).to_pylist()):
                raw, merged = data[offsets[i] : offsets[i + 1]].tobytes(), _merged(spans)
                kept, at = [], 0
                for start, end in merged:
                    kept.append(raw[at:start])
                    at = end
                kept = b"".join([*kept, raw[at:]])
                rows.append((len(raw), sum(e - s for s, e in merged), len(merged), hashlib.sha256(kept).hexdigest(), kept if keep_text else None, [{"start": s, "end": e} for s, e in merged]))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    return run


def remove_repeats(docs: DataFrame, scratch, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, and with `keep_text` the bytes `kept`.

    Removed is each byte within a string of 200 bytes that starts at another place too, in the same or another row. Null
    and empty texts have no bytes and the digest of nothing; texts under 200 bytes stay whole. Repeated rows count as places
    of their own, so long enough ones are removed entirely. What is left may end within a character, hence bytes. Null ids
    are fine, an empty table gives no rows, other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id), F.col(text)).alias("r"))
    spans = scratch.put(repeated_spans(rows.where("text is not null").select("text", "r"), scratch).groupBy("r").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    shipped = docs.sparkSession.sparkContext.broadcast(bit_filter(spans, F.col("r"), 22))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            maybe = pa.array(passes(shipped.value, np.array(batch.column(2), np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, maybe], names=["doc_id", "text", "r", "maybe"])

    kind = docs.schema[doc_id].dataType.simpleString()
    out = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, spans array<struct<start:bigint,end:bigint>>"
    touched = rows.mapInArrow(split, f"doc_id {kind}, text string, r bigint, maybe boolean")
    cut = touched.where("maybe").drop("maybe").join(spans, "r", "left").select("doc_id", "text", "spans").mapInArrow(_cut(keep_text), out)
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rest = touched.where("not maybe").select(
        "doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"),
        (raw if keep_text else F.lit(None).cast("binary")).alias("kept"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
    )
    both = cut.unionByName(rest)
    return both if keep_text else both.drop("kept")
