"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct shingles of five lower-cased words. Of 128 minima per set, groups of four make 32 band
keys, and the two low bits of each minimum are packed into 256 bits. Sets that share a band key are candidates; the number
of agreeing two-bit fields estimates their similarity, corrected for the quarter that agree by chance. What passes, with a
margin of more than five standard errors below the threshold, and is not ruled out by a sketch that bounds how much two sets
differ, is confirmed on the full sets. At a similarity of 0.75 a pair shares no band with a chance of about 5e-6.

Copies are folded before anything else, so a set is handled once however often it occurs. Pairs of a band are not all
formed: in each of a few rounds every member meets one drawn member of another component, and confirmed links join
components; then members of bands that still hold several components are all compared across components, behind the
bit-count test inside the join. Rounds only spare comparisons, so their number does not change the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.components import components
from lodestack.llm.filters import bit_filter, passes
from lodestack.llm.words import mixed, slices, word_hashes

SHINGLE = 5
MINIMA = 128
BAND = 4
BITS = 2
#: Candidates whose estimate is below go; the estimate's standard error is 0.046 at 0.75.
ESTIMATE = 0.5
#: Bits of a sketch in which each shingle turns one bit: two sets differ in at least as many shingles as their sketches in bits.
PARITY = 1024
#: Most rounds of drawn partners, and the number of links under which no further round is worth its jobs.
STARS = 5
FEW = 200
#: Size of the filter that keeps texts without candidates out of the exchange.
FILTER_BITS = 22

_U = np.uint64
_FACTORS = mixed(np.arange(101, 101 + SHINGLE, dtype=_U)) | _U(1)
_A = (mixed(np.arange(1000, 1000 + MINIMA, dtype=_U)) >> _U(32)).astype(np.uint32) | np.uint32(1)
_B = (mixed(np.arange(5000, 5000 + MINIMA, dtype=_U)) >> _U(32)).astype(np.uint32)
_BANDS = mixed(np.arange(9000, 9000 + BAND, dtype=_U)) | _U(1)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts one after another, index of each text's first with a closing one)."""
    words, first = word_hashes(column)
    count = np.diff(first)
    taken = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(taken)])
    padded = np.concatenate([words, np.zeros(SHINGLE, _U)])
    sums = np.zeros(len(words), _U)
    for k in range(SHINGLE):
        sums += padded[k : k + len(words)] * _FACTORS[k]
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], taken) + np.repeat(first[:-1], taken)
    shingles = sums[at]
    for d in np.flatnonzero((count > 0) & (count < SHINGLE)):  # the whole sequence, told apart by its length
        own = words[first[d] : first[d + 1]]
        shingles[begin[d]] = (own * _FACTORS[: len(own)]).sum(dtype=_U) + _U(len(own))
    shingles = mixed(shingles)
    for d in range(len(taken)):
        shingles[begin[d] : begin[d + 1]].sort()
    new = np.ones(len(shingles), bool)
    new[1:] = shingles[1:] != shingles[:-1]
    new[begin[:-1][taken > 0]] = True
    return shingles[new], np.concatenate([[0], np.cumsum(new)])[begin]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        sets, first = shingle_sets(batch.column(1))
        size = np.diff(first)
        full = np.flatnonzero(size)
        packed = np.zeros((len(size), MINIMA * BITS // 64), _U)
        keys = np.zeros((len(size), MINIMA // BAND), _U)
        names = np.zeros((len(size), 2), _U)
        parity = np.zeros((len(size), PARITY // 64), _U)
        if len(full):
            starts = first[:-1][full]
            high = (sets >> _U(32)).astype(np.uint32)
            for i in range(MINIMA):
                least = np.minimum.reduceat(high * _A[i] + _B[i], starts).astype(_U)
                packed[full, i * BITS // 64] |= (least & _U(3)) << _U(i * BITS % 64)
                keys[full, i // BAND] += least * _BANDS[i % BAND]
            keys[full] = mixed(keys[full] + np.arange(keys.shape[1], dtype=_U) * _U(0x9E3779B97F4A7C15))
            turned = np.bincount(np.repeat(np.arange(len(size)), size) * PARITY + (sets >> _U(8) & _U(PARITY - 1)).astype(np.int64), minlength=len(size) * PARITY)
            parity = np.packbits((turned & 1).astype(np.uint8).reshape(-1, 64), axis=1).view(_U).reshape(len(size), -1)
            names[full, 0] = np.add.reduceat(sets, starts)
            names[full, 1] = np.add.reduceat(mixed(sets ^ _U(0x5851F42D4C957F2D)), starts)

        def lists(x: np.ndarray) -> pa.Array:
            flat = pa.array(x.astype(np.int64, copy=False).ravel() if x.dtype == np.int64 else x.ravel().view(np.int64), pa.int64())
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)

        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), lists(names), lists(packed), lists(keys), lists(parity)], names=["doc_id", "n_shingles", "name", "bits", "bands", "parity"]
        )


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, name (128 bits that stand for the set), bits (packed signature), bands (keys), parity."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles bigint, name array<bigint>, bits array<bigint>, bands array<bigint>, parity array<bigint>"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_signatures, schema)


def estimate(a: F.Column, b: F.Column) -> F.Column:
    """The similarity that two packed signatures show: (agreeing share - chance) / (1 - chance)."""
    differ = F.lit(0)
    for i in range(MINIMA * BITS // 64):
        x = a[i].bitwiseXOR(b[i])
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 0.5**BITS
    return (1 - differ / F.lit(float(MINIMA)) - chance) / (1 - chance)


def _differ_little(n_a: F.Column, n_b: F.Column, a: F.Column, b: F.Column) -> F.Column:
    """False only where the sketches prove that the sets differ in over a seventh of both sizes, and so cannot be linked."""
    bits = F.lit(0)
    for i in range(PARITY // 64):
        bits = bits + F.bit_count(a[i].bitwiseXOR(b[i]))
    return bits * 7 <= n_a + n_b


def _sizes_fit(a: F.Column, b: F.Column) -> F.Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * 75


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(slices(batches, "text_a", 1 << 20), "text_b", 1 << 20):
        (x, fx), (y, fy) = shingle_sets(batch.column(2)), shingle_sets(batch.column(3))
        keep = []
        for i in range(batch.num_rows):
            own, other = x[fx[i] : fx[i + 1]], y[fy[i] : fy[i + 1]]
            at = np.minimum(np.searchsorted(other, own), max(len(other) - 1, 0))
            common = int((other[at] == own).sum()) if len(other) else 0
            keep.append(100 * common >= 75 * (len(own) + len(other) - common) and common > 0)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _texts_of(docs: DataFrame, ids: DataFrame, scratch) -> DataFrame:
    """The rows of docs (doc_id, text) whose id is in ids (id), and a few more that a bit filter lets through."""
    shipped = docs.sparkSession.sparkContext.broadcast(bit_filter(ids, F.xxhash64("id"), FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["doc_id", "text"]).filter(pa.array(passes(shipped.value, np.array(batch.column(2), np.int64))))

    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("hash"))
    return scratch.put(seen.mapInArrow(run, f"doc_id {kind}, text string"))


def _confirmed(pairs: DataFrame, texts: DataFrame, kind: str) -> DataFrame:
    """The pairs (a, b) whose full sets agree by three quarters."""
    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return with_b.mapInArrow(_verify, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Two rows are linked when their sets have 100 * intersection >= 75 * union. Null and empty texts, and texts of
    separators only, have the empty set and are linked with nothing. Of a text with fewer than five words the whole sequence
    is the one shingle. Rows that repeat an id are each judged by their own text. A row with a null id is linked with nothing
    and kept; its component is null. An empty table gives no rows; other columns are not looked at.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = scratch.put(signatures(docs))
    folded = signed.where("n_shingles > 0 and doc_id is not null").groupBy("name").agg(F.min(F.struct("doc_id", "n_shingles", "bits", "bands", "parity")).alias("s"))
    sets = scratch.put(folded.select("name", F.col("s.doc_id").alias("id"), F.col("s.n_shingles").alias("n"), "s.bits", "s.bands", "s.parity"))

    postings = sets.select("id", F.explode("bands").alias("key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    posted = scratch.put(postings.join(scratch.put(shared), "key"))
    labels = scratch.put(posted.select("id").distinct().withColumn("c", F.col("id")))
    texts = _texts_of(docs, labels.select("id"), scratch)

    one = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"), F.col("parity").alias("parity_a"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"), F.col("parity").alias("parity_b"))
    likely = _sizes_fit(F.col("n_a"), F.col("n_b")) & (estimate(F.col("bits_a"), F.col("bits_b")) >= ESTIMATE)
    likely = likely & _differ_little(F.col("n_a"), F.col("n_b"), F.col("parity_a"), F.col("parity_b"))

    def open_members() -> DataFrame:
        """(key, id, c) of the bands that hold several components."""
        named = posted.join(labels, "id")
        several = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
        return scratch.put(named.join(scratch.put(several), "key").select("key", "id", "c"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        met = pairs.distinct().join(one, "a").join(two, "b").where(likely).select("a", "b")
        return scratch.put(_confirmed(scratch.put(met), texts, kind))

    def joined(links: DataFrame) -> DataFrame:
        """The labels once components that a link connects are one."""
        ends = links.join(labels, links["a"] == labels["id"]).select(F.col("c").alias("a"), "b")
        ends = ends.join(labels, ends["b"] == labels["id"]).select("a", F.col("c").alias("b"))
        merged = components(ends, scratch).select(F.col("node").alias("c"), F.col("component").alias("top"))
        return scratch.put(labels.join(merged, "c", "left").select("id", F.coalesce("top", "c").alias("c")))

    members = open_members()
    for n in range(STARS):
        drawn = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "id", F.lit(n)).alias("draw"), "id", "c")).alias("s"))
        drawn = scratch.put(drawn.select("key", F.col("s.id").alias("b"), F.col("s.c").alias("other")))
        links = confirmed(members.join(drawn, "key").where("c <> other").select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")))
        scratch.drop(members)
        labels = joined(links)
        members = open_members()
        if links.count() < FEW:
            break

    rest = members.join(sets.select("id", "n", "bits", "parity"), "id")
    left = rest.select("key", F.col("id").alias("a"), F.col("c").alias("c_a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"), F.col("parity").alias("parity_a"))
    right = rest.select("key", F.col("id").alias("b"), F.col("c").alias("c_b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"), F.col("parity").alias("parity_b"))
    crossing = left.join(right, (left["key"] == right["key"]) & (F.col("c_a") < F.col("c_b")) & likely).select("a", "b").distinct()
    labels = joined(scratch.put(_confirmed(scratch.put(crossing), texts, kind)))

    found = sets.select("name", "id").join(labels, "id", "left")
    labels = scratch.put(found.select("name", F.coalesce("c", "id").alias("component_id")))
    scratch.drop(posted, texts, members)
    slim = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("name")).alias("name"))
    return slim.join(labels, "name", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
