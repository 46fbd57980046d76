"""Exact deduplication by an extendible-hash index on shared files.

The key of a text is the first 64 bits of a digest of its normal form (A-Z in lower case, null as empty). A directory of
2^depth slots, one for each prefix of that many bits, names a bucket for every slot. A bucket that holds more than its share
of texts is split by its next bit; a bucket that already has a slot of its own first makes the directory double, and the
slots of all other buckets are copied. Owner tasks hold ranges of buckets, so ranges of keys. An owner reads its texts in the order of their
keys, walks the chain of texts that share a key and compares bytes: an equal text joins the entry, another is chained.

Only texts whose key occurs more than once go to owners; a bit filter decides that where the text is read, and what passes
it by accident becomes an entry of its own. Before the exchange, each task keeps one copy of each text with the largest id
and the number of rows; texts that still come from many tasks are folded in salted groups first, so that an owner gets a few
rows of a text whatever its number of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestack.llm.filters import bit_filter, passes
from lodestack.llm.words import LOWER, byte_view, slices

#: Texts of a bucket before it is split.
CAPACITY = 4_096
#: Bits of the histogram from which buckets are split; a bucket so deep is not split further, its owner streams it all the same.
GRID = 16
#: Rows of one text that an owner may get; more are folded in salted groups of this size first.
FEW = 32
#: Bytes of texts that a task holds while it folds copies.
HELD = 32 << 20
#: The filter has 16 bits for each repeated key, and at most 2^27 (16 MB).
FILTER_BITS = (16, 27)


@dataclass
class Bucket:
    prefix: int
    depth: int
    load: int


class Directory:
    """2^depth slots; slot i holds the bucket of all keys that begin with the bits of i."""

    def __init__(self, loads: np.ndarray, capacity: int):
        """`loads`: the number of texts for each of the finest prefixes, a power of two of them."""
        self.finest = (len(loads) - 1).bit_length()
        self.sums = np.concatenate([[0], np.cumsum(loads)])
        self.depth = 0
        self.slots = [self.bucket(0, 0)]
        overfull = list(self.slots)
        while overfull:
            bucket = overfull.pop()
            if bucket.load > capacity and bucket.depth < self.finest:
                overfull += self.split(bucket)

    def bucket(self, prefix: int, depth: int) -> Bucket:
        width = self.finest - depth
        return Bucket(prefix, depth, int(self.sums[prefix + 1 << width] - self.sums[prefix << width]))

    def split(self, bucket: Bucket) -> list[Bucket]:
        if bucket.depth == self.depth:
            self.slots = [b for b in self.slots for _ in range(2)]
            self.depth += 1
        halves = [self.bucket(2 * bucket.prefix + bit, bucket.depth + 1) for bit in (0, 1)]
        for half in halves:
            width = self.depth - half.depth
            self.slots[half.prefix << width : half.prefix + 1 << width] = [half] * (1 << width)
        return halves

    def rows(self, owners: int) -> list[tuple[int, int, int, int]]:
        """(slot, first slot of its bucket, depth of the bucket, owner); owners hold neighbouring buckets of about equal load."""
        total, before, out = int(self.sums[-1]), 0, []
        for slot, bucket in enumerate(self.slots):
            first = bucket.prefix << self.depth - bucket.depth
            out.append((slot, first, bucket.depth, min(owners - 1, before * owners // max(1, total))))
            if slot + 1 == first + (1 << self.depth - bucket.depth):
                before += bucket.load
        return out


def _digests(column: pa.Array, key_bits: int) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """(normalised texts, their digests, their keys)."""
    data, offsets = byte_view(column)
    data = LOWER[data].tobytes()
    texts = [data[a:z] for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    digests = [hashlib.sha256(t).digest() for t in texts]
    keys = np.array([int.from_bytes(d[:8], "big", signed=True) for d in digests], np.int64)
    return texts, digests, keys >> 64 - key_bits << 64 - key_bits


class _Chains:
    """Texts by key, equal ones by comparing bytes, with their rows' largest id (null: smallest), number, and number with that id."""

    def __init__(self):
        self.chains: dict[int, list[list]] = {}
        self.size = 0

    def add(self, key: int, text: bytes, digest: bytes, best, n: int = 1, ties: int = 1) -> None:
        chain = self.chains.setdefault(key, [])
        for entry in chain:
            if entry[0] == text:
                if entry[2] == best:
                    entry[4] += ties
                elif entry[2] is None or (best is not None and best > entry[2]):
                    entry[2], entry[4] = best, ties
                entry[3] += n
                return
        chain.append([text, digest, best, n, ties])
        self.size += len(text) + 256

    def take(self) -> list[tuple]:
        """(key, place in the chain, text, digest, best, n, ties), and none is held any more."""
        out = [(key, place, *entry) for key, chain in self.chains.items() for place, entry in enumerate(chain)]
        self.chains, self.size = {}, 0
        return out


def _texts(rows: list[tuple], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Folded texts as batches of a few MB."""
    start = size = 0
    for i, row in enumerate(rows):
        size += len(row[2])
        if size > 8 << 20 or i + 1 == len(rows):
            part = list(zip(*rows[start : i + 1]))
            yield pa.record_batch([pa.array(part[0], pa.int64()), pa.array(part[3], pa.binary()), pa.array(part[2], pa.binary()), pa.array(part[4], id_type), pa.array(part[5], pa.int64()), pa.array(part[6], pa.int64())], ["key", "digest", "text", "best", "n", "ties"])
            start, size = i + 1, 0


def _hash(key_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, digests, keys = _digests(batch.column(1), key_bits)
            yield pa.record_batch([batch.column(0), pa.array(keys), pa.array(digests, pa.binary())], ["doc_id", "key", "digest"])

    return run


def _fold(repeated, key_bits: int, id_type: pa.DataType):
    """The texts whose key passes the filter, equal ones of the task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Chains()
        for batch in slices(batches, "text"):
            texts, digests, keys = _digests(batch.column(1), key_bits)
            ids = batch.column(0).to_pylist()
            for i in np.flatnonzero(passes(repeated.value, keys)).tolist():
                held.add(int(keys[i]), texts[i], digests[i], ids[i])
            if held.size > HELD:
                yield from _texts(held.take(), id_type)
        yield from _texts(held.take(), id_type)

    return run


def _runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[tuple, _Chains]]:
    """The chains of each run of rows that agree in `by`; only one run is held at a time."""
    now, held = None, _Chains()
    for batch in slices(batches, "text"):
        runs = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in by)))
        rows = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "text", "digest", "best", "n", "ties")))
        for run, row in zip(runs, rows):
            if run != now:
                if now is not None:
                    yield now, held
                now, held = run, _Chains()
            held.add(*row)
    if now is not None:
        yield now, held


def _refold(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _runs(batches, ("key", "digest", "salt")):
            yield from _texts(held.take(), id_type)

    return run


def _own(id_type: pa.DataType):
    """What the owner of a range of buckets stores: one entry for each text."""
    names = ["bucket", "depth", "key", "place", "digest", "keep_id", "group_size", "ties"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), id_type, pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (bucket, depth, _), held in _runs(batches, ("bucket", "depth", "key")):
            out += [(bucket, depth, key, place, digest, best, n, ties) for key, place, _, digest, best, n, ties in held.take()]
            if len(out) >= 8_192:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


@dataclass
class Index:
    """On shared files: every row's key and digest; the directory; the entries of all texts whose key occurs more than once."""

    rows: DataFrame
    directory: DataFrame
    depth: int
    entries: DataFrame


def build_index(docs: DataFrame, scratch, doc_id: str = "doc_id", text: str = "text", key_bits: int = 64, capacity: int = CAPACITY, few: int = FEW) -> Index:
    """`key_bits` below 64 makes different texts share keys, which costs chain steps and changes no group."""
    spark = docs.sparkSession
    id_spark = docs.schema[doc_id].dataType
    id_type, id_name = to_arrow_type(id_spark), id_spark.simpleString()
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    hashed = given.mapInArrow(_hash(key_bits), f"doc_id {id_name}, key bigint, digest binary")
    rows = scratch.put(hashed.withColumn("row", F.monotonically_increasing_id()))

    repeated = scratch.put(rows.groupBy("key").count().where("count > 1").select("key"))
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * repeated.count()).bit_length()))
    known = spark.sparkContext.broadcast(bit_filter(repeated, F.col("key"), bits))
    shape = f"key bigint, digest binary, text binary, best {id_name}, n bigint, ties bigint"
    texts = scratch.put(given.mapInArrow(_fold(known, key_bits, id_type), shape))
    parts = [texts]
    while True:
        many = scratch.put(parts[-1].groupBy("key", "digest").agg(F.ceil(F.count("*") / few).alias("groups")).where(F.col("groups") > 1))
        if many.isEmpty():
            break
        rest, hot = parts[-1].join(many, ["key", "digest"], "left_anti"), parts[-1].join(many, ["key", "digest"])
        salted = hot.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("groups"))).drop("groups")
        dealt = salted.repartition("key", "digest", "salt").sortWithinPartitions("key", "digest", "salt")
        parts[-1:] = [rest, scratch.put(dealt.mapInArrow(_refold(id_type), shape))]
    folded = parts[0]
    for more in parts[1:]:
        folded = folded.unionByName(more)

    cells = folded.groupBy(F.shiftrightunsigned("key", 64 - GRID).cast("int").alias("cell")).count().toArrow()  # at most 2^GRID rows
    loads = np.zeros(1 << GRID, np.int64)
    loads[cells["cell"].to_numpy()] = cells["count"].to_numpy()
    directory = Directory(loads, capacity)
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = scratch.put(spark.createDataFrame(directory.rows(owners), "slot int, bucket int, depth int, owner int"))  # at most 2^GRID rows
    slot = F.shiftrightunsigned("key", 64 - directory.depth).cast("int") if directory.depth else F.lit(0)
    owned = folded.withColumn("slot", slot).join(F.broadcast(slots), "slot").drop("slot")
    dealt = owned.repartitionById(owners, "owner").sortWithinPartitions("bucket", "key", "digest")
    stored = f"bucket int, depth int, key bigint, place int, digest binary, keep_id {id_name}, group_size bigint, ties bigint"
    entries = scratch.put(dealt.mapInArrow(_own(id_type), stored))
    known.unpersist()
    return Index(rows, slots, directory.depth, entries)


def exact_duplicates(docs: DataFrame, scratch, doc_id: str = "doc_id", text: str = "text", **index) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, place (of its text in the key's chain).

    Equal are texts whose bytes agree after lower-casing A-Z; null counts as empty, so null and empty texts form one group.
    Of a group the row with the largest id stays; a null id is smaller than any other, and a group of null ids has keep_id
    null. Of rows that repeat both text and id exactly one stays. Rows find their entry by key and the digest returned. An empty table
    gives no rows; other columns are not looked at.
    """
    found = build_index(docs, scratch, doc_id, text, **index)
    groups = found.entries.where("group_size > 1 or place > 0").select("key", "digest", "place", "keep_id", "group_size", "ties")
    tied = groups.where("ties > 1")
    if tied.isEmpty():
        groups = groups.withColumn("first", F.lit(None).cast("long"))
    else:
        mine = found.rows.join(tied.select("key", "digest", "keep_id"), ["key", "digest"]).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        groups = scratch.put(groups.join(mine.groupBy("key", "digest").agg(F.min("row").alias("first")), ["key", "digest"], "left"))
    joined = found.rows.join(groups, ["key", "digest"], "left")
    alone = F.col("group_size").isNull()
    stays = alone | F.when(F.col("first").isNotNull(), F.col("row") == F.col("first")).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.coalesce("place", F.lit(0)).alias("place"),
    )
