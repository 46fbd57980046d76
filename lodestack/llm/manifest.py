"""A Merkle manifest of a table: digest-to-children records, and proofs found by descending them from the root.

Rows of a source are leaves in the order of their ids. Runs of sixteen neighbours become a parent until one node is left,
the source's subroot; the subroots, in the order of the sources, become the root in the same way. Every parent is stored as
a record (digest, children), where children is one binary of 32 bytes a child, so equal nodes need one record.

A request names a leaf by its rank. Its hexadecimal digits say which child to take at each record below the subroot, and
the digits of the source's own place do so above it. Requests that still share all digits travel as one row, so a level of
the descent joins about a sixteenth of the rows of the level below it. Each step appends the children that were not taken;
at the end the segments are reversed, from leaf to root.

Ranks come from a range sort: a row's seat in its partition, plus the rows of its source in earlier partitions. A source
that holds most of the table is spread over many partitions, and no window covers more than one row for each of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 4
FAN = 1 << BITS
WIDTH = 32
PATH = "array<struct<before:binary,after:binary>>"


def hexed(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def framed(value: Column) -> Column:
    """`-` for null, else the value's length in UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def in_order(df: DataFrame, scratch, *by: str) -> DataFrame:
    """The rows, written in sorted order, with `part` (number of a range) and `seat` (place in it, from 0).

    A running number parts equal rows, so that even they spread over ranges.
    """
    numbered = df.withColumn("spread", F.monotonically_increasing_id())
    sorted_rows = numbered.repartitionByRange(*by, "spread").sortWithinPartitions(*by, "spread").drop("spread")
    place = F.monotonically_increasing_id()
    return scratch.put(sorted_rows.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("seat")))


def _before(*by: str):
    return Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def build(leaves: DataFrame, most: int, scratch) -> list[DataFrame]:
    """(tree, n, node, digest) of leaves, n of them in a tree, to one table for each height above them: (tree, n, node, digest, children)."""
    levels, below = [], leaves
    while FAN ** len(levels) < most:
        runs = below.where(F.col("n") > FAN ** len(levels)).groupBy("tree", "n", F.shiftright("node", BITS).alias("run"))
        children = F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))), lambda c: F.hex(c["digest"])), ""))
        parents = runs.agg(children.alias("children")).select("tree", "n", F.col("run").alias("node"), digest(hexed(F.col("children"))).alias("digest"), "children")
        below = scratch.put(parents)
        levels.append(below)
    return levels


def tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, n, digest): the one node left of each tree."""
    every = [level.select("tree", "n", "digest").where((F.col("n") <= FAN**h) & (F.col("n") > (FAN ** (h - 1) if h else 0))) for h, level in enumerate([leaves, *levels])]
    out = every[0]
    for more in every[1:]:
        out = out.union(more)
    return out


def descend(roots: DataFrame, levels: list[DataFrame], requests: DataFrame, scratch) -> DataFrame:
    """The requests (tree, n, node, any other columns) with `digest`, `top` and `path`, its segments from the tree's top down.

    `roots` are (tree, n, digest, path); a path may already hold segments from above.
    """
    wanted = [requests]
    for h in range(1, len(levels)):
        wanted.append(wanted[-1].where(F.col("n") > FAN**h).select("tree", "n", F.shiftright("node", BITS).alias("node")).distinct())
    roots = roots.withColumn("top", F.col("digest"))

    def at(h: int) -> DataFrame:
        """The roots of the trees that are h high."""
        return roots.where((F.col("n") <= FAN**h) & (F.col("n") > (FAN ** (h - 1) if h else 0)))

    shape = ["tree", "node", "digest", "top", "path"]
    frontier = at(len(levels)).withColumn("node", F.lit(0).cast("long")).select(shape)
    found = None
    for h in range(len(levels), 0, -1):
        records = levels[h - 1].select("digest", "children").dropDuplicates(["digest"])
        opened = frontier.join(records, "digest").select(F.col("tree").alias("in_tree"), F.col("node").alias("in_node"), "top", "path", "children")
        asked = wanted[h - 1].where(F.col("n") > FAN ** (h - 1))
        met = asked.join(opened, (F.col("tree") == F.col("in_tree")) & (F.shiftright("node", BITS) == F.col("in_node")))
        start = (F.col("node").bitwiseAND(F.lit(FAN - 1)) * WIDTH).cast("int")

        def cut(begin: Column, length: Column) -> Column:
            return F.substring(F.col("children"), begin, length)

        step = F.struct(cut(F.lit(1), start).alias("before"), cut(start + WIDTH + 1, F.lit(FAN * WIDTH)).alias("after"))
        met = met.withColumn("digest", cut(start + 1, F.lit(WIDTH))).withColumn("path", F.concat("path", F.array(step))).drop("in_tree", "in_node", "children")
        if h > 1:
            frontier = scratch.put(met.select(shape).union(at(h - 1).withColumn("node", F.lit(0).cast("long")).select(shape)))
        else:
            found = met
    lone = requests.where("n = 1").join(at(0).select(F.col("tree").alias("in_tree"), "digest", "top", "path"), F.col("tree") == F.col("in_tree")).drop("in_tree")
    return lone if found is None else found.unionByName(lone)


@dataclass
class Manifest:
    """What is stored: the leaves by rank, the records by height below and above the subroots, and the root's digest (null of an empty table)."""

    leaves: DataFrame
    levels: list[DataFrame]
    upper: list[DataFrame]
    sources: DataFrame
    root: bytes | None


def write_manifest(docs: DataFrame, scratch, columns: tuple[str, ...], source: str, key: str, also: dict[str, Column] | None = None) -> Manifest:
    """Leaves are digests of the framed `columns`, grouped by `source` and ordered by `key`, nulls first, equal keys by digest.

    `also` are further columns to keep with each leaf. The whole values are hashed where they are read; only digests move.
    """
    own = [F.col(source).alias("source"), F.col(key).alias("key"), digest(F.concat(*[framed(F.col(c)) for c in columns])).alias("digest")]
    hashed = scratch.put(docs.select(*own, *[c.alias(name) for name, c in (also or {}).items()]))
    sorted_rows = in_order(hashed, scratch, "source", "key", "digest")
    pieces = sorted_rows.groupBy("source", "part").agg(F.count("*").alias("rows"), F.min("seat").alias("first"))
    whole = Window.partitionBy("source")
    pieces = scratch.put(pieces.select("source", "part", "first", F.coalesce(F.sum("rows").over(_before("source")), F.lit(0)).alias("earlier"), F.sum("rows").over(whole).alias("n")))
    listed = in_order(pieces.groupBy("source").agg(F.first("n").alias("n")), scratch, "source")
    ranges = listed.groupBy("part").count()
    offsets = ranges.select("part", F.coalesce(F.sum("count").over(_before()), F.lit(0)).alias("start"))  # a row for each range
    sources = scratch.put(listed.join(F.broadcast(offsets), "part").select("source", "n", (F.col("start") + F.col("seat")).alias("tree")))
    numbered = pieces.alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select("p.*", "s.tree")
    placed = sorted_rows.alias("r").join(numbered.alias("p"), (F.col("r.part") == F.col("p.part")) & F.col("r.source").eqNullSafe(F.col("p.source")))
    kept = [F.col(f"r.{c}") for c in ("source", "key", "digest", *(also or {}))]
    leaves = scratch.put(placed.select("tree", "n", (F.col("earlier") + F.col("seat") - F.col("first")).alias("node"), *kept))

    count, most = sources.agg(F.count("*"), F.max("n")).first()
    levels = build(leaves, most or 0, scratch)
    subroots = scratch.put(tops(leaves, levels).select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("node"), F.col("n").alias("size"), "digest"))
    upper = build(subroots, count, scratch)
    root = tops(subroots, upper).first()
    return Manifest(leaves, levels, upper, subroots, bytes(root["digest"]) if root else None)


def prove(manifest: Manifest, requests: DataFrame, scratch) -> DataFrame:
    """The requests (tree, n, node, any other columns) with `subroot` and `path`: what must be hashed around a leaf, from leaf to root.

    A segment holds the run's digests before and after the own node, 32 bytes each; both may be empty.
    """
    if manifest.root is None:
        return requests.select("*", F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast(PATH).alias("path"))
    root = requests.sparkSession.createDataFrame([(0, manifest.root)], "tree bigint, digest binary")
    start = root.withColumn("path", F.array().cast(PATH)).join(manifest.sources.select("tree", "n").limit(1), "tree").select("tree", "n", "digest", "path")
    above = descend(start, manifest.upper, manifest.sources.select("tree", "n", "node", "size"), scratch)
    roots = scratch.put(above.select(F.col("node").alias("tree"), F.col("size").alias("n"), "digest", "path"))
    asked = requests.withColumnRenamed("digest", "own_digest")
    found = descend(roots, manifest.levels, asked, scratch)
    return found.drop("digest").withColumnRenamed("own_digest", "digest").withColumnRenamed("top", "subroot").withColumn("path", F.reverse("path"))


def proof_digest(path: Column) -> Column:
    """SHA-256, in hexadecimal digits, of all siblings of a path as hexadecimal text."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(hexed(s["before"]), hexed(s["after"]))), "").cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, s: digest(F.concat(hexed(s["before"]), hexed(node), hexed(s["after"]))))


def lowered(text: Column) -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, letters, letters.lower())


def audit(docs: DataFrame, scratch, source: str = "source", doc_id: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; digests in hexadecimal digits.

    Rows for which `tampered` holds (default: 5 divides the unsigned crc32 of the decimal id; never a null id) fold from the leaf of
    their text with A-Z lower-cased, all others from their own; a null text stays null, and a text without capitals verifies. A
    null in any column is framed as `-`, apart from an empty text (`0:`). Null ids come first in their source, null sources first of
    all. Rows that repeat an id are leaves each, ordered by digest; rows equal in all columns have equal leaves, and which of
    them has which proof is left open. An empty table gives no rows. Columns not named are not looked at.
    """
    if tampered is None:
        tampered = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
    forged = digest(F.concat(*[framed(lowered(F.col(c)) if c == text else F.col(c)) for c in columns]))
    manifest = write_manifest(docs, scratch, columns, source, doc_id, {"forged": F.when(tampered, forged)})
    root = F.lit(None if manifest.root is None else manifest.root.hex()).cast("string")
    proved = prove(manifest, manifest.leaves, scratch)
    folded = proved.select(
        F.col("key").alias("doc_id"), hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), root.alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"), hexed(fold(F.coalesce("forged", "digest"), F.col("path"))).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
