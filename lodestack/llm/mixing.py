"""Mixing sources to target weights by weighted sampling without replacement (exponential keys).

Each document draws an exponential key, its unit draw divided by its quality weight; the smallest keys of a source come
first. A source's target is met by whole epochs and then by the documents with the smallest keys whose running sum of
sizes fits the rest. Only built-in functions run. No source is ever sorted as a whole: sizes are summed per (source, slice
of the key range), the slice in which the rest runs out is found on those sums, and only the rows of that slice are put in
order. The outcome is one cut (key, id) per source, so texts never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Signs that prose seldom holds; their share lowers a document's weight.
SIGNS = "%&$#*|!<>{}[]^~=@_+"
SLICE_BITS = 20


def sign_free(text: Column) -> Column:
    """The default quality weight: 0.25 plus three quarters of the share of characters outside `SIGNS`, cubed."""
    share = F.try_divide(F.length(F.translate(text, SIGNS, "")).cast("double"), F.length(text).cast("double"))
    return F.coalesce(0.25 + 0.75 * F.pow(share, F.lit(3)), F.lit(0.25))


def draw_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """The exponential draw of a document over its weight, as a whole number of 2^-32."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))))
    unit = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1).cast("double") / F.lit(float(2**52))
    known = weight.isNotNull() & ~F.isnan(weight) & (weight > 1e-3)
    sane = F.when(known, F.least(weight.cast("double"), F.lit(1e6))).otherwise(F.lit(1e-3))
    return F.floor(-F.log(unit) / sane * F.lit(float(2**32))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Weights repeat over the sources in code-point order, null last. With sources sorted by cap over weight, the level of the
    first source that stays under its cap is the level of all later ones: what capped sources leave is reshared by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", cycle.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    by_cap = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    levels = ranked.withColumn("level", level)
    free = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    whole = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return levels.withColumn("all", F.first(free, ignorenulls=True).over(whole)).select(
        "source", "source_size", F.coalesce(F.least("cap", F.col("all") * F.col("w")), F.col("cap")).alias("target")
    )


def source_cuts(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, target, epochs, and the last (cut_key, cut_id) of its fractional epoch.

    `rows` holds source, id (string), size and key. A source whose rest takes no document has null cuts.
    """
    parts = rows.groupBy("source", F.shiftright("key", SLICE_BITS).alias("slice")).agg(F.sum("size").alias("part"))
    sizes = parts.groupBy("source").agg(F.sum("part").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    targets = source_targets(sizes, weights, share, most).withColumn("epochs", epochs)
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    running = Window.partitionBy("s.source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        parts.alias("s")
        .join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .select(F.col("s.source").alias("source"), "slice", "part", "rest", F.coalesce(F.sum("part").over(running), F.lit(0)).alias("under"))
        .where((F.col("under") < F.col("rest")) & (F.col("under") + F.col("part") >= F.col("rest")))
    )
    near = (
        rows.withColumn("slice", F.shiftright("key", SLICE_BITS)).alias("r")
        .join(edges.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.slice") == F.col("e.slice")))
        .select(F.col("r.source").alias("source"), "r.key", "r.id", "r.size", "e.under", "e.rest")
    )
    ordered = Window.partitionBy("source").orderBy("key", "id").rangeBetween(Window.unboundedPreceding, 0)
    middle = F.col("under") + F.sum("size").over(ordered) - F.col("size") / 2
    fits = near.withColumn("middle", middle).where(F.col("middle") <= F.col("rest"))
    last = fits.groupBy("source").agg(F.max(F.struct("key", "id")).alias("inner"))
    below = edges.select("source", (F.shiftleft("slice", SLICE_BITS) - 1).alias("below"))
    return (
        targets.alias("t")
        .join(last.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left")
        .join(below.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source")), "left")
        .select(
            F.col("t.source").alias("source"), "source_size", "target", "epochs",
            F.coalesce(F.col("inner.key"), F.col("below")).alias("cut_key"),
            F.coalesce(F.col("inner.id"), F.when(F.col("below").isNotNull(), F.lit("\U0010ffff"))).alias("cut_id"),
        )
    )


def copies_of(key: Column, doc_id: Column) -> Column:
    """Times a row is taken, given its source's columns of `source_cuts`."""
    within = (key < F.col("cut_key")) | ((key == F.col("cut_key")) & (doc_id <= F.col("cut_id")))
    return F.col("epochs") + F.when(F.coalesce(within, F.lit(False)), 1).otherwise(0)


def narrow(docs: DataFrame, weight: Column | None, seed: int, doc_id: str, text: str, source: str) -> DataFrame:
    """(doc_id, source, id, size, key): what sampling needs of a document."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    weight = sign_free(F.col(text)) if weight is None else weight
    # two steps, so that the weight is computed once
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), size.alias("size"), weight.alias("weight"))
    return rows.select("doc_id", "source", "id", "size", draw_key(F.col("doc_id"), F.col("weight"), seed).alias("key"))


def plan_mix(docs: DataFrame, scratch, weight: Column | None = None, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source", **targets) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (size times copies), copies.

    `scratch` keeps the narrow rows, so texts are read once. Nulls: a null text has size 0 and is taken with its source's
    whole epochs only in name (0 words); a null source is a source of its own, the last one; a null id draws like an empty
    one; a weight that is null, NaN or under 0.001 counts as 0.001. Rows that agree in id and source get one key and are
    taken together. An empty table gives no rows. Other columns of `docs` are not looked at.
    """
    rows = scratch.put(narrow(docs, weight, seed, doc_id, text, source))
    cuts = scratch.put(source_cuts(rows, **targets), 1)
    times = copies_of(F.col("r.key"), F.col("r.id"))
    return rows.alias("r").join(cuts.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source"))).select(
        "r.doc_id", "r.size", "c.source_size", "c.target", (F.col("r.size") * times).alias("taken"), times.cast("int").alias("copies")
    )


def mix_documents(docs: DataFrame, scratch, weight: Column | None = None, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source", **targets) -> DataFrame:
    """The rows of `docs` as the mix takes them: each 0, 1 or 2 times, with all its own columns. Rules as in `plan_mix`."""
    rows = scratch.put(narrow(docs, weight, seed, doc_id, text, source))
    cuts = scratch.put(source_cuts(rows, **targets), 1)
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("source"), F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), (sign_free(F.col(text)) if weight is None else weight).alias("weight"),
    ).select("row", "source", "id", draw_key(F.col("doc_id"), F.col("weight"), seed).alias("key"))
    times = copies_of(F.col("h.key"), F.col("h.id"))
    taken = held.alias("h").join(cuts.alias("c"), F.col("h.source").eqNullSafe(F.col("c.source"))).select("h.row", times.alias("times"))
    return taken.where("times > 0").select(F.explode(F.array_repeat("row", F.col("times").cast("int"))).alias("row")).select("row.*")
