"""Knowledge entries: a similarity guard that depends on arrival order, resolved all over the data at once.

A few rounds settle every entry whose surroundings are settled, which is nearly all. What is left is entries that may see
different points because forced ones before them delete some. Those fall into groups that do not touch each other,
and each group is replayed in arrival order in one pass.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.pairs import block_pairs, near_products, pack_blocks, useful_cells
from lodestack.operators.similarity import ANGLE_SLACK, BLOCK_ROWS, MAX_PIVOTS, pick_pivots, unit_rows
from lodestack.session import cut_lineage, drop_cut

NEVER = 2**62
# Rounds before what is left is replayed, and the most rows of a group that is.
ROUNDS = 3
GROUP_ROWS = 100_000
# Digits of a score that count where points of equal score are told apart by their ids.
TIE_DIGITS = 12


def knowledge_text(query: Column, answer: Column) -> Column:
    """The text an entry is embedded as."""
    return F.concat(F.lit("Q: "), query, F.lit("\nA: "), answer)


def _look_around(
    entries: DataFrame, points: DataFrame, waiting: DataFrame | None, scope: Sequence[str], threshold: float, centres: np.ndarray | None, keep: bool = False
) -> DataFrame:
    """Per entry that sees any: whether earlier undecided entries are near enough to matter, and its nearest point alive on arrival.

    Entries and candidates are packed once and compared by pairs of blocks. With `keep` that is left to who reads the result.
    """
    reach = 2 * math.acos(threshold)
    near_cosine = math.cos(min(reach + ANGLE_SLACK, math.pi))
    candidates = points.select(
        "point_id", "inserted_at", "deleted_at", F.lit(False).alias("undecided"), F.lit(False).alias("force"), *scope, "vector"
    )
    if waiting is not None:
        candidates = candidates.unionByName(
            waiting.select(
                F.col("entry_id").alias("point_id"),
                F.col("arrival").alias("inserted_at"),
                F.lit(NEVER).alias("deleted_at"),
                F.lit(True).alias("undecided"),
                "force",
                *scope,
                "vector",
            )
        )

    def look(left: pd.DataFrame, right: pd.DataFrame, a: np.ndarray, b: np.ndarray) -> pd.DataFrame | None:
        least = min(threshold, near_cosine) if right["undecided"].any() else threshold
        rows, columns, cosines = near_products(a, b, least)
        if not len(rows):
            return None
        left, right = left.iloc[rows], right.iloc[columns]
        order = np.argsort(right["point_id"].to_numpy(), kind="stable")
        right, cosines = right.iloc[order], cosines[:, order]
        arrival = left["arrival"].to_numpy()[:, None]
        undecided, force = right["undecided"].to_numpy(), right["force"].to_numpy()
        before = right["inserted_at"].to_numpy()[None, :] < arrival
        blocks = before & undecided[None, :] & (cosines >= near_cosine)
        alive = before & ~undecided[None, :] & (right["deleted_at"].to_numpy()[None, :] > arrival)
        scores = np.where(alive & (cosines >= threshold), np.round(cosines, TIE_DIGITS), -2.0)
        at = scores.argmax(axis=1)
        best = scores[np.arange(len(left)), at]
        found = pd.DataFrame(
            {
                "entry_id": left["entry_id"].to_numpy(),
                "any_before": blocks.any(axis=1),
                "forced_before": (blocks & force[None, :]).any(axis=1),
                "score": best,
                "match_id": np.where(best > -2.0, right["point_id"].to_numpy()[at], None),
            }
        )
        return found[found["any_before"] | found["match_id"].notna()].astype({"match_id": "string"})

    cells = useful_cells(centres, reach)
    mine = pack_blocks(entries.select("entry_id", "arrival", *scope, "vector"), scope, "arrival", cells)
    theirs = pack_blocks(candidates, scope, "inserted_at", cells)
    schema = "entry_id string, any_before boolean, forced_before boolean, score double, match_id string"
    seen = block_pairs(mine, theirs, look, schema, min(reach, math.pi), earlier=True)
    best = F.min(F.when(F.col("match_id").isNotNull(), F.struct((-F.col("score")).alias("s"), "match_id")))
    nearest = seen.groupBy("entry_id").agg(
        F.max("any_before").alias("any_before"), F.max("forced_before").alias("forced_before"), best.alias("m")
    )
    if keep:
        return nearest
    nearest = cut_lineage(nearest)
    drop_cut(mine, theirs)
    return nearest


def _links(cosines: np.ndarray, threshold: float, left: np.ndarray, right: np.ndarray) -> pd.DataFrame:
    """(a, b): for every row and column that is near to another, a link to the first id of those it hangs together with.

    At most a link per row and column, however many are near to each other.
    """
    near = cosines >= threshold
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    near = near[np.ix_(rows, columns)]
    of_rows, of_columns = np.arange(len(rows)), np.full(len(columns), len(rows))
    while len(rows):
        of_columns = np.where(near, of_rows[:, None], len(rows)).min(axis=0)
        lower = np.where(near, of_columns[None, :], len(rows)).min(axis=1)
        if (lower == of_rows).all():
            break
        of_rows = np.minimum(lower, of_rows[lower])
    heads = left[rows]
    return pd.DataFrame({"a": np.concatenate([heads, right[columns]]), "b": np.concatenate([heads[of_rows], heads[of_columns]])})


def connected(links: DataFrame) -> DataFrame:
    """(node, head): the smallest node that each node of (a, b) hangs together with.

    Every round links the larger neighbours of a node to its smallest, then the smaller ones, until nothing moves: a chain
    of n nodes takes about log n rounds, a star or a clique two.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("head"))
        large = cut_lineage(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("head").alias("b")).distinct())
        smaller = large.groupBy("a").agg(F.min("b").alias("head"))
        small = large.join(smaller, "a").select(F.when(F.col("b") == F.col("head"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("head").alias("b"))
        after = cut_lineage(small.where("a <> b").distinct())
        # Settled is a forest of stars: heads have no head of their own, and nodes have one.
        heads = after.select("b").distinct()
        if after.join(heads.withColumnRenamed("b", "a"), "a", "left_semi").isEmpty() and after.groupBy("a").count().where("count > 1").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("head")).union(heads.select("b", "b"))
        edges = after


def _replay(waiting: DataFrame, points: DataFrame, scope: Sequence[str], threshold: float, centres: np.ndarray | None, most: int) -> DataFrame:
    """(entry_id, verdict, match_id, similarity) of the waiting entries, group by group in the order of arrival."""
    ids = {f.name: f.dataType.simpleString() for f in waiting.schema.fields}
    sides = waiting.select(F.col("entry_id").alias("id"), *scope, "vector")
    lives = points.select(F.col("point_id").alias("id"), *scope, "vector")

    def link(left: pd.DataFrame, right: pd.DataFrame, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        rows, columns, cosines = near_products(a, b, threshold)
        return _links(cosines, threshold, *(x["_place"].to_numpy()[at] for x, at in ((left, rows), (right, columns))))

    # Ids repeat between scopes, and points may be named like entries: places are told apart by kind and scope.
    def placed(df: DataFrame, kind: str) -> DataFrame:
        return df.withColumn("_place", F.to_json(F.struct(F.lit(kind).alias("k"), F.struct(*scope).alias("s"), F.col("id").alias("i"))))

    reach = math.acos(threshold) if threshold > 0 else math.pi
    cells = useful_cells(centres, reach)
    entries = placed(sides, "e").withColumn("_moment", F.lit(0))
    left, right = (pack_blocks(df, scope, "_moment", cells) for df in (entries, entries.unionByName(placed(lives, "p").withColumn("_moment", F.lit(0)))))
    heads = cut_lineage(connected(block_pairs(left, right, link, "a string, b string", reach)))
    drop_cut(left, right)
    rows = placed(waiting.withColumn("id", F.col("entry_id")), "e").select(
        "_place", F.col("id"), "arrival", F.lit(NEVER).alias("deleted_at"), "force", F.lit(True).alias("waits"), "vector"
    )
    alive = placed(points.withColumn("id", F.col("point_id")), "p").select(
        "_place", F.col("id"), F.col("inserted_at").alias("arrival"), "deleted_at", F.lit(False).alias("force"), F.lit(False).alias("waits"), "vector"
    )
    # An entry without links is a group of its own; a point without is nobody's match.
    named = heads.withColumnRenamed("node", "_place")
    grouped = cut_lineage(
        rows.join(named, "_place", "left").withColumn("head", F.coalesce("head", "_place")).unionByName(alive.join(named, "_place"))
    )
    largest = grouped.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).orderBy(F.desc("n")).first()
    if largest and largest["n"] > most:
        raise ValueError(f"{largest['n']} entries and points around {largest['id']!r} are near to each other, with forced ones among them; at most {most} can be replayed")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        # Points of one moment come before an entry of it; equal scores go to the smaller id.
        group = group.sort_values(["arrival", "waits", "id"], kind="stable")
        units = unit_rows(group["vector"])
        names, arrival, waits = group["id"].to_numpy(), group["arrival"].to_numpy(), group["waits"].to_numpy()
        ends, force = group["deleted_at"].to_numpy().copy(), group["force"].to_numpy()
        here = np.zeros(len(group), bool)
        here[~waits] = True
        out = []
        for n in np.flatnonzero(waits):
            seen = np.flatnonzero(here & (arrival < arrival[n]) & (ends > arrival[n]))
            scores = units[seen] @ units[n]
            near = seen[scores >= threshold]
            best = min(near, key=lambda i: (-float(units[i] @ units[n]), names[i]), default=None) if len(near) else None
            if best is not None and not force[n]:
                out.append((names[n], "skipped", names[best], float(units[best] @ units[n])))
                continue
            if best is not None:
                ends[best] = arrival[n]
            here[n] = True
            out.append((names[n], "inserted" if best is None else "replaced", None if best is None else names[best], None if best is None else float(units[best] @ units[n])))
        return pd.DataFrame(out, columns=["entry_id", "verdict", "match_id", "similarity"])

    return grouped.groupBy("head").applyInPandas(run, f"entry_id {ids['entry_id']}, verdict string, match_id string, similarity double")


def ingest_knowledge(
    entries: DataFrame,
    stored: DataFrame,
    threshold: float = 0.95,
    scope: Sequence[str] = ("collection_name",),
    rounds: int = ROUNDS,
    group_rows: int = GROUP_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(log, points) after all entries arrived one after the other.

    `entries`: entry_id string, arrival bigint (distinct within a scope), force boolean, the scope columns and vector.
    `stored`: point_id string, scope, vector. An entry whose nearest living point has cosine ≥ threshold is skipped, or
    with `force` replaces that point; any other entry becomes a point. Later entries see earlier ones.

    Whether an entry's surroundings are settled only depends on entries within twice the threshold angle. So each round
    decides, all over the data at once, every entry with no undecided earlier one in that reach, and also skips every
    unforced entry that sees a living point no undecided forced entry could delete. Unforced copies of one entry
    settle in two rounds however many they are. What still waits after `rounds` rounds is replayed, each group of entries and
    points that are near to each other on its own; a group of more than `group_rows` rows is an error, which only a mass of
    near-copies with forced ones among them makes.
    """
    names = ["entry_id", "arrival", "force", *scope, "vector"]
    named = [F.col(c).isNotNull() for c in scope]
    waiting = cut_lineage(entries.select(*names).where(functools.reduce(Column.__and__, named, F.lit(True))))
    points = cut_lineage(
        stored.select("point_id", F.lit(-1).cast("bigint").alias("inserted_at"), F.lit(NEVER).alias("deleted_at"), *scope, "vector")
    )
    pivots = min(MAX_PIVOTS, (waiting.count() + points.count()) // BLOCK_ROWS)
    sizes = waiting.select(F.size("vector").alias("n")).union(points.select(F.size("vector"))).distinct().limit(2).count()
    centres = pick_pivots(waiting, "vector", pivots) if pivots > 1 and sizes == 1 else None
    log, skipped, done = None, None, 0

    def settled(decided: DataFrame) -> None:
        """Adds to the log, without vectors, to the skipped entries and to the points. What was read before is dropped."""
        nonlocal log, skipped, points
        rows = cut_lineage(decided.drop("vector"))
        passed = cut_lineage(decided.where(F.col("verdict") == "skipped").select(*names))
        after = cut_lineage(_after(points, decided, scope))
        drop_cut(points)
        log, skipped = (new if old is None else old.unionByName(new) for old, new in ((log, rows), (skipped, passed)))
        points = after

    while not waiting.isEmpty():
        done += 1
        if done > rounds:
            found = cut_lineage(_replay(waiting, points, scope, threshold, centres, group_rows))
            settled(waiting.join(found, "entry_id").select(*names, "verdict", "match_id", "similarity"))
            drop_cut(waiting)
            break
        seen = _look_around(waiting, points, waiting, scope, threshold, centres)
        ready, matched = ~F.coalesce("any_before", F.lit(False)), F.col("m").isNotNull()
        passed = matched & ~F.col("force") & ~F.col("forced_before")
        verdict = (
            F.when(ready & matched & F.col("force"), "replaced")
            .when(ready & ~matched, "inserted")
            .when(passed, "skipped")
            .otherwise("waiting")
        )
        state = cut_lineage(waiting.join(seen, "entry_id", "left").withColumn("verdict", verdict))
        drop_cut(waiting)
        settled(
            state.where(F.col("verdict") != "waiting").select(*names, "verdict", F.col("m.match_id").alias("match_id"), (-F.col("m.s")).alias("similarity"))
        )
        waiting = state.where(F.col("verdict") == "waiting").select(*names)
    alive = points.where(F.col("deleted_at") == NEVER).select("point_id", *scope, "vector")
    if log is not None:
        drop_cut(waiting)
    else:
        log = waiting.drop("vector").withColumns({"verdict": F.lit(""), "match_id": F.lit(""), "similarity": F.lit(0.0)})
        skipped = waiting
    return _final_log(log, skipped, points, scope, threshold, centres), alive


def _after(points: DataFrame, decided: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The points with those added that were decided on, and the ends of those that they replaced."""
    deleted = decided.where(F.col("verdict") == "replaced").select(
        F.col("match_id").alias("point_id"), F.col("arrival").alias("_deleted"), *scope
    )
    added = decided.where(F.col("verdict") != "skipped").select(
        F.col("entry_id").alias("point_id"), F.col("arrival").alias("inserted_at"), F.lit(NEVER).alias("deleted_at"), *scope, "vector"
    )
    both = points.unionByName(added)
    ended = both.join(deleted, ["point_id", *scope], "left").withColumn("deleted_at", F.coalesce("_deleted", "deleted_at"))
    return ended.select(points.columns)


def _final_log(
    log: DataFrame, skipped: DataFrame, points: DataFrame, scope: Sequence[str], threshold: float, centres: np.ndarray | None
) -> DataFrame:
    """An early skip may have seen only some of its neighbours, so skipped entries look again at all points."""
    again = _look_around(skipped, points, None, scope, threshold, centres, True)
    rows = log.join(again.select("entry_id", F.col("m").alias("_m")), "entry_id", "left")
    reused = F.col("verdict") == "skipped"
    return rows.select(
        "entry_id",
        *scope,
        "arrival",
        (~reused).alias("inserted"),
        reused.alias("reused"),
        F.coalesce("_m.match_id", "match_id").alias("match_id"),
        F.coalesce(-F.col("_m.s"), F.col("similarity")).alias("similarity"),
        (F.col("verdict") == "replaced").alias("replaced"),
        F.when(reused, F.lit("similarity_guard")).alias("reason"),
    )
