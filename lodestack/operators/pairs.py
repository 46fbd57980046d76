"""All pairs of blocks of vectors without copies of rows: blocks are written once, and a pair is read where it is compared.

Rows with neighbouring scopes, cells and moments are packed into blocks of a few thousand, one row of the shared folder each. Spark's
nested loop or Cartesian join then reads the two blocks of a pair in one task; nothing is shuffled between, so disk grows with the
rows and only reading and products with their square. A task holds the blocks of one partition of the folder.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.similarity import ANGLE_SLACK, BLOCK_ROWS, _home_cells
from lodestack.session import cut_lineage

# Bytes of a block's vectors, and blocks of a file, which is the least that a task reads.
PACK_BYTES = 8 << 20
FILE_BLOCKS = 4
# Cells order the rows if from one of them no more than this share of all can be reached.
REACHED = 0.5
PACKED = "low string, high string, first bigint, last bigint, width int, radius double, centre binary, facts binary, vectors binary"


def units(matrix: np.ndarray) -> np.ndarray:
    """Row-normalised; a zero vector stays zero and so matches nothing."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def scope_key(scope: Sequence[str]) -> Column:
    """One text for the scope columns, equal where all of them are."""
    return F.to_json(F.struct(*scope)) if scope else F.lit("")


def near_products(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, products): those rows and columns of unit vectors that have a product of `least`, and all their products.

    They are found in single precision, with slack for its errors, and then formed in double precision.
    """
    slack = 2.0**-22 * (a.shape[1] + 8)
    near = a.astype(np.float32) @ b.astype(np.float32).T >= np.float32(least - slack)
    rows = np.flatnonzero(near.any(axis=1))
    columns = np.flatnonzero(near[rows].any(axis=0))
    return rows, columns, a[rows] @ b[columns].T


def useful_cells(centres: np.ndarray | None, angle: float):
    """A column function from vectors to the nearest of the centres, if those keep enough rows apart, else none."""
    if centres is None or len(centres) < 2:
        return None
    angles = np.arccos(np.clip(centres @ centres.T, -1.0, 1.0))
    np.fill_diagonal(angles, np.inf)
    reached = angles <= angles.min(axis=1, keepdims=True) + 2 * angle + ANGLE_SLACK
    return _home_cells(centres) if reached.sum() <= REACHED * len(centres) * (len(centres) - 1) else None


def _block(table: pa.Table, width: int) -> dict:
    table = table.combine_chunks()
    vectors = table["vector"].chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(len(table), width)
    unit = units(vectors)
    centre = units(np.nan_to_num(unit).sum(axis=0, keepdims=True))[0]
    # Angles from the centre, in which vectors that match nothing do not count.
    known = np.isfinite(unit).all(axis=1) & unit.any(axis=1)
    radius = float(np.arccos(np.clip(unit[known] @ centre, -1.0, 1.0)).max(initial=0.0))
    single = vectors.astype(np.float32)
    facts, sink = table.drop_columns(["vector", "_cell"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, facts.schema) as out:
        out.write_table(facts)
    scopes, at = pc.min_max(table["_scope"]), pc.min_max(table["_at"])
    return {
        "low": scopes["min"].as_py(),
        "high": scopes["max"].as_py(),
        "first": at["min"].as_py(),
        "last": at["max"].as_py(),
        "width": width,
        "radius": radius if centre.any() else math.pi,
        "centre": centre.tobytes(),
        "facts": sink.getvalue().to_pybytes(),
        # Half the bytes where no digit is lost; the length tells which.
        "vectors": (single if (single == vectors).all() else vectors).tobytes(),
    }


def _packer(block_rows: int):
    names = [c.split()[0] for c in PACKED.split(", ")]
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    schema = pa.schema([(n, types[c.split()[1]]) for n, c in zip(names, PACKED.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, kind = 0, None

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_block(pa.Table.from_batches(held), kind[0])], schema)

        for batch in batches:
            if batch["vector"].null_count:
                raise ValueError("a vector is missing")
            kinds = np.stack([pc.list_value_length(batch["vector"]).to_numpy(), batch["_cell"].to_numpy()], axis=1)
            changes = [0, *(np.flatnonzero((kinds[1:] != kinds[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for start, stop in zip(changes, changes[1:]):
                # A block has vectors of one size and, where cells are used, of one cell.
                while start < stop:
                    if held and kind != tuple(kinds[start].tolist()):
                        yield block()
                        held, n = [], 0
                    kind = tuple(kinds[start].tolist())
                    most = max(256, min(block_rows, PACK_BYTES // (8 * max(1, kind[0]))))
                    take = min(stop - start, most - n)
                    held.append(batch.slice(start, take))
                    n, start = n + take, start + take
                    if n >= most:
                        yield block()
                        held, n = [], 0
        if held:
            yield block()

    return run


def pack_blocks(df: DataFrame, scope: Sequence[str], at: str, cells=None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of `df` as blocks in the shared folder. All its columns but the vector are facts that `block_pairs` hands on."""
    cell = F.element_at(cells("vector"), 1) if cells else F.lit(0)
    keyed = df.withColumns({"_scope": scope_key(scope), "_at": F.col(at).cast("bigint"), "_cell": cell, "vector": F.col("vector").cast("array<double>")})
    order = ["_scope", "_cell", "_at"]
    # As many files as the rows fill, however many partitions the shuffle has: tasks grow with the square of the files.
    files = max(1, math.ceil(df.count() / (block_rows * FILE_BLOCKS)))
    packed = keyed.repartitionByRange(*order).coalesce(files).sortWithinPartitions(*order).mapInArrow(_packer(block_rows), PACKED)
    return cut_lineage(packed, maxRecordsPerFile=FILE_BLOCKS)


Compare = Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray], "pd.DataFrame | None"]


def block_pairs(left: DataFrame, right: DataFrame, compare: Compare, schema: str, angle: float, earlier: bool = False) -> DataFrame:
    """`compare(left facts, right facts, left units, right units)` for every pair of packed blocks and every scope that both have.

    Pairs are passed over if no vector of one is within `angle` of the other's, or, with `earlier`, if no row on the right was
    before one on the left. The result has `schema`.
    """
    a, b = (df.toDF(*[f"{side}_{c}" for c in df.columns]) for side, df in (("a", left), ("b", right)))
    meet = (F.col("a_low") <= F.col("b_high")) & (F.col("b_low") <= F.col("a_high"))
    if earlier:
        meet &= F.col("b_first") < F.col("a_last")
    parts = ("width", "radius", "centre", "facts", "vectors")
    pairs = a.crossJoin(b).where(meet).select(*[f"{side}_{c}" for side in "ab" for c in parts])

    def opened(row: dict, side: str) -> tuple[pd.DataFrame, np.ndarray]:
        with pa.ipc.open_stream(row[f"{side}_facts"]) as stream:
            facts = stream.read_all()
        size = row[f"{side}_width"] * len(facts)
        values = np.frombuffer(row[f"{side}_vectors"], np.float32 if len(row[f"{side}_vectors"]) == 4 * size else np.float64)
        return facts.to_pandas(), units(values.reshape(len(facts), -1).astype(np.float64))

    def reachable(row: dict) -> bool:
        if row["a_width"] != row["b_width"]:
            return True
        between = math.acos(max(-1.0, min(1.0, float(np.frombuffer(row["a_centre"]) @ np.frombuffer(row["b_centre"])))))
        return between <= row["a_radius"] + row["b_radius"] + angle + ANGLE_SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                if not reachable(row):
                    continue
                (mine, x), (theirs, y) = opened(row, "a"), opened(row, "b")
                # Scopes follow one another within a block, unless cells come between; those of a block are few then.
                for name in np.intersect1d(mine["_scope"].unique(), theirs["_scope"].unique()):
                    p, q = (np.flatnonzero((df["_scope"] == name).to_numpy()) for df in (mine, theirs))
                    found = compare(mine.iloc[p], theirs.iloc[q], x[p], y[q])
                    if found is not None and len(found):
                        yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    return pairs.mapInArrow(run, schema)
