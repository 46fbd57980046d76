"""User functions over frames."""

from collections.abc import Callable, Sequence
from typing import Any, Iterator, Tuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# States of keys that a task holds before it hands them on.
HELD_KEYS = 10_000


def verify_transform(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> dict[str, object]:
    """{success, error} of a callable given the DataFrame, whose lazy result is computed in full. Source text is not taken."""
    if not callable(fn):
        raise TypeError("fn must be callable")
    try:
        result = fn(df)
        if isinstance(result, DataFrame):
            result.write.format("noop").mode("overwrite").save()
        return {"success": True, "error": None}
    except Exception as error:  # the point is to report whatever the callable raises
        return {"success": False, "error": str(error)}


def run_grouped_function(
    df: DataFrame,
    keys: Sequence[str],
    fn: Callable[[tuple, Iterator[pd.DataFrame]], dict | list[dict]],
    schema: str,
) -> DataFrame:
    """`fn(key, frames)` per group returns one object or a list of objects, which become rows of `schema`.

    A group reaches `fn` as a stream of Arrow-sized frames, so a group that holds a third of all rows is never loaded
    whole. Any other result is an error.
    """

    def run(key: Tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield _objects(fn(key, frames))

    return df.groupBy(*keys).applyInPandas(run, schema)


def _objects(result: object) -> pd.DataFrame:
    rows = [result] if isinstance(result, dict) else result
    if not isinstance(rows, list) or not all(isinstance(row, dict) for row in rows):
        raise TypeError(f"function must return an object or a list of objects, not {type(result).__name__}")
    return pd.DataFrame(rows)


def run_grouped_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    partial: Callable[[pd.DataFrame], dict],
    merge: Callable[[dict, dict], dict],
    finish: Callable[[tuple, dict], dict | list[dict]],
    state: str,
    schema: str,
) -> DataFrame:
    """An aggregate by user functions that spreads over as many tasks as `df` has partitions, whatever the groups.

    `partial(frame)` turns some rows of one key into a state, an object of the columns `state`; `merge(a, b)` joins two states
    of a key and may be called in any order; `finish(key, state)` gives one object or a list of objects, the rows of
    `schema`. A task joins the states of a key before the exchange, so a group sends about one state for each task. A null is
    a key like any other. State columns must be named otherwise than the keys.
    """
    names = [f.name for f in T._parse_datatype_string(state).fields]
    if clash := sorted({*names} & {*keys}):
        raise ValueError(f"state columns named like keys: {', '.join(clash)}")
    typed = df.select(*keys).schema
    held_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in typed), state])

    def plain(key: tuple) -> tuple:
        """The key with one kind of null, as frames have several that differ from themselves."""
        return tuple(None if pd.isna(k) else k for k in key)

    def rows(states: dict[tuple, dict]) -> pd.DataFrame:
        frame = pd.DataFrame([dict(zip(keys, key)) | {n: held[n] for n in names} for key, held in states.items()], columns=[*keys, *names])
        return frame.astype({k: object for k in keys})

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, dict] = {}
        for frame in frames:
            for key, part in frame.groupby(list(keys), dropna=False, sort=False):
                mine, key = partial(part), plain(key)
                states[key] = merge(states[key], mine) if key in states else mine
            if len(states) >= HELD_KEYS:
                yield rows(states)
                states = {}
        if states:
            yield rows(states)

    def close(key: Tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict | None = None
        for frame in frames:
            for one in frame[names].to_dict("records"):
                total = one if total is None else merge(total, one)
        yield _objects(finish(plain(key), total))

    return df.mapInPandas(gather, held_schema).groupBy(*keys).applyInPandas(close, schema)
