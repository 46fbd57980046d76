"""Helpers on whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed exactly once per row.

    Around Python functions the optimizer merges neighbouring projections, and a costly expression is then repeated at
    each place that reads it, even per array element inside a lambda. A generator over one struct is not merged.
    """
    rest = [c for c in df.columns if c not in columns]
    struct = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*rest, F.inline(F.array(struct)))
