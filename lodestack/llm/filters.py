"""Bit filters of a fixed size: which rows can have a partner, decided before an exchange.

A filter only leaves rows out that certainly have no partner; the exact join comes after it. When the data outgrow the
filter, more rows pass and results stay the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bit_filter(df: DataFrame, value: Column, bits: int = 24) -> np.ndarray:
    """The filter over a column of well-mixed 64-bit values: 2^bits bits, as 64-bit words, whatever the number of rows."""
    first = F.shiftrightunsigned(value, 64 - bits)
    second = F.shiftrightunsigned(value, 8).bitwiseAND(F.lit((1 << bits) - 1))
    places = df.select(F.explode(F.array(first, second)).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
    got = words.toArrow()  # at most 2^(bits - 6) rows
    table = np.zeros(1 << bits - 6, np.int64)
    table[got["w"].to_numpy()] = got["v"].to_numpy()
    return table.view(np.uint64)


def passes(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values may be in the filter."""
    bits = (len(table) * 64).bit_length() - 1
    values = values.view(np.uint64)
    keep = np.ones(len(values), bool)
    for place in (values >> np.uint64(64 - bits), values >> np.uint64(8) & np.uint64((1 << bits) - 1)):
        keep &= (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return keep
