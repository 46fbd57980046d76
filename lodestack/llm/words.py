"""Words of whole texts as 64-bit hashes, computed on Arrow buffers.

A text column is looked at as one run of bytes with offsets. A token is a longest run of bytes of one class, never across
two texts. Its hash is a polynomial over random 64-bit values of its bytes, finished by a bit mixer, so tokens of any
length cost the same per byte. Working memory is bounded by `BLOCK` bytes of text and by the longest single token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
#: Bytes hashed at once, few enough that the working arrays stay in a core's cache; hashes don't depend on it.
HASHED = 1 << 15
_BASE = 0x9E3779B97F4A7C15 | 1
_UINT = np.uint64

#: One class for everything between the separators space and 0x09 to 0x0D.
WORDS = np.ones(256, np.uint8)
WORDS[[0x20, *range(0x09, 0x0E)]] = 0
#: Letters (and all bytes beyond ASCII), digits and other signs apart.
PIECES = WORDS * 3
PIECES[[*range(0x30, 0x3A)]] = 2
PIECES[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x.astype(_UINT, copy=True)
    x ^= x >> _UINT(30)
    x *= _UINT(0xBF58476D1CE4E5B9)
    x ^= x >> _UINT(27)
    x *= _UINT(0x94D049BB133111EB)
    x ^= x >> _UINT(31)
    return x


_VALUES = mixed(np.arange(1, 257, dtype=_UINT) * _UINT(0x2545F4914F6CDD1D))
_POWERS = np.ones(0, _UINT)
_INVERSE = np.ones(0, _UINT)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n, BLOCK + 1)
        up, down = np.full(size, _BASE, _UINT), np.full(size, pow(_BASE, -1, 1 << 64), _UINT)
        up[0] = down[0] = 1
        kept = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > BLOCK + 1:
            return kept
        _POWERS, _INVERSE = kept
    return _POWERS, _INVERSE


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 * BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about `most` bytes of text; a longer text comes alone."""
    for batch in batches:
        _, offsets = byte_view(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def token_spans(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all tokens, and for each text the index of its first token, with a closing one."""
    kinds = np.frombuffer(data.tobytes().translate(classes.tobytes()), np.uint8)
    if classes.max() == 1:  # one kind of token: where it begins and where it ends
        begins, stops = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        np.greater(kinds[1:], kinds[:-1], out=begins[1:-1])
        np.less(kinds[1:], kinds[:-1], out=stops[1:-1])
        begins[offsets[offsets < len(data)]] = kinds[offsets[offsets < len(data)]]
        stops[offsets[offsets > 0]] = kinds[offsets[offsets > 0] - 1]
        begins[0] = len(data) > 0 and kinds[0]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
        return starts, ends, np.searchsorted(starts, offsets)
    cuts = np.ones(len(data) + 1, bool)
    np.not_equal(kinds[1:], kinds[:-1], out=cuts[1:-1])
    cuts[offsets] = True
    edges = np.flatnonzero(cuts)
    inside = kinds[edges[:-1]] > 0 if len(data) else np.zeros(0, bool)
    starts, ends = edges[:-1][inside], edges[1:][inside]
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """The hash of every span of bytes; spans are sorted and do not overlap."""
    out = np.empty(len(starts), _UINT)
    values = _VALUES[fold]
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + HASHED, "right")))
        up, down = powers(int(ends[j - 1] - low) + 1)
        sums = np.zeros(int(ends[j - 1] - low) + 1, _UINT)
        np.cumsum(values.take(data[low : ends[j - 1]]) * up[: len(sums) - 1], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - low] - sums[starts[i:j] - low]) * down[starts[i:j] - low]
        i = j
    return mixed(out)


def word_hashes(column: pa.Array, classes: np.ndarray = WORDS, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, index of each text's first word with a closing one)."""
    data, offsets = byte_view(column)
    starts, ends, first = token_spans(data, offsets, classes)
    return span_hashes(data, starts, ends, fold), first
