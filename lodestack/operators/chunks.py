"""Packing lines into chunks, and reading chunks back from tagged text."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions.rows import with_pinned
from lodestack.functions.text import collapse_blanks, count_words, strip

# Fixed values of the chunk rules.
MIN_CHUNK_SIZE = 300
MAX_CHUNK_SIZE = 1000
MIN_CHUNK_WORDS = 50

BLANK_LINE, BLOCK, HEADING, BULLET, PLAIN = range(5)
BULLET_MARK = r"(?U)^(?:[-•·*]|\d+\.)\s+"


def _pack(kinds, sizes, words, clean_words, ends, opens, wrapped) -> list[list[int]]:
    """Chunks of one document as lists of line numbers. All texts stay in Spark; this sees only facts about lines."""
    chunks: list[list[int]] = []
    takes_more: list[bool] = []
    pending: list[int] = []
    size = n_words = n_clean = 0
    listing = False

    def add(i: int) -> None:
        nonlocal size, n_words, n_clean
        pending.append(i)
        size += sizes[i]
        n_words += words[i]
        n_clean += clean_words[i]

    def close(force: bool) -> None:
        nonlocal size, n_words, n_clean, listing
        body = [i for i in pending if sizes[i]]
        short = n_clean < MIN_CHUNK_WORDS
        if not pending or (body and short and not force):
            return
        if body and short and takes_more and takes_more[-1]:
            chunks[-1].extend(body)
        elif body:
            chunks.append(body)
            takes_more.append(True)
        pending.clear()
        size = n_words = n_clean = 0
        listing = False

    last = len(kinds) - 1
    for i, kind in enumerate(kinds):
        if kind == BLANK_LINE:
            continue
        if kind == BLOCK:
            close(False)
            chunks.append([i])
            takes_more.append(bool(wrapped[i]))
            continue
        if kind == HEADING:
            close(False)
            add(i)
            continue
        if pending and listing != (kind == BULLET):
            close(True)
        listing = listing or kind == BULLET
        fits = size + sizes[i] <= MAX_CHUNK_SIZE
        if size > 0 and not fits and size >= MIN_CHUNK_SIZE:
            close(True)
            add(i)
        elif size > 0 and fits:
            add(i)
            if ends[i] and n_words >= MIN_CHUNK_WORDS and i < last and opens[i + 1]:
                close(False)
        else:
            add(i)
    close(True)
    return chunks


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def pack_lines(
    kinds: pd.Series,
    sizes: pd.Series,
    words: pd.Series,
    clean_words: pd.Series,
    ends: pd.Series,
    opens: pd.Series,
    wrapped: pd.Series,
) -> pd.Series:
    facts = zip(kinds, sizes, words, clean_words, ends, opens, wrapped)
    return pd.Series([_pack(*[column.tolist() for column in row]) for row in facts], dtype=object)


def _bare(line: Column) -> Column:
    """A line without its heading, bullet and number marks, in that order."""
    line = F.regexp_replace(line, r"(?U)^#{1,6}\s+", "")
    line = F.regexp_replace(line, r"(?U)^[•·\-*+]\s+", "")
    return F.regexp_replace(line, r"(?U)^\d+\.\s+", "")


def _facts(line: Column) -> Column:
    is_block, is_heading = F.contains(line, F.lit("<pai>")), line.startswith("#")
    kind = (
        F.when(line == "", F.lit(BLANK_LINE))
        .when(is_block, F.lit(BLOCK))
        .when(is_heading, F.lit(HEADING))
        .when(line.rlike(BULLET_MARK), F.lit(BULLET))
        .otherwise(F.lit(PLAIN))
    )
    body = F.when(is_heading & ~is_block, strip(F.regexp_replace(line, "^#+", ""))).otherwise(line)
    return F.struct(
        kind.alias("kind"),
        F.length(body).alias("size"),
        count_words(body).alias("words"),
        count_words(_bare(body)).alias("clean_words"),
        line.rlike(r"[.!?]$").alias("ends"),
        line.rlike(r"(?U)^(?:\p{Upper}|[#\-•·*])").alias("opens"),
        line.startswith("<p>").alias("wrapped"),
        F.when(is_block, line).otherwise(_bare(body)).alias("bare"),
        is_block.alias("is_block"),
    )


def with_chunks(docs: DataFrame, lines: str = "lines", chunks: str = "chunks") -> DataFrame:
    """Adds `chunks`: array of `<p>…</p>` texts and `<pai>` lines. `lines` are those of `normalize_paragraphs`."""
    known = F.coalesce(F.col(lines), F.array().cast("array<string>"))
    df = with_pinned(docs, _f=F.transform(known, _facts))
    names = ("kind", "size", "words", "clean_words", "ends", "opens", "wrapped")
    df = df.withColumn("_packed", pack_lines(*[F.col("_f")[n] for n in names]))

    def text(numbers: Column) -> Column:
        # A block line that begins with <p> can take more text; it then loses its own wrapping.
        first = F.get(F.col("_f"), F.get(numbers, F.lit(0)))
        inner = F.when(first["is_block"], F.substring(first["bare"], F.lit(4), F.length(first["bare"]) - 7)).otherwise(first["bare"])
        rest = F.transform(F.slice(numbers, 2, F.size(numbers)), lambda n: F.get(F.col("_f"), n)["bare"])
        body = collapse_blanks(F.array_join(F.concat(F.array(inner), rest), " "))
        wrapped = F.concat(F.lit("<p>"), body, F.lit("</p>"))
        return F.when(first["is_block"] & (F.size(numbers) == 1), first["bare"]).otherwise(wrapped)

    return df.withColumn(chunks, F.transform("_packed", text)).drop("_f", "_packed")


def chunk_text(chunks: Column) -> Column:
    """The chunks as one tagged text."""
    return F.array_join(chunks, "\n\n")


def extract_chunks(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """(keys…, chunk_order, chunk, original_tag_type) of `<p>` and `<pai>` bodies. Blank bodies still use up an order."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?is)<(p|pai)>(.*?)</\1>"), F.lit(0))
    rows = docs.select(*keys, F.posexplode(found).alias("chunk_order", "m"))
    # The tag is found once more in the match, whose two marks have its length and five signs.
    tag = F.regexp_extract("m", r"(?i)^<(p|pai)>", 1)
    body = F.substring("m", F.length(tag) + 3, F.length("m") - 2 * F.length(tag) - 5)
    return with_pinned(rows, chunk=collapse_blanks(body)).select(
        *keys,
        "chunk_order",
        "chunk",
        F.lower(tag).alias("original_tag_type"),
    ).where(F.col("chunk") != "")
