"""Documents end to end: markup to chunks, and chunks into the vector store and its mapping."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.rows import with_pinned
from lodestack.functions.text import clean_markup
from lodestack.operators.chunks import chunk_text, extract_chunks, with_chunks
from lodestack.operators.documents import (
    apply_replacements,
    dedupe_logos,
    normalize_paragraphs,
    render_items,
    splice_fallbacks,
    with_items,
)
from lodestack.operators.metadata import upsert_mappings
from lodestack.operators.similarity import check_vector_size, nearest_above, reuse_records
from lodestack.session import cut_lineage


def chunk_documents(
    docs: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    text: str = "text",
    analyses: DataFrame | None = None,
    strict: bool = False,
) -> DataFrame:
    """Adds processed, total_items, images_count and tables_count to documents.

    `analyses` holds (keys…, identifier, image_analysis, table_analysis). Without it every item gets its fallback block
    and the whole plan stays within the row: one scan, no shuffle.
    """
    cleaned = docs.withColumn(text, clean_markup(F.col(text)))
    items = with_items(cleaned, text)
    counted = items.withColumns(
        {
            "total_items": F.size("items"),
            "images_count": F.size(F.filter("items", lambda i: i["item_type"] == "image")),
            "tables_count": F.size(F.filter("items", lambda i: i["item_type"] == "table")),
        }
    )
    if analyses is None:
        spliced = splice_fallbacks(counted, text, strict)
    else:
        found = counted.select(*keys, F.inline("items")).join(analyses, [*keys, "identifier"], "left")
        spliced = apply_replacements(counted, render_items(found), keys, text, strict)
    lines = dedupe_logos(normalize_paragraphs(spliced.drop("items"), text))
    chunked = with_chunks(lines)
    return chunked.withColumn("processed", chunk_text(F.col("chunks"))).drop("lines", "chunks")


def document_counts(items: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keys…, total_items, images_count, tables_count) from item rows."""
    kind = F.col("item_type")
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(kind == "image").alias("images_count"),
        F.count_if(kind == "table").alias("tables_count"),
    )


def ingest_counts(records: DataFrame, keys: Sequence[str] = ("file_hash",)) -> DataFrame:
    """(keys…, total_chunks, inserted_chunks, reused_chunks) from ingest records."""
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.count_if(~F.col("reused")).alias("inserted_chunks"),
        F.count_if("reused").alias("reused_chunks"),
    )


@dataclass(frozen=True)
class Ingested:
    """Tables after an ingest: new records, all points, all mappings."""

    records: DataFrame
    points: DataFrame
    mappings: DataFrame


def ingest_chunks(
    docs: DataFrame,
    points: DataFrame,
    mappings: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    vector_size: int,
    threshold: float = 0.95,
    scope: Sequence[str] = (),
    text: str = "processed",
) -> Ingested:
    """Chunks of `docs` (file_hash, scope…, tagged text) against `points` (chunk_id, scope…, vector) and `mappings`.

    A chunk with a stored neighbour at cosine ≥ threshold reuses its id, any other becomes a point. `embed` adds
    `vector` to rows with a `text` column. Chunks of one batch are not compared with each other. They are read, embedded and
    written to the shared folder once, as the search for neighbours, the records and the mappings all need them.
    """
    keys = ["file_hash", *scope]
    chunks = extract_chunks(docs, keys, text).withColumnRenamed("chunk", "text")
    vectors = check_vector_size(with_pinned(embed(chunks), vector=F.col("vector")), vector_size)
    new = cut_lineage(vectors).withColumn("new_id", F.concat_ws("-", "file_hash", F.col("chunk_order").cast("string")))
    stored = points.select(F.col("chunk_id").alias("stored_id"), *scope, "vector")
    records = reuse_records(new, nearest_above(new, stored, threshold, scope))
    added = records.where(~F.col("reused")).select(points.columns)
    mapped = records.select(
        F.col("file_hash").alias("input_file_hash"), "chunk_order", F.col("text").alias("chunk"), "chunk_id", "original_tag_type"
    )
    return Ingested(records, points.unionByName(added), upsert_mappings(mappings, mapped))
