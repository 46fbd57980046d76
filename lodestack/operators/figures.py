"""Figures of a layout analysis: boxes in points, and image links spliced into the text.

Input rows have `analysis` struct<content, figures array<struct<id, boundingRegions, spans>>, pages array<struct<unit,
width, height>>> and optionally `page_points` array<struct<width, height>>, the true page sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.documents import splice

POINTS_PER_INCH = 72.0


def _scale(page: Column, points: Column, side: str) -> Column:
    unit = F.lower(F.coalesce(page["unit"], F.lit("")))
    sized = (page["width"] > 0) & (page["height"] > 0) & points.isNotNull()
    return (
        F.when(unit.isin("point", "points"), F.lit(1.0))
        .when(unit.isin("pixel", "pixels") & sized, points[side] / page[side])
        .otherwise(F.lit(POINTS_PER_INCH))
    )


def figures(docs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Usable figures: (keys…, figure_no, figure_id, page, polygon, spans, analysed page, page size). Only the first
    region counts; a page outside the document or fewer than 8 numbers drops the figure."""
    points = F.col("page_points") if "page_points" in docs.columns else F.lit(None).cast("array<struct<width:double,height:double>>")
    rows = docs.select(
        *keys,
        F.col("analysis.pages").alias("_pages"),
        points.alias("_points"),
        F.posexplode("analysis.figures").alias("figure_no", "_figure"),
    )
    region = F.get("_figure.boundingRegions", F.lit(0))
    number = F.when(F.coalesce(region["pageNumber"], F.lit(0)) == 0, F.lit(1)).otherwise(region["pageNumber"])
    page_count = F.coalesce(F.size("_points"), F.size("_pages"))
    named = F.coalesce(
        F.when(F.col("_figure.id") != "", F.col("_figure.id")), F.concat(F.lit("figure-"), (F.col("figure_no") + 1).cast("string"))
    )
    return (
        rows.withColumn("_region", region)
        .withColumn("page", number)
        .where(F.col("_region").isNotNull() & (F.col("page") >= 1) & (F.col("page") <= page_count))
        .where(F.size("_region.polygon") >= 8)
        .select(
            *keys,
            "figure_no",
            named.alias("figure_id"),
            "page",
            F.col("_region.polygon").alias("polygon"),
            F.col("_figure.spans").alias("spans"),
            F.get("_pages", F.col("page") - 1).alias("analysed_page"),
            F.get("_points", F.col("page") - 1).alias("points"),
        )
    )


def figure_boxes(docs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keys…, figure_no, figure_id, page, x0, y0, x1, y1) in points."""
    xs = F.filter("polygon", lambda _, i: i % 2 == 0)
    ys = F.filter("polygon", lambda _, i: i % 2 == 1)
    sx = _scale(F.col("analysed_page"), F.col("points"), "width")
    sy = _scale(F.col("analysed_page"), F.col("points"), "height")
    return figures(docs, keys).select(
        *keys,
        "figure_no",
        "figure_id",
        "page",
        (F.array_min(xs) * sx).alias("x0"),
        (F.array_min(ys) * sy).alias("y0"),
        (F.array_max(xs) * sx).alias("x1"),
        (F.array_max(ys) * sy).alias("y1"),
    )


def image_path(file_hash: Column, figure_id: Column, prefix: str = "images") -> Column:
    return F.concat(F.lit(f"{prefix}/"), file_hash, F.lit("/"), figure_id, F.lit(".png"))


def splice_figures(docs: DataFrame, keys: Sequence[str] = ("doc_id",), prefix: str = "images") -> DataFrame:
    """(keys…, text): each in-range span of a usable figure replaced by an image link on its own line.

    `docs` also carries `file_hash`, which names the image folder.
    """
    spans = figures(docs.select(*docs.columns), [*keys, "file_hash"]).select(
        *keys, "figure_no", "figure_id", "file_hash", F.posexplode("spans").alias("span_no", "span")
    )
    link = F.format_string("\n![%s](%s)\n", F.col("figure_id"), image_path(F.col("file_hash"), F.col("figure_id"), prefix))
    piece = F.struct(
        F.col("span.offset").alias("start"),
        # Spans that begin together are applied in figure order.
        F.struct((-F.col("figure_no")).alias("f"), (-F.col("span_no")).alias("s")).alias("order"),
        (F.col("span.offset") + F.col("span.length")).alias("end"),
        link.alias("value"),
    )
    wanted = (F.col("span.length") > 0) & (F.col("span.offset") >= 0)
    pieces = spans.where(wanted).groupBy(*keys).agg(F.collect_list(piece).alias("_pieces"))
    content = F.col("analysis.content")
    inside = F.filter("_pieces", lambda p: p["end"] <= F.length(content))
    text = F.when(F.col("_pieces").isNull(), content).otherwise(splice(content, inside))
    return docs.join(pieces, list(keys), "left").select(*keys, F.coalesce(text, F.lit("")).alias("text"))
