"""Document text: items (images, tables), their replacement, paragraph merging and logo deduplication.

A document is one row. All steps but `item_spans` are native expressions inside that row, so none of them shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions.rows import with_pinned
from lodestack.functions.text import BLANK, html_table_text, render_image, render_table, strip, table_fallback, truncate_text

CONTEXT_LINES = 5

# Fixed patterns, in scan order: image link, pipe table, HTML table.
IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
PIPE_TABLE = r"(\|[^\n]+\|\n(?:\|[-:\s]+\|\n)?(?:\|[^\n]+\|\n)+)"
HTML_TABLE = r"(?is)<table[^>]*>.*?</table>"
SCAN_ORDER = (("image", re.compile(IMAGE)), ("pipe", re.compile(PIPE_TABLE)), ("html", re.compile(HTML_TABLE)))

# Fixed pattern: lines that begin like this are never merged into the line before.
STRUCTURAL = r"<pai>|[#\-•·*]|[123]\."
SHORT_LINE = 40

ITEM_SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("line", T.IntegerType()),
            T.StructField("inner", T.BooleanType()),
        ]
    )
)


def text_spans(text: str | None) -> list[tuple]:
    if text is None:
        return []
    found = []
    for kind, pattern in SCAN_ORDER:
        at, line = 0, 0
        for match in pattern.finditer(text):
            line += text.count("\n", at, match.start())
            at = match.start()
            found.append([kind, match.start(), match.end(), line, False])
    reach = -1
    for span in sorted(found, key=lambda s: (s[1], -s[2])):
        span[4] = span[1] < reach
        reach = max(reach, span[2])
    return [tuple(span) for span in found]


@F.pandas_udf(ITEM_SPANS)
def item_spans(texts: pd.Series) -> pd.Series:
    """Where the items of each text are, in scan order; Spark's own regex functions give no offsets."""
    return texts.map(text_spans)


def with_items(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `items`: an array of structs in text order. `inner` marks an item that begins inside an earlier one."""
    whole = with_pinned(docs, **{text: F.col(text)})
    located = with_pinned(whole.withColumn("_spans", item_spans(text)), _lines=F.split(text, "\n"))

    def item(span: Column, rank: Column) -> Column:
        match = F.substring(F.col(text), span["start"] + 1, span["end"] - span["start"])
        is_image = span["kind"] == "image"
        path = F.regexp_replace(F.regexp_extract(match, IMAGE, 2), "/+$", "")
        number = (rank + 1).cast("string")
        name = (
            F.when(is_image, F.substring_index(path, "/", -1))
            .when(span["kind"] == "pipe", F.concat(F.lit("table-"), number))
            .otherwise(F.concat(F.lit("table-html-"), number))
        )
        height = F.when(is_image, F.lit(0)).otherwise(F.length(match) - F.length(F.replace(match, F.lit("\n"), F.lit(""))))
        before = F.least(span["line"], F.lit(CONTEXT_LINES))
        return F.struct(
            span["start"].alias("start_pos"),
            span["end"].alias("end_pos"),
            F.when(is_image, F.lit("image")).otherwise(F.lit("table")).alias("item_type"),
            name.alias("identifier"),
            F.when(is_image, name).when(span["kind"] == "html", html_table_text(match)).otherwise(match).alias("content"),
            F.slice(F.col("_lines"), span["line"] - before + 1, before).alias("context_before"),
            F.slice(F.col("_lines"), span["line"] + height + 2, CONTEXT_LINES).alias("context_after"),
            match.alias("original_match"),
            span["line"].alias("line_number"),
            span["inner"].alias("inner"),
        )

    return with_pinned(located, items=F.array_sort(F.transform("_spans", item))).drop("_spans", "_lines")


def find_items(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per image or table, in text order within a document."""
    return with_items(docs, text).select(*keys, F.inline("items"))


def item_prompt(item_type: Column, identifier: Column, content: Column, before: Column, after: Column, rules: Column) -> Column:
    """Text for batch inference: the context around a marker, what the item is, then the caller's rules."""
    marker = F.when(item_type == "image", F.lit("[IMAGE HERE]")).otherwise(F.lit("[TABLE HERE]"))
    context = F.concat(F.lit("Context:\n"), F.array_join(F.concat(before, F.array(marker), after), "\n"))
    subject = F.when(item_type == "image", F.concat(F.lit("Image reference: "), identifier)).otherwise(
        F.concat(F.lit("Table content:\n"), truncate_text(content))
    )
    return F.concat_ws("\n\n", context, subject, rules)


def fallback_block(item: Column) -> Column:
    """The replacement for an item nobody described."""
    context = F.array_join(F.concat(item["context_before"], item["context_after"]), " ")
    image = F.concat(F.lit("<pai>[Image: "), item["identifier"], F.lit("]</pai>"))
    return F.when(item["item_type"] == "image", image).otherwise(table_fallback(context, item["content"]))


def render_items(items: DataFrame) -> DataFrame:
    """Adds `replacement` to item rows that carry the optional structs `image_analysis` and `table_analysis`."""
    context = F.array_join(F.concat("context_before", "context_after"), " ")
    image = render_image(F.col("identifier"), F.col("image_analysis"))
    table = render_table(F.col("table_analysis"), table_fallback(context, F.col("content")))
    return items.withColumn("replacement", F.when(F.col("item_type") == "image", image).otherwise(table))


def splice(text: Column, pieces: Column) -> Column:
    """`text` with each piece's [start, end) replaced by its `value`, from the last piece to the first.

    `pieces` is array<struct<start, order, end, value>>; among equal starts the smallest `order` is applied last.
    """

    def put(body: Column, piece: Column) -> Column:
        tail = F.substring(body, piece["end"] + 1, F.length(body))
        return F.concat(F.substring(body, F.lit(1), piece["start"]), piece["value"], tail)

    return F.aggregate(F.reverse(F.array_sort(pieces)), text, put)


def splice_nested(text: Column, pieces: Column) -> Column:
    """`text` with its pieces replaced from the first to the last, none of them lost.

    `pieces` is array<struct<start, order, end, value>>, the widest first among equal starts. A piece that begins inside the stretch replaced
    before it puts its value on a line of its own after that stretch's, and the stretch reaches to the later end of the two.
    """

    def put(state: Column, piece: Column) -> Column:
        inside = piece["start"] < state["reach"]
        between = F.substring(text, state["reach"] + 1, piece["start"] - state["reach"])
        return F.struct(
            F.concat(state["body"], F.when(inside, F.lit("\n")).otherwise(between), piece["value"]).alias("body"),
            F.greatest(state["reach"], piece["end"]).alias("reach"),
        )

    start = F.struct(F.lit("").alias("body"), F.lit(0).alias("reach"))
    return F.aggregate(
        F.array_sort(pieces), start, put, lambda state: F.concat(state["body"], F.substring(text, state["reach"] + 1, F.length(text)))
    )


def _piece(item: Column, value: Column, strict: bool) -> Column:
    start, end = item["start_pos"], item["end_pos"]
    order = F.lit(0) if strict else -end
    return F.struct(start.alias("start"), order.alias("order"), end.alias("end"), value.alias("value"))


def splice_fallbacks(docs: DataFrame, text: str = "text", strict: bool = False) -> DataFrame:
    """Replaces the `items` of `with_items` by their fallback blocks, within the row.

    The block of an image inside a table follows the table's. `strict=True` splices it twice instead, by its place in the
    text that the table's block has replaced.
    """
    pieces = F.transform("items", lambda item: _piece(item, fallback_block(item), strict))
    spliced = splice(F.col(text), pieces) if strict else splice_nested(F.col(text), pieces)
    return with_pinned(docs, **{text: spliced})


def apply_replacements(
    docs: DataFrame, replaced: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", strict: bool = False
) -> DataFrame:
    """Splices the `replacement` of item rows back into their documents, those inside another item after it (see `splice_fallbacks`).

    Only the replacements are grouped. A document without any keeps its text.
    """
    item = F.struct("start_pos", "end_pos")
    pieces = replaced.groupBy(*keys).agg(F.collect_list(_piece(item, F.col("replacement"), strict)).alias("_pieces"))
    joined = docs.join(pieces, list(keys), "left")
    put = splice if strict else splice_nested
    spliced = F.when(F.col("_pieces").isNull(), F.col(text)).otherwise(put(F.col(text), F.col("_pieces")))
    return joined.withColumn(text, spliced).drop("_pieces")


def normalized_text(text: Column) -> Column:
    """Trimmed non-blank lines, `<p>` unwrapped, with continuation lines merged in three passes.

    Whether a line joins the one before depends on that line of the same pass only, so a pass is one replacement of the
    line breaks that go: after a colon or intro word, inside a split sentence, and before a short fragment.
    """
    inline_blank = r"[\s\x1c-\x1f&&[^\n]]"
    free = rf"(?!{STRUCTURAL})"
    text = strip(F.regexp_replace(text, rf"(?U)(?<!{BLANK}){inline_blank}*+\n{BLANK}*+", "\n"))
    text = F.regexp_replace(text, rf"(?Umd)^(?i:<p>)(?!.*<pai>){inline_blank}*(.*?){inline_blank}*(?i:</p>)$", "$1")
    # Patterns that begin with the line break let the search skip all other characters.
    text = F.regexp_replace(text, rf"\n(?<=(?i:Highlights|Overview|Summary|:)\n){free}", " ")
    text = F.regexp_replace(text, rf"(?md)^({free}.*)(?<![.!?;])\n{free}", "$1 ")
    return F.regexp_replace(text, rf"(?md)^(?!<pai>)(.*)\n{free}(?=.{{0,{SHORT_LINE - 1}}}$)", "$1 ")


def normalize_paragraphs(docs: DataFrame, text: str = "text", lines: str = "lines") -> DataFrame:
    """Adds `lines`, the lines of `normalized_text`."""
    return with_pinned(docs, **{lines: F.split(normalized_text(F.col(text)), "\n")})


def dedupe_logos(docs: DataFrame, lines: str = "lines") -> DataFrame:
    """Keeps the first logo line per name (trimmed, any case) in each document; other lines stay."""
    logo = r"(?i)^<pai>\s*\[logo:\s*([^\]]+)\]"

    def name(line: Column) -> Column:
        found = F.contains(F.lower(line), F.lit("logo:")) & strip(line).rlike(logo)
        return F.when(found, strip(F.lower(F.regexp_extract(strip(line), logo, 1))))

    def first_or_other(line: Column, at: Column) -> Column:
        mine = F.get(F.col("_names"), at)
        return mine.isNull() | (F.array_position(F.col("_names"), mine) == at + 1)

    named = with_pinned(docs, _names=F.transform(lines, name))
    return with_pinned(named, **{lines: F.filter(lines, first_or_other)}).drop("_names")
