"""Table functions for SQL: what a text column holds, as rows of a lateral join.

Each call sees one text, so Spark spreads the work with the rows of the table it is joined to.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lodestack.operators.documents import CONTEXT_LINES, text_spans


@udtf(returnType="kind string, number int, start_pos int, end_pos int, line_number int, inner_item boolean, original_match string, before array<string>, after array<string>")
class TextItems:
    """The images, pipe tables and HTML tables of one text, numbered from 1 in that order; none for a null text."""

    def eval(self, text: str) -> Iterator[tuple]:
        lines = [] if text is None else text.split("\n")
        for number, (kind, start, end, line, inner) in enumerate(text_spans(text), 1):
            match = text[start:end]
            below = line + 1 + (0 if kind == "image" else match.count("\n"))
            yield kind, number, start, end, line, inner, match, lines[max(line - CONTEXT_LINES, 0) : line], lines[below : below + CONTEXT_LINES]


def register_table_functions(spark: SparkSession) -> None:
    """Makes `text_items(text)` known to the session's SQL."""
    spark.udtf.register("text_items", TextItems)
