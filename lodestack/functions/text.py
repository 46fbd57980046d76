"""Text expressions on columns: cleaning, counting, table text and rendered blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blank characters under (?U): Unicode white space and the four separators that count as white space too.
BLANK = r"[\s\x1c-\x1f]"
# The same characters one by one, in order.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def collapse_blanks(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"(?U){BLANK}+", " "))


def words(text: Column) -> Column:
    """Blank-separated words."""
    return F.filter(F.split(text, rf"(?U){BLANK}+"), lambda word: word != "")


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def clean_markup(text: Column) -> Column:
    """Without comments, empty `<p>`, runs of blank lines and trailing blanks, removed in this order.

    The four patterns are fixed values, but for the possessive forms that keep long runs of blanks linear.
    """
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, rf"(?U)<p>{BLANK}*</p>", "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"(?md)(?<![ \t])[ \t]++$", "")


def truncate_text(text: Column, limit: int = 3000) -> Column:
    cut = F.concat(F.substring(text, 1, limit), F.lit("\n... [truncated]"))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def strip_tags(text: Column, replacement: str = "") -> Column:
    return F.regexp_replace(text, r"<[^>]+>", replacement)


def html_table_text(html: Column) -> Column:
    """Cells marked and separated by bars, one row per line, other tags dropped. Tag names match in lower case only."""
    text = F.regexp_replace(html, r"<th[^>]*>", " [Header] ")
    text = F.regexp_replace(text, r"<td[^>]*>", " [Cell] ")
    text = F.regexp_replace(text, r"</t[hd]>", " | ")
    return strip_tags(F.replace(text, F.lit("</tr>"), F.lit("\n")))


def preview(text: Column, limit: int = 40) -> Column:
    """First words of the text without tags."""
    return F.array_join(F.slice(words(strip_tags(text, " ")), 1, limit), " ")


def table_fallback(context: Column, content: Column) -> Column:
    """The block for a table nobody described: previews of its surroundings and of itself, when not blank."""
    parts = F.array(F.lit("<pai>[Table: content preserved]"), preview(context), preview(content), F.lit("</pai>"))
    return F.array_join(F.filter(parts, lambda part: part != ""), " ")


def _listed(label: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(values, ", "))).otherwise(F.lit(""))


def render_image(identifier: Column, analysis: Column) -> Column:
    """The block for an image. `analysis` is struct<is_logo, logo_of, description, key_elements>, null if it failed."""
    logo = F.format_string(
        "<pai>[Logo: %s] %s</pai>", F.coalesce(analysis["logo_of"], F.lit("None")), analysis["description"]
    )
    plain = F.concat(
        F.lit("<pai>"), analysis["description"], _listed(" Key elements: ", analysis["key_elements"]), F.lit("</pai>")
    )
    missing = F.concat(F.lit("<pai>[Image: "), identifier, F.lit("]</pai>"))
    return F.when(analysis.isNull(), missing).when(analysis["is_logo"], logo).otherwise(plain)


def render_table(analysis: Column, fallback: Column) -> Column:
    """The block for a table. `analysis` is struct<title, purpose, summary, key_data>, null if it failed."""
    title = F.when(F.coalesce(analysis["title"], F.lit("")) != "", F.concat(F.lit(": "), analysis["title"]))
    block = F.concat(
        F.lit("<pai>[Table"),
        F.coalesce(title, F.lit("")),
        F.lit("] "),
        F.concat_ws(" ", analysis["purpose"], analysis["summary"]),
        _listed(" Key data points: ", analysis["key_data"]),
        F.lit("</pai>"),
    )
    return F.when(analysis.isNull(), fallback).otherwise(block)


def substring_count(text: Column, part: Column) -> Column:
    """How often `part` occurs in `text` without overlap; 0 for an empty part."""
    gone = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) > 0, F.floor(gone / F.length(part))).otherwise(F.lit(0)).cast("bigint")


def query_tokens(query: Column) -> Column:
    """Distinct lower-case blank-separated words."""
    return F.array_distinct(words(F.lower(query)))


def text_score(text: Column, query: Column) -> Column:
    """Sum over the query's tokens of their substring counts in the lower-case text."""
    lower = F.lower(text)
    return F.aggregate(query_tokens(query), F.lit(0).cast("bigint"), lambda n, t: n + substring_count(lower, t))


def single_json(text: Column) -> Column:
    """The text as a variant if it is one JSON value and nothing else, otherwise null.

    The parser stops after the first value. Within a list and as a member of an object nothing may follow it.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(listed.isNotNull() & member.isNotNull(), F.try_parse_json(text))
