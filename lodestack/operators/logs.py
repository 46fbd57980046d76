"""Agent logs: events of a run, its final message, and responses read from messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.responses import RULES, ResponseRule, json_candidates, problem
from lodestack.functions.rows import with_pinned
from lodestack.functions.text import single_json
from lodestack.sources.files import parse_json_lines

EVENT_SCHEMA = "type string, thread_id string, item struct<type: string, text: string>"


def parse_events(lines: DataFrame, line: str = "value") -> DataFrame:
    """Log lines (run_id, seq, value) as (run_id, seq, type, thread_id, item_type, text)."""
    events = parse_json_lines(lines, EVENT_SCHEMA, line)
    return events.select(
        "run_id", "seq", "event.type", "event.thread_id", F.col("event.item.type").alias("item_type"), "event.item.text"
    )


def thread_ids(events: DataFrame) -> DataFrame:
    """(run_id, thread_id): the last non-empty id a run announced."""
    started = events.where((F.col("type") == "thread.started") & (F.coalesce("thread_id", F.lit("")) != ""))
    return started.groupBy("run_id").agg(F.max_by("thread_id", "seq").alias("thread_id"))


def is_agent_message() -> Column:
    return (F.col("type") == "item.completed") & (F.col("item_type") == "agent_message")


def final_message(events: DataFrame, by: Sequence[str] = ("run_id",), order: str = "seq") -> DataFrame:
    """(by…, final_message): the text of the last completed agent message."""
    return events.where(is_agent_message()).groupBy(*by).agg(F.max_by("text", order).alias("final_message"))


def extract_json(messages: DataFrame, message: str = "text", kind: str | ResponseRule = "db") -> DataFrame:
    """Adds json, how and reason to messages.

    Tried in order: the whole trimmed text, the first balanced object, a flat object holding `misleading`. Whole text
    that is JSON is final even if it breaks the rule; a balanced object that does falls through to the last form.
    """
    rule = RULES[kind] if isinstance(kind, str) else kind
    df, open_case = messages, F.lit(True)
    for how, text in json_candidates(F.col(message)):
        # A later form is only looked at where the earlier ones gave no answer.
        df = with_pinned(df, **{f"_{how}": F.when(open_case, text)})
        df = with_pinned(df, **{f"_{how}_value": single_json(F.col(f"_{how}"))})
        df = with_pinned(df, **{f"_{how}_problem": problem(F.col(f"_{how}_value"), rule)})
        answered = F.col(f"_{how}_value").isNotNull()
        if how != "direct":
            answered = answered & F.col(f"_{how}_problem").isNull()
        open_case = open_case & ~answered

    def parsed(how: str) -> Column:
        return F.col(f"_{how}_value").isNotNull()

    def fine(how: str) -> Column:
        return parsed(how) & F.col(f"_{how}_problem").isNull()

    how = (
        F.when(parsed("direct"), "direct").when(fine("braces"), "braces").when(F.col("_pattern").isNotNull(), "pattern")
    )
    df = df.withColumn("how", how)
    chosen = {name: (F.col("how") == name) for name in ("direct", "braces", "pattern")}
    reason = F.when(F.col("how").isNull(), F.lit("no JSON object found"))
    text = F.lit(None).cast("string")
    for name, picked in chosen.items():
        reason = reason.when(picked & ~parsed(name), F.lit("invalid JSON")).when(picked, F.col(f"_{name}_problem"))
        text = F.when(picked & parsed(name), F.col(f"_{name}")).otherwise(text)
    return df.select(*messages.columns, text.alias("json"), "how", reason.alias("reason"))


def check_response(messages: DataFrame, kind: str | ResponseRule = "db", message: str = "text") -> DataFrame:
    """Adds valid and reason: whether the message holds a response of this kind."""
    checked = extract_json(messages, message, kind)
    return checked.select(*messages.columns, F.col("reason").isNull().alias("valid"), "reason")
