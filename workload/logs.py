"""Agent logs, responses and grouped functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.responses import two_keys
from lodestack.operators import logs as lg
from lodestack.operators.udf import run_grouped_aggregate
from workload.registry import query, table


def event_lines(conversations: DataFrame) -> DataFrame:
    """Turns as log lines: assistant turns are agent messages, user turns start a thread, other turns are reasoning."""
    role = F.col("role")
    item = F.struct(F.when(role == "assistant", "agent_message").otherwise("reasoning").alias("type"), F.col("text"))
    event = F.struct(
        F.when(role == "user", "thread.started").otherwise("item.completed").alias("type"),
        F.when(role == "user", F.concat(F.lit("th-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))).alias("thread_id"),
        F.when(role != "user", item).alias("item"),
    )
    line = F.concat(F.lit("  "), F.to_json(event), F.lit(" "))
    return conversations.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), line.alias("value"))


@query("""
SELECT conv_id AS run_id, turn AS seq, CASE role WHEN 'user' THEN 'thread.started' ELSE 'item.completed' END AS type,
  CASE role WHEN 'user' THEN 'th-' || conv_id || '-' || turn END AS thread_id,
  CASE role WHEN 'assistant' THEN 'agent_message' WHEN 'user' THEN NULL ELSE 'reasoning' END AS item_type,
  CASE WHEN role <> 'user' THEN text END AS text FROM conversations""")
def parse_events(spark, sf_dir):
    lines = event_lines(table(spark, sf_dir, "conversations"))
    # Lines cut in half, as a killed process leaves them, and blank ones are dropped.
    broken = lines.withColumn("value", F.substring("value", F.lit(1), F.floor(F.length("value") / 2).cast("int")))
    blank = lines.withColumn("value", F.lit("  "))
    return lg.parse_events(lines.unionByName(broken).unionByName(blank))


@query("SELECT conv_id AS run_id, arg_max('th-' || conv_id || '-' || turn, turn) AS thread_id FROM conversations WHERE role = 'user' GROUP BY conv_id")
def thread_ids(spark, sf_dir):
    return lg.thread_ids(lg.parse_events(event_lines(table(spark, sf_dir, "conversations"))))


@query("SELECT conv_id AS run_id, arg_max(text, turn) AS final_message FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def final_message(spark, sf_dir):
    return lg.final_message(lg.parse_events(event_lines(table(spark, sf_dir, "conversations"))))


# A message per event: bare JSON, JSON in prose, braces before it, JSON of another shape, none.
BASE_SQL = """'{"misleading": ' || (value > 10)::VARCHAR || ', "reasoning": ["user ' || user_id || '"], "response_type": ' ||
 CASE WHEN user_id > 100 THEN 'null' WHEN user_id > 50 THEN '"nl-sql"' ELSE '"other"' END || ', "text": "' || event_type || '"}'"""
FINE_SQL = "user_id > 50"


def messages(events: DataFrame) -> DataFrame:
    user = F.col("user_id").cast("string")
    kind = F.when(F.col("user_id") > 100, "null").when(F.col("user_id") > 50, '"nl-sql"').otherwise('"other"')
    base = F.concat(
        F.lit('{"misleading": '), (F.col("value") > 10).cast("string"), F.lit(', "reasoning": ["user '), user,
        F.lit('"], "response_type": '), kind, F.lit(', "text": "'), F.col("event_type"), F.lit('"}'),
    )
    what = F.col("event_type")
    text = (
        F.when(what == "view", F.concat(F.lit("  "), base, F.lit("\n")))
        .when(what == "click", F.concat(F.lit("Answer: "), base, F.lit(" done }")))
        .when(what == "purchase", F.concat(F.lit("note {x} "), base))
        .when(what == "signup", F.col("props"))
        .otherwise(F.concat(F.lit("no object "), user))
    )
    return events.select("event_id", text.alias("text"), F.lit(1).alias("one"))


JSON_SQL = f"""
WITH b AS (SELECT event_id, event_type, props, user_id, {BASE_SQL} AS base FROM events),
p AS (SELECT *, CASE WHEN {FINE_SQL} THEN NULL ELSE 'response_type: not an allowed value' END AS bad FROM b)
SELECT event_id, CASE event_type WHEN 'view' THEN base WHEN 'click' THEN base WHEN 'purchase' THEN base WHEN 'signup' THEN props END AS json,
  CASE event_type WHEN 'view' THEN 'direct' WHEN 'click' THEN CASE WHEN {FINE_SQL} THEN 'braces' ELSE 'pattern' END WHEN 'purchase' THEN 'pattern'
    WHEN 'signup' THEN 'direct' END AS how,
  CASE event_type WHEN 'signup' THEN 'misleading: boolean required' WHEN 'error' THEN 'no JSON object found' ELSE bad END AS reason FROM p"""


@query(JSON_SQL)
def extract_json(spark, sf_dir):
    return lg.extract_json(messages(table(spark, sf_dir, "events"))).drop("text", "one")


@query(f"SELECT event_id, reason IS NULL AS valid, reason FROM ({JSON_SQL})")
def check_response(spark, sf_dir):
    return lg.check_response(messages(table(spark, sf_dir, "events")), "db").drop("text", "one")


# The rule for document answers has no choice of response types, so another type passes.
@query("""
SELECT event_id, event_type IN ('view', 'click', 'purchase') AS valid,
  CASE event_type WHEN 'signup' THEN 'misleading: boolean required' WHEN 'error' THEN 'no JSON object found' END AS reason FROM events""")
def check_doc_response(spark, sf_dir):
    checked = lg.check_response(messages(table(spark, sf_dir, "events")), "doc")
    return checked.select("event_id", "valid", "reason")


def pair_messages(events: DataFrame) -> DataFrame:
    """A question and an answer per event: whole, in prose, with a number for the answer, without a question, none."""
    user, what = F.col("user_id").cast("string"), F.col("event_type")
    question = F.concat(F.lit('{"question": "'), what, F.lit('", "answer": '))
    quoted = F.concat(question, F.lit('"'), user, F.lit('"}'))
    text = (
        F.when(what == "view", quoted)
        .when(what == "click", F.concat(F.lit("Reply: "), quoted, F.lit(" end")))
        .when(what == "purchase", F.concat(question, user, F.lit("}")))
        .when(what == "signup", F.concat(F.lit('{"answer": "'), user, F.lit('"}')))
        .otherwise(user)
    )
    return events.select("event_id", text.alias("text"))


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 'braces' ELSE 'direct' END AS how,
  event_type IN ('view', 'click') AS valid,
  CASE event_type WHEN 'purchase' THEN 'answer: string required' WHEN 'signup' THEN 'question: string required'
   WHEN 'error' THEN 'not an object' END AS reason FROM events""")
def check_pair_response(spark, sf_dir):
    pairs = lg.extract_json(pair_messages(table(spark, sf_dir, "events")), kind=two_keys("question", "answer"))
    return pairs.select("event_id", "how", F.col("reason").isNull().alias("valid"), "reason")


@query("""
SELECT l_returnflag, l_linestatus, 'points' AS type, count(*) AS n, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted_price,
  max(l_extendedprice) AS highest FROM lineitem GROUP BY ALL""")
def grouped_function(spark, sf_dir):
    def partial(frame):
        money, quantity = (frame.l_extendedprice * frame.l_quantity).sum(), frame.l_quantity.sum()
        return {"n": len(frame), "money": float(money), "quantity": float(quantity), "most": float(frame.l_extendedprice.max())}

    def merge(a, b):
        return {**{c: a[c] + b[c] for c in ("n", "money", "quantity")}, "most": max(a["most"], b["most"])}

    def chart(key, total):
        names = dict(zip(("l_returnflag", "l_linestatus"), key))
        return {**names, "type": "points", "n": total["n"], "weighted_price": round(total["money"] / total["quantity"], 4), "highest": total["most"]}

    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    schema = "l_returnflag string, l_linestatus string, type string, n bigint, weighted_price double, highest double"
    state = "n bigint, money double, quantity double, most double"
    return run_grouped_aggregate(rows, ["l_returnflag", "l_linestatus"], partial, merge, chart, state, schema)
