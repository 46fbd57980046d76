"""Read-only SQL over registered tables."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from lodestack.sources.tables import TableSet

# First words that mean a write. They only set the risk level; whether a query passes is decided by analysis.
WRITE_WORDS = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "VACUUM", "ATTACH", "REINDEX", "CREATE", "REPLACE")
# Functions that call code of the virtual machine.
CALLS = ("reflect", "java_method", "try_reflect")


def open_database(spark: SparkSession, folder: str, names: list[str] | None = None) -> SparkSession:
    """A session of its own in which the folder's tables are the only relations: files are no tables there, and tables of
    equal names in other databases are not seen."""
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    TableSet.from_folder(session, folder, names).register()
    return session


def _without_texts(sql: str) -> str:
    """The statement without its string literals, quoted names and comments."""
    return re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)


def _calls_code(sql: str) -> bool:
    return re.search(rf"(?i)(?:^|[^\w])`?(?:{'|'.join(CALLS)})`?\s*\(", _without_texts(sql)) is not None


def _foreign_relations(df: DataFrame) -> list[str]:
    """Relations of the analysed plan that no view of the session stands for."""
    found, open_nodes = [], [df._jdf.queryExecution().analyzed()]
    while open_nodes:
        node = open_nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "View":
            continue
        if "Relation" in kind and kind not in ("OneRowRelation", "LocalRelation", "CTERelationRef", "CTERelationDef"):
            found.append(str(node.simpleString(60)))
        for children in (node.children(), node.innerChildren()):
            open_nodes += [n for n in (children.apply(i) for i in range(children.size())) if hasattr(n, "children")]
    return found


def _wrapped(sql: str) -> str:
    """As a subquery only a row-returning statement parses, so commands hidden after WITH or FROM are refused too."""
    return f"SELECT * FROM (\n{sql}\n) q"


def _trimmed(sql: str) -> str:
    text = (sql or "").strip()
    if not text:
        raise ValueError("no statement: the text is empty")
    return text[:-1].rstrip() if text.endswith(";") else text


def validate_sql(spark: SparkSession, sql: str) -> dict[str, object]:
    """is_valid, risk_level (low, medium, high), query_type and, if refused, the error. Nothing is executed.

    `spark` is a session of `open_database`.
    """
    text = _trimmed(sql)
    verdict: dict[str, object] = {"query_type": text.upper().split(" ", 1)[0]}
    if text.upper().startswith(WRITE_WORDS):
        return {**verdict, "is_valid": False, "risk_level": "high", "error": "the statement would change data"}
    if _calls_code(text):
        return {**verdict, "is_valid": False, "risk_level": "high", "error": f"not callable here: {', '.join(CALLS)}"}
    try:
        foreign = _foreign_relations(spark.sql(_wrapped(text)))
        if foreign:
            return {**verdict, "is_valid": False, "risk_level": "high", "error": f"no table of this database: {foreign[0]}"}
    except (ParseException, AnalysisException) as error:
        return {**verdict, "is_valid": False, "risk_level": "medium", "error": str(error)}
    return {**verdict, "is_valid": True, "risk_level": "low", "error": None}


def run_readonly_sql(spark: SparkSession, sql: str) -> DataFrame:
    """The query as a DataFrame, or ValueError with the reason it was refused."""
    verdict = validate_sql(spark, sql)
    if not verdict["is_valid"]:
        raise ValueError(str(verdict["error"]))
    return spark.sql(_trimmed(sql))
