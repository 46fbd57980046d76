"""Structured agent responses: tolerant JSON extraction from text, and the rules a response must meet."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.text import strip

# Spellings read as a boolean.
BOOLEAN_WORDS = ("true", "false", "1", "0", "1.0", "0.0", "on", "off", "t", "f", "y", "n", "yes", "no")

# Fixed pattern: a flat object that holds the key `misleading`.
FLAT_OBJECT = r'(?s)\{[^{}]*"misleading"[^{}]*\}'


@dataclass(frozen=True)
class ResponseRule:
    """What a response object needs. `texts`, `objects` and the choice are optional but must have the right type."""

    booleans: Sequence[str] = ("misleading",)
    string_lists: Sequence[str] = ("reasoning",)
    choices: Sequence[str] = ()
    texts: Sequence[str] = ()
    objects: Sequence[str] = ()
    required_texts: Sequence[str] = ()


# Fields and response types per kind of agent.
RULES = {
    "db": ResponseRule(choices=("nl-sql", "nl-explore"), texts=("sql", "text")),
    "doc": ResponseRule(texts=("text",)),
    "viz": ResponseRule(
        choices=("viz-function", "viz-explore"), texts=("python_function", "text"), objects=("chart_specs",)
    ),
}


def two_keys(first: str, second: str) -> ResponseRule:
    """The rule of a response that needs two texts and nothing else."""
    return ResponseRule(booleans=(), string_lists=(), required_texts=(first, second))


def first_object(text: Column) -> Column:
    """From the first `{` to the `}` that balances it, counting braces blindly; null if there is none."""
    rest = F.substring(text, F.instr(text, "{"), F.length(text))
    pieces = F.regexp_extract_all(rest, F.lit(r"[^{}]*[{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("done"))

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(piece.endswith("{"), 1).otherwise(-1)
        moved = F.struct(
            depth.alias("depth"), (state["length"] + F.length(piece)).alias("length"), (depth == 0).alias("done")
        )
        return F.when(state["done"], state).otherwise(moved)

    end = F.aggregate(pieces, start, step)
    return F.when(F.contains(text, F.lit("{")) & end["done"], F.substring(rest, F.lit(1), end["length"]))


def _type_of(value: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))


def problem(value: Column, rule: ResponseRule) -> Column:
    """Why a parsed response (variant) breaks the rule; null if it does not."""

    def text_of(name: str) -> Column:
        return F.try_variant_get(value, f"$.{name}", "string")

    def all_of(name: str, kind: str) -> Column:
        items = F.try_variant_get(value, f"$.{name}", "array<variant>")
        typed = F.forall(items, lambda item: F.coalesce(F.schema_of_variant(item), F.lit("")).startswith(kind))
        return _type_of(value, name).startswith("ARRAY") & typed

    checks = [(F.schema_of_variant(value).startswith("OBJECT"), "not an object")]
    for name in rule.booleans:
        fine = F.lower(text_of(name)).isin(*BOOLEAN_WORDS) & ~_type_of(value, name).startswith("ARRAY")
        checks.append((fine, f"{name}: boolean required"))
    checks += [(all_of(name, "STRING"), f"{name}: list of strings required") for name in rule.string_lists]
    checks += [(_type_of(value, name) == "STRING", f"{name}: string required") for name in rule.required_texts]
    if rule.choices:
        kind = _type_of(value, "response_type")
        allowed = kind.isNull() | (kind == "VOID") | text_of("response_type").isin(*rule.choices)
        checks.append((allowed, "response_type: not an allowed value"))
    checks += [(_type_of(value, n).isNull() | (_type_of(value, n) == "STRING"), f"{n}: string expected") for n in rule.texts]
    checks += [(_type_of(value, n).isNull() | all_of(n, "OBJECT"), f"{n}: list of objects expected") for n in rule.objects]
    found = F.coalesce(*[F.when(~F.coalesce(fine, F.lit(False)), F.lit(text)) for fine, text in checks])
    return F.when(value.isNotNull(), found)


def json_candidates(message: Column) -> list[tuple[str, Column]]:
    """(how, JSON text) in the order they are tried."""
    text = strip(message)
    flat = F.regexp_extract(text, FLAT_OBJECT, 0)
    return [("direct", text), ("braces", first_object(text)), ("pattern", F.when(flat != "", flat))]
