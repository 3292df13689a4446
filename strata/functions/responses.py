"""JSON objects within free text, such as a model's answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields of an answer and what stands for a missing one.
DEFAULTS: dict[str, object] = {
    "purpose": "Unknown",
    "complexity_level": "moderate",
    "abstraction_level": "medium",
    "has_documentation": False,
    "has_type_hints": False,
    "code_smell_indicators": [],
    "is_helper_function": False,
    "is_duplicative": False,
    "could_be_inlined": False,
    "usage_pattern": "Unknown",
    "deletion_likelihood": "medium",
    "deletion_reasons": [],
    "detailed_analysis": "",
}


def _kind(v: object) -> str:
    return "boolean" if isinstance(v, bool) else "array<string>" if isinstance(v, list) else "string"


def json_block(text: Column) -> Column:
    """What a ```json fence holds, else from the first { to the last }; null without either."""
    fenced = F.regexp_extract(text, r"(?s)```json(.*?)(?:```|\z)", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.nullif(F.trim(F.when(text.contains("```json"), fenced).otherwise(braces)), F.lit(""))


def parse_response(text: Column) -> Column:
    """The answer's fields as a struct, defaults for missing ones, and `parsed`: false where there is no JSON object."""
    schema = ", ".join(f"{k} {_kind(v)}" for k, v in DEFAULTS.items()) + ", _broken string"
    block = json_block(text)
    made = F.from_json(block, schema, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"})
    ok = block.isNotNull() & made.isNotNull() & made["_broken"].isNull()
    lit = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.lit(v)
    return F.struct(*[F.coalesce(F.when(ok, made[k]), lit(v)).alias(k) for k, v in DEFAULTS.items()], F.coalesce(ok, F.lit(False)).alias("parsed"))
