"""Columns over source text: names, lines, docstrings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def last_component(name: Column | str) -> Column:
    """`method` of `Class.method`."""
    name = F.col(name) if isinstance(name, str) else name
    return F.element_at(F.split(name, r"\."), -1)


def regex(pattern: str, ignore_case: bool = False, multiline: bool = False, dot_all: bool = False) -> str:
    """A pattern with the meaning it has in Python: Unicode classes, and only LF ends a line."""
    return f"(?dU{'iu' if ignore_case else ''}{'m' if multiline else ''}{'s' if dot_all else ''}){pattern}"


def matches_any(text: Column, patterns: list[str], **flags: bool) -> Column:
    """Whether one of the patterns is found; false for a null text."""
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(regex(p, **flags))
    return F.coalesce(found, F.lit(False))


def contains_any(text: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return F.coalesce(found, F.lit(False))


def occurrences(text: Column, part: str) -> Column:
    """How often a text holds a part, without overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def _starts_definition(line: Column) -> Column:
    return line.startswith("def ") | line.startswith("async def ")


def _fold(lines: Column, skip_definitions: bool) -> Column:
    """The stripped lines outside docstrings, comments and blanks, by a fold over (open delimiter, definition still to skip, lines kept).

    A line that begins with a triple quote opens a docstring, unless it holds the quote twice; one that begins with the same
    quote closes it. Quotes elsewhere in a line play no part.
    """
    start = F.struct(F.lit("").alias("open"), F.lit(skip_definitions).alias("skip"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        quote = F.when(line.startswith('"""'), '"""').when(line.startswith("'''"), "'''").otherwise("")
        opens = (quote != "") & (acc["open"] == "")
        closes = (quote != "") & (quote == acc["open"])
        twice = F.length(line) - F.length(F.replace(line, quote, F.lit(""))) >= 6
        definition = acc["skip"] & _starts_definition(line)
        hidden = definition | opens | closes | (acc["open"] != "") | (line == "") | line.startswith("#")
        return F.struct(
            F.when(definition, acc["open"]).when(opens, F.when(twice, F.lit("")).otherwise(quote)).when(closes, F.lit("")).otherwise(acc["open"]).alias("open"),
            (acc["skip"] & ~definition).alias("skip"),
            F.when(hidden, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(line))).alias("kept"),
        )

    return F.aggregate(lines, start, step, lambda acc: acc["kept"])


def _lines(code: Column) -> Column:
    return F.transform(F.split(code, "\n"), strip)


def effective_lines(code: Column) -> Column:
    """Lines that are no blank, comment or docstring; the first line isn't counted if it is a definition. Null for a null text."""
    lines = _lines(code)
    body = F.when(_starts_definition(F.get(lines, F.lit(0))), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    return F.size(_fold(body, False)).cast("long")


def body_lines(code: Column) -> Column:
    """The same lines, stripped, without the first definition wherever it stands (so after decorators as well)."""
    return _fold(_lines(code), True)
