"""Rows that fail to parse: delimited records are split by structural indexing and checked by type."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A decimal number from 0 to 2147483647 in ASCII digits, with any number of leading zeros.
INT32 = "0*(?:[0-9]{1,9}|1[0-9]{9}|20[0-9]{8}|21[0-3][0-9]{7}|214[0-6][0-9]{6}|2147[0-3][0-9]{5}|21474[0-7][0-9]{4}|214748[0-2][0-9]{3}|2147483[0-5][0-9]{2}|21474836[0-3][0-9]|214748364[0-7])"


@dataclass(frozen=True)
class RecordSpec:
    """The fields of a record: names in order, a pattern (RE2) each value must match whole, one it must not hold, and (a, b) fields with 1 <= a <= b."""

    names: tuple[str, ...]
    whole: dict[str, str] = field(default_factory=dict)
    never: dict[str, str] = field(default_factory=dict)
    ordered: tuple[str, str] | None = None


CODE_BLOCKS = RecordSpec(
    ("token_hash", "file_path", "start_line", "end_line", "method_name", "return_type", "parameters", "commit_hash", "token_sequence"),
    {
        "token_hash": "[0-9a-f]{32}",
        "file_path": "(?s:.+)",
        "method_name": "(?s:.+)",
        "start_line": "[0-9]{1,9}",
        "end_line": "[0-9]{1,9}",
        "token_sequence": rf"(?:\[(?:{INT32}(?:;{INT32})*)?\])?",
    },
    {"parameters": r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"},
    ("start_line", "end_line"),
)


def split_records(lines: pa.Array, columns: int) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Splits records into unquoted fields; see parse_records. Returns quoting errors, column-count errors and the columns.

    The bytes of the whole batch are looked at together. A running count of quotes, less the count at the record's
    start, gives each byte's parity: at even parity a byte is outside quotes, and only there commas delimit. In a
    well-formed record every field has an even number of quotes, so the delimiters found so are the delimiters; and a
    field that has quotes is well formed if and only if all its other bytes are at odd parity.
    Rows in error have null fields.
    """
    n = len(lines)
    lines = pc.fill_null(lines.cast(pa.large_string()), "")
    lines = pa.concat_arrays([lines])
    _, at, raw = lines.buffers()
    off = np.frombuffer(at, np.int64)[lines.offset : lines.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    start, end = off[:-1], off[1:].copy()
    last = np.where(end > start, data[np.maximum(end - 1, 0)] if len(data) else 0, 0)
    lf, cr = last == 10, last == 13
    end -= lf | cr
    before = np.where(end > start, data[np.maximum(end - 1, 0)] if len(data) else 0, 0)
    end -= lf & (before == 13)

    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    inside = np.cumsum(inside[:-1]) > 0
    quote = (data == 34) & inside
    quotes = np.concatenate([[0], np.cumsum(quote)])
    even = ((quotes[:-1] - np.repeat(quotes[start], off[1:] - off[:-1])) & 1) == 0
    comma = (data == 44) & even & inside
    commas = np.concatenate([[0], np.cumsum(comma)])
    width = commas[end] - commas[start] + 1

    def per_record(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return c[end] - c[start]

    at_comma = np.flatnonzero(comma)
    first = np.sort(np.concatenate([start, at_comma + 1]), kind="stable")
    past = np.sort(np.concatenate([end, at_comma]), kind="stable")
    loose = np.concatenate([[0], np.cumsum(inside & even & ~quote & ~comma)])
    broken = (quotes[past] > quotes[first]) & (loose[past] > loose[first])
    owner = np.repeat(np.arange(n), width)
    bad_quoting = ((quotes[end] - quotes[start]) & 1 == 1) | (per_record(inside & even & ((data == 10) | (data == 13))) > 0) | (np.bincount(owner[broken], minlength=n) > 0 if n else np.zeros(0, bool))
    bad_width = ~bad_quoting & (width != columns)

    opens = np.zeros(len(data) + 1, bool)
    opens[first] = True
    keep = inside & ~comma & (~quote | (even & ~opens[:-1]))
    kept = np.concatenate([[0], np.cumsum(keep)]).astype(np.int64)
    sizes = kept[past] - kept[first]
    values = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[keep])))
    good = ~(bad_quoting | bad_width)
    head = np.cumsum(width) - width
    columns_out = []
    for j in range(columns):
        columns_out.append(values.take(pa.array(head + j, pa.int64(), mask=~good)))
    return bad_quoting, bad_width, columns_out


def check_values(fields: dict[str, pa.Array], spec: RecordSpec) -> np.ndarray:
    """True where a value breaks the spec. Null fields (rows already rejected) break nothing."""
    bad = np.zeros(len(next(iter(fields.values()))), bool)
    truth = lambda x: pc.fill_null(x, False).to_numpy(zero_copy_only=False)
    for name, pattern in spec.whole.items():
        bad |= truth(pc.invert(pc.match_substring_regex(fields[name], rf"\A(?:{pattern})\z")))
    for name, pattern in spec.never.items():
        bad |= truth(pc.match_substring_regex(fields[name], pattern))
    if spec.ordered:
        a, b = (pc.fill_null(pc.if_else(pa.array(bad), "1", fields[x]), "1").cast(pa.int64()).to_numpy(zero_copy_only=False) for x in spec.ordered)
        bad |= (a < 1) | (b < a)
    return bad


def parse_records(df: DataFrame, line: str, keep: list[str], spec: RecordSpec = CODE_BLOCKS) -> DataFrame:
    """Splits delimited records into the spec's fields, telling apart those that can't be loaded.

    Returns the `keep` columns, `reason` (null for a well-formed record, else the first that applies of `quoting`,
    `column_count`, `value`) and the fields as text, which are null if there is a reason. One line end at the end of
    a record is dropped. A null or empty record is one empty field. Repeated records give repeated rows. Other
    columns of `df` are not read. There is no shuffle; the work is numpy over whole Arrow batches.
    """
    names = list(spec.names)
    if clash := {*keep} & {*names, "reason"}:
        raise ValueError(f"columns named like a field: {sorted(clash)}")
    kept = [df.schema[c] for c in keep]
    schema = T.StructType([*kept, T.StructField("reason", T.StringType()), *[T.StructField(n, T.StringType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quoting, width, columns = split_records(batch.column(len(keep)), len(names))
            value = check_values(dict(zip(names, columns)), spec)
            reason = pa.array(np.select([quoting, width, value], ["quoting", "column_count", "value"], ""), pa.string(), mask=~(quoting | width | value))
            ok = pa.array(~value)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], reason, *[pc.if_else(ok, c, None).cast(pa.string()) for c in columns]], names=[*keep, "reason", *names])

    return df.select(*keep, line).mapInArrow(run, schema)


def typed_code_blocks(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """The well-formed records of parse_records as typed code_blocks rows. Empty optional fields become null; an empty token_sequence is null, `[]` an empty array."""
    inner = F.expr("substring(token_sequence, 2, length(token_sequence) - 2)")
    tokens = F.when(F.col("token_sequence") == "", F.lit(None)).when(F.col("token_sequence") == "[]", F.array().cast("array<int>")).otherwise(F.transform(F.split(inner, ";"), lambda x: x.cast("int")))
    optional = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return parsed.where(F.col("reason").isNull()).select(
        *keep,
        "token_hash",
        "file_path",
        F.col("start_line").cast("long").alias("start_line"),
        F.col("end_line").cast("long").alias("end_line"),
        "method_name",
        optional("return_type"),
        optional("parameters"),
        optional("commit_hash"),
        tokens.alias("token_sequence"),
    )
