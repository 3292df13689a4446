"""Queries of the general problems (p1, p2, p5, p7) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.text import squeeze, stamp
from strata.operators import history, quality, record_parser, snapshot_diff
from strata.operators.deliveries import latest

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    parsed = record_parser.parse_records(table(spark, d, "code_blocks_raw"), "line", ["raw_id"])
    return parsed.where(F.col("reason").isNotNull()).select("raw_id", "reason")


def p1_rows(spark: SparkSession, d: str) -> DataFrame:
    parsed = record_parser.parse_records(table(spark, d, "code_blocks_raw"), "line", ["raw_id", "revision_dir", "line_no"])
    return record_parser.typed_code_blocks(parsed, ["raw_id", "revision_dir", "line_no"])


def p2_changes(spark: SparkSession, d: str) -> DataFrame:
    """The differences with the values before and after."""
    blocks = table(spark, d, "code_blocks")
    rows = latest(blocks, {"revision_id": F.col("revision_id"), "file_path": squeeze("file_path"), "method_name": squeeze("method_name")}, {"parameters": squeeze("parameters"), "return_type": squeeze("return_type")})
    found = snapshot_diff.diff_snapshots(rows, "revision_id", ["file_path", "method_name"], ["parameters", "return_type"])
    return found.select(stamp("revision_id").alias("revision"), *found.columns[1:])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_changes(spark, d).select("revision", "file_path", "method_name", "change")


def p5_history(spark: SparkSession, d: str) -> DataFrame:
    """The dimension itself: versions with their attributes and period."""
    tracked = table(spark, d, "methods_tracked").where(F.col("method_id").isNotNull() & F.col("prev_revision_id").isNotNull())
    keys, attrs = ["method_id"], ["prev_file_path", "curr_method_name"]
    updates = latest(tracked, {"method_id": F.col("method_id"), "prev_revision_id": F.col("prev_revision_id")}, {a: squeeze(a) for a in attrs})
    return history.merge_versions(history.empty_dimension(updates, keys, attrs, "prev_revision_id"), updates, keys, attrs, "prev_revision_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_history(spark, d).select("method_id", stamp("valid_from").alias("valid_from"), F.coalesce(stamp("valid_to"), F.lit("open")).alias("valid_to"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_findings([(table(spark, d, s.table), s) for s in (quality.CODE_BLOCKS, quality.CLONE_PAIRS)])


def p7_profile(spark: SparkSession, d: str) -> DataFrame:
    blocks, pairs = (quality.column_profile(table(spark, d, s.table), s.table, s.ranges) for s in (quality.CODE_BLOCKS, quality.CLONE_PAIRS))
    return blocks.unionByName(pairs)


def p7_columns(spark: SparkSession, d: str) -> DataFrame:
    """The profile with ranges of texts, timestamps and arrays, the scores p7_found doesn't name, and malformed texts."""
    blocks, pairs = (quality.column_details(table(spark, d, t), t, ranges, quality.PROFILE_FORMS[t]) for t, ranges in quality.PROFILE_RANGES.items())
    return blocks.unionByName(pairs)


def p7_drift(spark: SparkSession, d: str) -> DataFrame:
    """Every column but the key and the load itself; the blocks of a pair are references, whose size means nothing."""
    rows = {s.table: table(spark, d, s.table) for s in (quality.CODE_BLOCKS, quality.CLONE_PAIRS)}
    columns = {s.table: [c for c in rows[s.table].columns if c not in (s.key, s.load)] for s in (quality.CODE_BLOCKS, quality.CLONE_PAIRS)}
    blocks = quality.drift_test(rows["code_blocks"], "code_blocks", "block_id", "revision_id", columns["code_blocks"])
    pairs = quality.drift_test(rows["clone_pairs"], "clone_pairs", "pair_id", "revision_id", columns["clone_pairs"], identifiers=["block_id_1", "block_id_2"])
    return blocks.unionByName(pairs)


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_rows, p2_found, p2_changes, p5_found, p5_history, p7_found, p7_profile, p7_columns, p7_drift)}


def _squeeze(c: str) -> str:
    return rf"nullif(trim(regexp_replace({c}, '[ \t\r\n]+', ' ', 'g')), '')"


def _stamp(c: str) -> str:
    return f"strftime({c}, '%Y%m%d_%H%M%S')"


_RAW = r"""
WITH trimmed AS (
  SELECT raw_id, revision_dir, line_no, regexp_replace(coalesce(line, ''), '(\r\n|\r|\n)\z', '') AS l FROM code_blocks_raw
), quoted AS (
  SELECT *, regexp_full_match(l, '(?:"(?:[^"]|"")*"|[^",\r\n]*)(?:,(?:"(?:[^"]|"")*"|[^",\r\n]*))*') AS ok FROM trimmed
), cells AS (
  SELECT *, CASE WHEN ok THEN list_transform(regexp_extract_all(',' || l, ',("(?:[^"]|"")*"|[^",\r\n]*)', 1),
    lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:len(x) - 1], '""', '"') ELSE x END) END AS f FROM quoted
), checked AS (
  SELECT *, CASE WHEN NOT ok THEN 'quoting' WHEN len(f) <> 9 THEN 'column_count'
    WHEN NOT regexp_full_match(f[1], '[0-9a-f]{32}') OR f[2] = '' OR f[5] = ''
      OR NOT regexp_full_match(f[3], '[0-9]{1,9}') OR NOT regexp_full_match(f[4], '[0-9]{1,9}')
      OR try_cast(f[3] AS BIGINT) < 1 OR try_cast(f[3] AS BIGINT) > try_cast(f[4] AS BIGINT)
      OR regexp_matches(f[7], '[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F]')
      OR NOT (f[9] = '' OR f[9] = '[]' OR (regexp_full_match(f[9], '\[[0-9]+(;[0-9]+)*\]')
        AND len(list_filter(string_split(f[9][2:len(f[9]) - 1], ';'), lambda x: coalesce(try_cast(x AS HUGEINT), 2147483648) > 2147483647)) = 0))
    THEN 'value' END AS reason FROM cells
)
"""

_P2 = f"""
WITH ranked AS (
  SELECT revision_id, {_squeeze("file_path")} AS file_path, {_squeeze("method_name")} AS method_name, {_squeeze("parameters")} AS parameters, {_squeeze("return_type")} AS return_type,
    row_number() OVER (PARTITION BY revision_id, {_squeeze("file_path")}, {_squeeze("method_name")} ORDER BY loaded_at DESC) AS k
  FROM code_blocks WHERE revision_id IS NOT NULL
), held AS (SELECT * FROM ranked WHERE k = 1),
revs AS (SELECT revision_id, lead(revision_id) OVER (ORDER BY revision_id) AS later FROM (SELECT DISTINCT revision_id FROM held)),
old AS (SELECT r.later, h.* FROM held h JOIN revs r USING (revision_id) WHERE r.later IS NOT NULL),
new AS (SELECT h.* FROM held h WHERE revision_id IN (SELECT later FROM revs WHERE later IS NOT NULL)),
sides AS (
  SELECT coalesce(n.revision_id, o.later) AS rev, o.later AS o_rev, n.revision_id AS n_rev,
    CASE WHEN n.revision_id IS NULL THEN o.file_path ELSE n.file_path END AS file_path, CASE WHEN n.revision_id IS NULL THEN o.method_name ELSE n.method_name END AS method_name,
    o.parameters AS old_parameters, o.return_type AS old_return_type, n.parameters AS new_parameters, n.return_type AS new_return_type
  FROM old o FULL JOIN new n ON o.later = n.revision_id AND o.file_path IS NOT DISTINCT FROM n.file_path AND o.method_name IS NOT DISTINCT FROM n.method_name
), named AS (
  SELECT {_stamp("rev")} AS revision, file_path, method_name, CASE WHEN o_rev IS NULL THEN 'added' WHEN n_rev IS NULL THEN 'removed'
    WHEN old_parameters IS DISTINCT FROM new_parameters OR old_return_type IS DISTINCT FROM new_return_type THEN 'changed' END AS change, old_parameters, old_return_type, new_parameters, new_return_type FROM sides
)
"""

_P5 = f"""
WITH ranked AS (
  SELECT method_id, prev_revision_id AS t, {_squeeze("prev_file_path")} AS prev_file_path, {_squeeze("curr_method_name")} AS curr_method_name,
    row_number() OVER (PARTITION BY method_id, prev_revision_id ORDER BY loaded_at DESC) AS k
  FROM methods_tracked WHERE method_id IS NOT NULL AND prev_revision_id IS NOT NULL
), marked AS (
  SELECT *, row_number() OVER w = 1 OR prev_file_path IS DISTINCT FROM lag(prev_file_path) OVER w OR curr_method_name IS DISTINCT FROM lag(curr_method_name) OVER w AS starts
  FROM ranked WHERE k = 1 WINDOW w AS (PARTITION BY method_id ORDER BY t)
), versions AS (
  SELECT method_id, prev_file_path, curr_method_name, t AS valid_from, lead(t) OVER (PARTITION BY method_id ORDER BY t) AS valid_to FROM marked WHERE starts
)
"""


def _p7_rows(table_name: str, column: str, key: str, issue: str, test: str) -> str:
    return f"SELECT DISTINCT '{table_name}' AS table_name, '{column}' AS column_name, CAST({key} AS VARCHAR) AS row_key, '{issue}' AS issue FROM {table_name} WHERE {test}"


def _p7_loads(table_name: str, column: str, nan: str) -> str:
    return f"""
SELECT '{table_name}', '{column}', {_stamp("revision_id")}, unnest(list_filter([CASE WHEN nulls > 0.02 * n THEN 'null_rate' END, CASE WHEN m > 2 * b OR m < b / 2 THEN 'shift' END], lambda x: x IS NOT NULL))
FROM (SELECT *, lag(m) OVER (ORDER BY revision_id) AS b FROM (
  SELECT revision_id, count(*) AS n, count(*) - count({column}) AS nulls, median(CAST({column} AS DOUBLE)) FILTER (WHERE {nan}) AS m
  FROM {table_name} WHERE revision_id IS NOT NULL GROUP BY revision_id))"""


def _profile(table_name: str, columns: list[str], numbers: dict[str, str | None]) -> list[str]:
    out = []
    for c in columns:
        value = f"CASE WHEN NOT isnan(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END" if c in numbers else "CAST(NULL AS DOUBLE)"
        bad = numbers.get(c)
        out.append(f"SELECT '{table_name}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, min({value}) AS min_value, max({value}) AS max_value, {f'count(*) FILTER (WHERE {bad})' if bad else 'CAST(0 AS BIGINT)'} AS n_impossible FROM {table_name}")
    return out


def _columns(table_name: str, checks: dict[str, tuple[str, str | None, str | None]]) -> str:
    """SQL of p7_columns: per column its kind (number, text, time, array), and tests for impossible and for malformed values."""
    out = []
    for c, (kind, bad, malformed) in checks.items():
        value = f"CASE WHEN NOT isnan(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END" if kind == "number" else "CAST(NULL AS DOUBLE)"
        text, time = c if kind == "text" else "CAST(NULL AS VARCHAR)", c if kind == "time" else "CAST(NULL AS TIMESTAMP)"
        size = f"length({c})" if kind == "text" else f"len({c})" if kind == "array" else "CAST(NULL AS BIGINT)"
        ends = ", ".join(f"{g}({x}) AS {g}_{n}" for n, x in (("value", value), ("text", text), ("time", time), ("size", size)) for g in ("min", "max"))
        counts = ", ".join(f"count(*) FILTER (WHERE {test or 'false'}) AS {n}" for n, test in (("n_impossible", bad), ("n_malformed", malformed)))
        out.append(f"SELECT '{table_name}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, {ends}, {counts} FROM {table_name}")
    return " UNION ALL ".join(out)


def _uneven(c: str) -> str:
    return rf"{c} = '' OR {c} LIKE ' %' OR {c} LIKE '% ' OR {c} LIKE '%  %' OR regexp_matches({c}, '[\x00-\x1F\x7F\x{{FFFD}}]')"


def _score(c: str) -> str:
    return f"isnan({c}) OR NOT {c} BETWEEN 0 AND 100"


_OUTSIDE = "ngram_overlap < 0 OR ngram_overlap > 100 OR isnan(ngram_overlap)"

ORACLES: dict[str, str] = {
    "p1_found": _RAW + "SELECT raw_id, reason FROM checked WHERE reason IS NOT NULL",
    "p1_rows": _RAW
    + """SELECT raw_id, revision_dir, line_no, f[1] AS token_hash, f[2] AS file_path, CAST(f[3] AS BIGINT) AS start_line, CAST(f[4] AS BIGINT) AS end_line, f[5] AS method_name,
  nullif(f[6], '') AS return_type, nullif(f[7], '') AS parameters, nullif(f[8], '') AS commit_hash,
  CASE WHEN f[9] = '' THEN NULL WHEN f[9] = '[]' THEN CAST([] AS INTEGER[]) ELSE list_transform(string_split(f[9][2:len(f[9]) - 1], ';'), lambda x: CAST(x AS INTEGER)) END AS token_sequence
FROM checked WHERE reason IS NULL""",
    "p2_found": _P2 + "SELECT revision, file_path, method_name, change FROM named WHERE change IS NOT NULL",
    "p2_changes": _P2 + "SELECT * FROM named WHERE change IS NOT NULL",
    "p5_found": _P5 + f"SELECT method_id, {_stamp('valid_from')} AS valid_from, coalesce({_stamp('valid_to')}, 'open') AS valid_to FROM versions",
    "p5_history": _P5 + "SELECT method_id, prev_file_path, curr_method_name, valid_from, valid_to, valid_to IS NULL AS is_current FROM versions",
    "p7_found": " UNION ALL ".join(
        [_p7_rows("code_blocks", c, "block_id", i, t) for c in ("start_line", "end_line") for i, t in (("null", f"{c} IS NULL"), ("range", f"{c} < 1"))]
        + [_p7_rows("code_blocks", "end_line", "block_id", "order", "start_line > end_line"), _p7_rows("clone_pairs", "ngram_overlap", "pair_id", "null", "ngram_overlap IS NULL"), _p7_rows("clone_pairs", "ngram_overlap", "pair_id", "range", _OUTSIDE)]
        + [_p7_loads("code_blocks", "start_line", "true"), _p7_loads("code_blocks", "end_line", "true"), _p7_loads("clone_pairs", "ngram_overlap", "NOT isnan(ngram_overlap)")]
    ),
    "p7_profile": " UNION ALL ".join(
        _profile("code_blocks", "block_id revision_id file_path start_line end_line method_name return_type parameters commit_hash token_hash token_sequence loaded_at".split(), {"block_id": None, "start_line": "start_line < 1", "end_line": "end_line < 1"})
        + _profile("clone_pairs", "pair_id revision_id block_id_1 block_id_2 ngram_overlap verify_similarity loaded_at".split(), {"pair_id": None, "block_id_1": None, "block_id_2": None, "ngram_overlap": _OUTSIDE, "verify_similarity": None})
    ),
    "p7_columns": _columns(
        "code_blocks",
        {c: ("number", None, None) for c in ("block_id",)}
        | {c: ("time", None, None) for c in ("revision_id", "loaded_at")}
        | {c: ("number", f"{c} < 1", None) for c in ("start_line", "end_line")}
        | {c: ("text", None, _uneven(c)) for c in ("file_path", "method_name", "return_type", "parameters")}
        | {c: ("text", None, f"NOT regexp_full_match({c}, '[0-9a-f]{{{n}}}')") for c, n in (("commit_hash", "7,40"), ("token_hash", "32"))}
        | {"token_sequence": ("array", "len(list_filter(token_sequence, lambda x: x IS NULL OR x < 0)) > 0", None)},
    )
    + " UNION ALL "
    + _columns("clone_pairs", {c: ("number", None, None) for c in ("pair_id", "block_id_1", "block_id_2")} | {c: ("time", None, None) for c in ("revision_id", "loaded_at")} | {c: ("number", _score(c), None) for c in ("ngram_overlap", "verify_similarity")}),
}
