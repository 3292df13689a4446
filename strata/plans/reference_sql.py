"""SQL for the queries of the analysis."""

from __future__ import annotations

from strata.operators.rules import DEFAULT_RULES
from strata.operators.significance import CLONE_METRICS
from strata.plans.core import _RAW
from strata.plans.core import ORACLES as CORE_ORACLES
from strata.plans.inputs import BLOCKS_SQL, ENRICHED_SQL, MEDIANS_SQL, PAIRS_SQL, TRACKED_SQL

P1_ROWS_SQL = CORE_ORACLES["p1_rows"]
_SIG = ("file_path", "method_name", "return_type", "parameters")
_STAMP = "strftime({}, '%Y%m%d_%H%M%S')"


def _same(a: str, b: str) -> str:
    return " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in _SIG)


_SIGNATURES = (
    f"WITH {BLOCKS_SQL}, sig AS (SELECT "
    + ", ".join(f"p.{c} AS prev_{c}" for c in ("revision_id", "token_hash", *_SIG))
    + ", "
    + ", ".join(f"n.{c} AS curr_{c}" for c in ("revision_id", "token_hash", *_SIG))
    + f", n.revision_id IS NOT NULL AS is_sig_matched, n.revision_id IS NULL AS is_sig_deleted, false AS is_sig_added, p.block_id AS prev_block, n.block_id AS curr_block FROM blocks p JOIN steps s ON s.revision_id = p.revision_id AND s.r1 IS NOT NULL LEFT JOIN blocks n ON n.revision_id = s.r1 AND {_same('p', 'n')})"
)

_STATUS = "CASE WHEN is_absorbed THEN 'absorbed' WHEN is_deleted THEN 'deleted' ELSE 'survived' END"


def _rate_table(columns: list[tuple[str, str]]) -> str:
    one = ", ".join(f"CAST({sql} AS DOUBLE) AS {name}" for name, sql in columns)
    mean = ", ".join(f"round(avg({name}), 2) AS {name}" for name, _ in columns)
    return f"""WITH {ENRICHED_SQL}, marked AS (SELECT *, {_STATUS} AS status, coalesce(median_similarity >= 90, false) AS high, coalesce(median_similarity >= 70 AND median_similarity < 90, false) AS low FROM enriched WHERE prev_revision_id IS NOT NULL),
rates AS (SELECT CAST(prev_revision_id AS VARCHAR) AS prev_revision_id, {one} FROM marked GROUP BY marked.prev_revision_id)"""


def _count(status: str, test: str) -> str:
    return f"count(*) FILTER (WHERE status = '{status}' AND {test})"


def _percent(flag: str, test: str) -> str:
    return f"round(avg(CASE WHEN {test} THEN CAST({flag} AS INTEGER) END) * 100, 2)"


_CLONE = {"clone": "has_clone", "no_clone": "NOT has_clone"}
_LEVEL = {"high": "high", "low": "low", "neither": "NOT high AND NOT low"}
_BY_CLONE = [(f"{s}_{n}", _count(s, t)) for s in ("absorbed", "deleted", "survived") for n, t in _CLONE.items()] + [(f"{n}_{f}_rate", f"coalesce({_percent(f'is_{f}', t)}, 0)") for f in ("deleted", "absorbed") for n, t in _CLONE.items()]
_BY_SIMILARITY = [(f"{s}_{n}", _count(s, t)) for s in ("absorbed", "deleted", "survived") for n, t in _LEVEL.items()] + [(f"{n}_{f}_rate", _percent(f"is_{f}", f"{n} AND has_clone")) for n in ("high", "low") for f in ("deleted", "absorbed")]


def _with_average(columns: list[tuple[str, str]]) -> str:
    return _rate_table(columns) + " SELECT * FROM rates UNION ALL SELECT 'Average', " + ", ".join(f"round(avg({n}), 2)" for n, _ in columns) + " FROM rates"


def _signed_ranks(columns: list[tuple[str, str]], metrics: dict[str, tuple[str, str]]) -> str:
    cells = " UNION ALL ".join(f"SELECT '{m}' AS metric, {a} AS f, {b} AS s FROM rates" for m, (a, b) in metrics.items())
    return (
        _rate_table(columns)
        + f""", cells AS (SELECT * FROM ({cells}) WHERE f IS NOT NULL AND s IS NOT NULL),
used AS (SELECT metric, f - s AS d, round(abs(f - s), 9) AS a FROM cells WHERE round(abs(f - s), 9) > 0),
ranked AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY a) + (count(*) OVER (PARTITION BY metric, a) - 1) / 2 AS r FROM used),
sums AS (SELECT metric, count(*) AS n_used, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS w_minus FROM ranked GROUP BY metric),
means AS (SELECT metric, count(*) AS n_pairs, avg(f) AS mean_first, avg(s) AS mean_second FROM cells GROUP BY metric)
SELECT metric, n_pairs, coalesce(n_used, 0) AS n_used, mean_first, mean_second, CAST(coalesce(w_plus, 0) AS DOUBLE) AS w_plus, CAST(coalesce(w_minus, 0) AS DOUBLE) AS w_minus,
  CASE WHEN w_plus + w_minus > 0 THEN CAST((w_plus - w_minus) / (w_plus + w_minus) AS DOUBLE) END AS rank_biserial FROM means LEFT JOIN sums USING (metric)"""
    )


_SURVIVAL = f"""WITH {ENRICHED_SQL}, placed AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY method_id) AS n, bool_or(is_absorber) OVER (PARTITION BY method_id) AS ever,
    last_value(is_matched) OVER whole AS lm, last_value(is_deleted) OVER whole AS ld, last_value(is_absorbed) OVER whole AS la
  FROM enriched WHERE prev_revision_id IS NOT NULL
  WINDOW w AS (PARTITION BY method_id ORDER BY prev_revision_id), whole AS (PARTITION BY method_id ORDER BY prev_revision_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), grouped AS (SELECT *, CASE WHEN la THEN 'Absorbed' WHEN ld THEN 'Deleted' WHEN lm THEN CASE WHEN ever THEN 'Absorber' ELSE 'Matched' END END AS survival_group FROM placed),
lives AS (SELECT *, k - CASE WHEN survival_group = 'Absorber' THEN max(CASE WHEN is_absorber THEN k END) OVER (PARTITION BY method_id) ELSE n END AS relative_time FROM grouped)"""

_CC = """links AS (SELECT DISTINCT revision_id, token_hash_1 AS a, token_hash_2 AS b FROM pairs),
revs AS (SELECT DISTINCT revision_id FROM links),
edges AS (SELECT r.revision_id, a, b FROM revs r JOIN links l ON {rule} UNION SELECT r.revision_id, b, a FROM revs r JOIN links l ON {rule}),
reach AS (SELECT revision_id, a AS node, a AS seen FROM edges UNION SELECT r.revision_id, r.node, e.b FROM reach r JOIN edges e ON e.revision_id = r.revision_id AND r.seen = e.a),
groups AS (SELECT revision_id, node AS token_hash, min(seen) AS group_id FROM reach GROUP BY revision_id, node)"""
_CUMULATIVE, _PER_REVISION = _CC.format(rule="l.revision_id <= r.revision_id"), _CC.format(rule="l.revision_id = r.revision_id")

_GROUP_STATUS = f"""WITH RECURSIVE {ENRICHED_SQL}, {_CUMULATIVE},
joined AS (SELECT e.*, g.group_id FROM enriched e LEFT JOIN groups g ON g.revision_id = e.prev_revision_id AND g.token_hash = e.prev_token_hash),
state AS (SELECT prev_revision_id AS r, group_id AS g, bool_and(is_deleted) AS whole, bool_or(is_deleted) AS part FROM joined WHERE has_clone AND group_id IS NOT NULL GROUP BY ALL),
stated AS (SELECT j.*, coalesce(is_deleted AND has_clone AND whole, false) AS is_all_deleted, coalesce(is_deleted AND has_clone AND part AND NOT whole, false) AS is_partial_deleted
  FROM joined j LEFT JOIN state s ON s.r IS NOT DISTINCT FROM j.prev_revision_id AND s.g = j.group_id)"""

_SNAPSHOT = f"""WITH RECURSIVE {PAIRS_SQL}, {_PER_REVISION},
sizes AS (SELECT revision_id, group_id, count(*) AS n_members FROM groups GROUP BY ALL),
best AS (SELECT revision_id, least(token_hash_1, token_hash_2) AS x, greatest(token_hash_1, token_hash_2) AS y, max(CASE WHEN NOT isnan(coalesce(verify_similarity, ngram_overlap)) THEN coalesce(verify_similarity, ngram_overlap) END) AS s
  FROM pairs WHERE token_hash_1 <> token_hash_2 GROUP BY ALL),
inner_edges AS (SELECT b.revision_id, g.group_id, count(*) AS n_edges, avg(s) AS avg_similarity, min(s) AS min_similarity, max(s) AS max_similarity FROM best b JOIN groups g ON g.revision_id = b.revision_id AND g.token_hash = b.x GROUP BY ALL),
snapshot AS (SELECT z.revision_id, z.group_id, n_members, coalesce(n_edges, 0) AS n_edges, CASE WHEN n_members > 1 THEN 2.0 * coalesce(n_edges, 0) / CAST(n_members * (n_members - 1) AS DOUBLE) END AS density, avg_similarity, min_similarity, max_similarity
  FROM sizes z LEFT JOIN inner_edges e ON e.revision_id = z.revision_id AND e.group_id = z.group_id)"""

_LINES = f"""WITH {ENRICHED_SQL}, {BLOCKS_SQL},
lined AS (SELECT t.*, p.end_line - p.start_line + 1 AS prev_loc, c.end_line - c.start_line + 1 AS curr_loc FROM enriched t
  LEFT JOIN blocks p ON p.revision_id = t.prev_revision_id AND p.file_path IS NOT DISTINCT FROM t.prev_file_path AND p.method_name IS NOT DISTINCT FROM t.prev_method_name
  LEFT JOIN blocks c ON c.revision_id = t.curr_revision_id AND c.file_path IS NOT DISTINCT FROM t.curr_file_path AND c.method_name IS NOT DISTINCT FROM t.curr_method_name),
kinds AS (SELECT *, coalesce(is_matched AND prev_loc * 0.7 > curr_loc, false) AS is_split, coalesce(is_matched AND prev_loc < curr_loc * 0.7, false) AS is_merged,
  coalesce(is_matched AND NOT prev_loc * 0.7 > curr_loc AND NOT prev_loc < curr_loc * 0.7, false) AS is_modified FROM lined)"""

_AUDIT = f"""WITH {TRACKED_SQL}, steps AS (SELECT revision_id AS r0, lead(revision_id) OVER (ORDER BY revision_id) AS r1, lead(revision_id, 2) OVER (ORDER BY revision_id) AS r2 FROM (SELECT DISTINCT prev_revision_id AS revision_id FROM tracked WHERE prev_revision_id IS NOT NULL)),
one AS (SELECT * FROM tracked WHERE is_matched AND prev_revision_id IS NOT NULL),
found AS (
  SELECT 'deleted' AS kind, r0, t.method_id AS row, o.method_id AS other FROM tracked t JOIN steps ON t.prev_revision_id = r0 AND r2 IS NOT NULL LEFT JOIN one o ON o.prev_revision_id = r1 AND o.prev_file_path = t.prev_file_path AND o.prev_method_name = t.prev_method_name WHERE t.is_deleted
  UNION ALL SELECT 'matched', r0, t.method_id, o.method_id FROM tracked t JOIN steps ON t.prev_revision_id = r0 AND r2 IS NOT NULL LEFT JOIN one o ON o.prev_revision_id = r1 AND o.curr_file_path = t.prev_file_path AND o.curr_method_name = t.prev_method_name WHERE t.is_matched
  UNION ALL SELECT 'added', r0, t.method_id, o.method_id FROM tracked t JOIN steps ON t.curr_revision_id = r1 AND r1 IS NOT NULL LEFT JOIN one o ON o.prev_revision_id = r0 AND o.prev_file_path = t.curr_file_path AND o.prev_method_name = t.curr_method_name WHERE t.is_added)
SELECT kind, r0 AS revision_id, row, coalesce(list_sort(list(other) FILTER (WHERE other IS NOT NULL)), CAST([] AS BIGINT[])) AS matched FROM found GROUP BY kind, r0, row"""

_DELETIONS = f"""{BLOCKS_SQL}, vanished AS (SELECT DISTINCT b.file_path FROM blocks b JOIN steps s ON s.revision_id = b.revision_id AND s.r1 IS NOT NULL
  WHERE NOT EXISTS (SELECT 1 FROM blocks n WHERE n.revision_id = s.r1 AND n.file_path = b.file_path))"""

_SAMPLES = f"""{_SIGNATURES}, {PAIRS_SQL},
dead AS (SELECT DISTINCT CAST(prev_block AS VARCHAR) AS b FROM sig WHERE is_sig_deleted),
ends AS (SELECT CAST(unnest([block_id_1, block_id_2]) AS VARCHAR) AS b FROM pairs), sizes AS (SELECT b, count(*) AS n FROM ends GROUP BY b),
samples AS (SELECT s.snippet_id, s.code, s.function_name, s.loc, d.b IS NOT NULL AS is_deleted, z.n AS clone_group_size FROM code_snippets s LEFT JOIN dead d ON d.b = s.global_block_id LEFT JOIN sizes z ON z.b = s.global_block_id)"""


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


def _rule(spec: dict) -> str:
    flag = "(?i)" if "IGNORECASE" in (spec.get("flags") or []) else ""
    if spec["type"] == "regex":
        test = " OR ".join(f"regexp_matches(code, '{flag}{_re(p)}')" for p in spec["patterns"])
    elif spec["type"] == "regex_function_name":
        test = " OR ".join(f"regexp_matches(string_split(function_name, '.')[-1], '{flag}{_re(p)}')" for p in spec["patterns"])
    elif spec["type"] == "composite":
        test = f" {spec['operator']} ".join(f"regexp_matches(code, '{_re(s['pattern'])}')" for s in spec["sub_patterns"])
    else:
        test = "string_split(function_name, '.')[-1] LIKE '\\_%' ESCAPE '\\' AND string_split(function_name, '.')[-1] NOT LIKE '\\_\\_%' ESCAPE '\\'"
    return f"coalesce({test}, false) AS rule_{spec['name']}"


_PATTERN_RULES = [s for s in DEFAULT_RULES if s["name"] not in ("short_method", "empty_method", "single_return")]
_RULE_NAMES = [f"rule_{s['name']}" for s in _PATTERN_RULES]
_RULE_COLUMNS = ", ".join(map(_rule, _PATTERN_RULES))


def _times(part: str) -> str:
    return f"((length(code) - length(replace(code, '{part}', ''))) // {len(part)})"


def _any(text: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{_re(p)}')" for p in parts) + ")"


_DOC = _any("code", ['"""', "'''"])
_PATTERNS = {
    "simple_wrapper": f"contains(code, 'return ') AND {_times('return')} = 1 AND loc <= 5",
    "delegation": "len(code_lines) <= 3 AND len(list_filter(code_lines, lambda x: contains(x, 'return '))) > 0",
    "conversion_utility": f"{_any('lower(code)', ['convert', 'cast', 'to_', 'as_', 'from_'])} AND loc <= 15",
    "validation": f"{_any('code', ['raise', 'assert'])} OR coalesce(contains(lower(function_name), 'check'), false)",
    "deprecated_or_todo": _any("lower(code)", ["deprecated", "todo", "fixme", "xxx", "hack"]),
    "very_small": "loc <= 3",
    "complex_control_flow": f"{_times('for ')} + {_times('while ')} + {_times('if ')} + {_times('elif ')} >= 3",
    "has_error_handling": "contains(code, 'try:') AND contains(code, 'except')",
    "property_decorator": _any("code", ["@property", "@cached_property"]),
    "private_function": "starts_with(function_name, '_') AND NOT starts_with(function_name, '__')",
    "test_helper": _any("lower(function_name)", ["assert", "check", "verify", "mock"]),
    "compatibility_shim": _any("lower(code)", ["compat", "fallback", "backward"]),
    "has_docstring": _DOC,
    "no_docstring": f"NOT {_DOC}",
    "modifies_state": f"contains(code, 'self.') AND {_any('code', [' = ', '+=', '-=', '*='])}",
    "static_utility": r"contains(string_split(code, chr(10))[1], 'def ') AND NOT contains(string_split(code, chr(10))[1], 'self')",
}
_LABELS = "CASE WHEN code IS NULL THEN CAST([] AS VARCHAR[]) ELSE list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in _PATTERNS.items()) + "], lambda x: x IS NOT NULL) END AS detected_patterns"
_STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_CODE_LINES = f"list_filter(string_split({_STRIPPED.format('code')}, chr(10)), lambda x: {_STRIPPED.format('x')} <> '' AND NOT starts_with({_STRIPPED.format('x')}, '#')) AS code_lines"

_LINEAGE = f"""WITH RECURSIVE {TRACKED_SQL},
noded AS (SELECT *, CASE WHEN prev_revision_id IS NOT NULL THEN CAST(row(prev_revision_id, {", ".join(f"prev_{c}" for c in _SIG)}) AS VARCHAR) END AS p,
  CASE WHEN curr_revision_id IS NOT NULL THEN CAST(row(curr_revision_id, {", ".join(f"curr_{c}" for c in _SIG)}) AS VARCHAR) END AS c,
  {" AND ".join(f"prev_{c} IS NOT DISTINCT FROM curr_{c}" for c in _SIG)} AS same FROM tracked),
into_ranked AS (SELECT c, p, same, count(*) OVER (PARTITION BY c) AS n, row_number() OVER (PARTITION BY c ORDER BY NOT is_sig_matched, -coalesce(similarity, -1), {", ".join(f"prev_{c} NULLS LAST" for c in _SIG)}) AS k FROM noded WHERE p IS NOT NULL AND c IS NOT NULL),
heads AS (SELECT c, p, same, n FROM into_ranked WHERE k = 1),
climb AS (SELECT DISTINCT coalesce(p, c) AS v, coalesce(p, c) AS u, 0 AS depth FROM noded UNION ALL SELECT climb.v, h.p, depth + 1 FROM climb JOIN heads h ON h.c = climb.u),
roots AS (SELECT v, arg_max(u, depth) AS root FROM climb GROUP BY v),
ids AS (SELECT n.*, r.root, n.p IS NOT NULL AND n.c IS NOT NULL AND coalesce(h.n > 1, false) AND (h.p IS DISTINCT FROM n.p OR NOT h.same) AS absorbed,
  n.p IS NOT NULL AND n.c IS NOT NULL AND coalesce(h.n > 1, false) AND h.p IS NOT DISTINCT FROM n.p AND h.same AS absorber FROM noded n LEFT JOIN heads h ON h.c = n.c JOIN roots r ON r.v = coalesce(n.p, n.c)),
chains AS (SELECT root, count(*) AS n_rows, min(prev_revision_id) AS first_revision, max(prev_revision_id) AS last_revision, count(*) FILTER (WHERE absorbed) AS n_absorbed, count(*) FILTER (WHERE absorber) AS n_absorber FROM ids GROUP BY root)
SELECT n_rows, first_revision, last_revision, n_absorbed, n_absorber, count(*) AS n_chains FROM chains GROUP BY ALL"""

_SIM_STEPS = f"""WITH {BLOCKS_SQL},
seqs AS (SELECT b.token_hash, any_value(b.token_sequence) AS s, list(DISTINCT st.r1) FILTER (WHERE st.r1 IS NOT NULL) AS src, list(DISTINCT st.revision_id) AS tgt FROM blocks b JOIN steps st ON st.revision_id = b.revision_id WHERE b.token_sequence IS NOT NULL AND b.token_hash IS NOT NULL GROUP BY b.token_hash),
grams AS (SELECT DISTINCT token_hash, s[i:i + 4] AS g FROM (SELECT token_hash, s, unnest(range(1, len(s) - 3)) AS i FROM seqs WHERE len(s) >= 5)),
sizes AS (SELECT token_hash, count(*) AS n FROM grams GROUP BY token_hash),
shared AS (SELECT a.token_hash AS src, b.token_hash AS tgt, count(*) AS n_shared FROM grams a JOIN grams b ON a.g = b.g AND a.token_hash <> b.token_hash GROUP BY ALL)"""

_TRIPLES = [("null_" + c, f"{c} IS NULL") for c in ("token_hash", "file_path", "start_line", "end_line", "method_name")] + [("start_after_end", "start_line > end_line"), ("line_not_positive", "start_line <= 0 OR end_line <= 0")]

ORACLES: dict[str, str] = {
    "revision_steps": "SELECT revision_id, lead(revision_id) OVER (ORDER BY revision_id) AS next_revision_id, lead(revision_id, 2) OVER (ORDER BY revision_id) AS after_next_revision_id FROM (SELECT DISTINCT revision_id FROM revisions WHERE has_files AND revision_id IS NOT NULL)",
    "snapshot_stamps": f"SELECT {_STAMP.format('r')} AS revision, {_STAMP.format('n')} AS next_revision FROM (SELECT revision_id AS r, lead(revision_id) OVER (ORDER BY revision_id) AS n FROM (SELECT DISTINCT revision_id FROM code_blocks WHERE revision_id IS NOT NULL))",
    "renamed_duplicates": _RAW
    + """, typed AS (SELECT raw_id, revision_dir, line_no, f[2] AS file_path, f[5] AS method_name, nullif(f[6], '') AS return_type, nullif(f[7], '') AS parameters FROM checked WHERE reason IS NULL)
SELECT raw_id, CASE WHEN count(*) OVER s > 1 THEN method_name || '_' || row_number() OVER (PARTITION BY revision_dir, file_path, method_name, return_type, parameters ORDER BY line_no, raw_id) ELSE method_name END AS method_name
FROM typed WINDOW s AS (PARTITION BY revision_dir, file_path, method_name, return_type, parameters)""",
    "validate_blocks": " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS n_violations FROM code_blocks WHERE {t}" for n, t in _TRIPLES)
    + " UNION ALL SELECT 'duplicate_signature', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM code_blocks GROUP BY revision_id, file_path, method_name, return_type, parameters)",
    "validate_pairs": " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) AS n_violations FROM clone_pairs WHERE {t}"
        for n, t in (("null_block_id_1", "block_id_1 IS NULL"), ("null_block_id_2", "block_id_2 IS NULL"), ("self_pair", "block_id_1 = block_id_2"), ("overlap_out_of_range", "ngram_overlap < 0 OR ngram_overlap > 100 OR isnan(ngram_overlap)"))
    ),
    "signature_match": _SIGNATURES + " SELECT * EXCLUDE (prev_block, curr_block) FROM sig",
    "signature_counts": _SIGNATURES + " SELECT is_sig_matched, is_sig_deleted, is_sig_added, count(*) AS n FROM sig GROUP BY ALL",
    "signature_check": _SIGNATURES + " SELECT prev_revision_id, count(*) AS n_before, count(*) FILTER (WHERE is_sig_matched) AS n_matched, count(*) FILTER (WHERE is_sig_deleted) AS n_deleted, true AS adds_up FROM sig GROUP BY prev_revision_id",
    "similarity_candidates": _SIM_STEPS + " SELECT shared.src, shared.tgt, n_shared, x.n AS n_grams FROM shared JOIN sizes x ON x.token_hash = shared.src JOIN seqs p ON p.token_hash = shared.src JOIN seqs q ON q.token_hash = shared.tgt WHERE n_shared >= x.n * 0.1 AND list_has_any(p.src, q.tgt)",
    "lineage_summary": _LINEAGE,
    "id_statistics": f"""WITH {TRACKED_SQL}, one AS (SELECT count(*) AS rows, count(DISTINCT method_id) AS methods, count(*) FILTER (WHERE is_matched) AS matched, count(*) FILTER (WHERE is_deleted) AS deleted, count(*) FILTER (WHERE is_added) AS added,
  count(*) FILTER (WHERE is_sig_matched) AS signature_matched, count(*) FILTER (WHERE is_matched AND NOT is_sig_matched) AS similarity_matched, count(*) FILTER (WHERE is_absorbed) AS absorbed, count(*) FILTER (WHERE is_absorber) AS absorbers,
  count(*) FILTER (WHERE is_matched AND NOT is_absorbed AND NOT is_absorber) AS continued, count(DISTINCT CASE WHEN is_absorbed THEN method_id END) AS absorbed_methods FROM tracked)
UNPIVOT one ON COLUMNS(*) INTO NAME statistic VALUE n""",
    "lifetimes": f"WITH {TRACKED_SQL} SELECT method_id, count(DISTINCT prev_revision_id) AS lifetime_revisions, date_diff('day', CAST(min(prev_revision_id) AS DATE), CAST(max(prev_revision_id) AS DATE)) AS lifetime_days, min(prev_revision_id) AS first_seen, max(prev_revision_id) AS last_seen FROM tracked WHERE prev_revision_id IS NOT NULL GROUP BY method_id",
    "global_blocks": _SIGNATURES.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, up AS (SELECT curr_block AS v, min(prev_block) AS u FROM sig WHERE is_sig_matched GROUP BY curr_block),
climb AS (SELECT block_id AS v, block_id AS u, 0 AS depth FROM blocks UNION ALL SELECT climb.v, up.u, depth + 1 FROM climb JOIN up ON up.v = climb.u),
roots AS (SELECT v, arg_max(u, depth) AS root FROM climb GROUP BY v)
SELECT b.revision_id, b.block_id, r.root AS global_block_id FROM blocks b JOIN roots r ON r.v = b.block_id""",
    "median_similarity": f"WITH {MEDIANS_SQL} SELECT revision_id, token_hash, median_similarity FROM medians",
    "tracked_with_clones": f"WITH {ENRICHED_SQL} SELECT method_id, prev_revision_id, median_similarity, has_clone FROM enriched",
    "clone_crosstab": f"WITH {ENRICHED_SQL} SELECT prev_revision_id, "
    + ", ".join(f"count(*) FILTER (WHERE {'' if c else 'NOT '}has_clone AND {'' if m else 'NOT '}is_matched AND {'' if x else 'NOT '}is_deleted) AS {'clone' if c else 'no_clone'}_{'matched' if m else 'unmatched'}_{'deleted' if x else 'kept'}" for c in (0, 1) for m in (0, 1) for x in (0, 1))
    + " FROM enriched WHERE prev_revision_id IS NOT NULL GROUP BY prev_revision_id",
    "rates_by_clone": _with_average(_BY_CLONE),
    "rates_by_similarity": _with_average(_BY_SIMILARITY),
    "rate_series": _rate_table(_BY_CLONE) + " " + " UNION ALL ".join(f"SELECT prev_revision_id AS revision, '{n}' AS metric, {n} AS value FROM rates" for n, _ in _BY_CLONE),
    "similarity_rate_series": _rate_table(_BY_SIMILARITY) + " " + " UNION ALL ".join(f"SELECT prev_revision_id AS revision, '{n}' AS metric, {n} AS value FROM rates" for n, _ in _BY_SIMILARITY),
    "similarity_counts": f"WITH {ENRICHED_SQL} SELECT CASE WHEN median_similarity >= 90 THEN 'high' ELSE 'low' END AS level, count(*) FILTER (WHERE is_matched) AS n_matched, count(*) FILTER (WHERE NOT is_matched) AS n_unmatched FROM enriched WHERE median_similarity >= 70 GROUP BY level",
    "signed_rank_by_clone": _signed_ranks(_BY_CLONE, CLONE_METRICS),
    "clone_groups": f"WITH RECURSIVE {PAIRS_SQL}, {_CUMULATIVE} SELECT * FROM groups",
    "clone_groups_per_revision": f"WITH RECURSIVE {PAIRS_SQL}, {_PER_REVISION} SELECT * FROM groups",
    "deletion_status": _GROUP_STATUS + " SELECT method_id, prev_revision_id, group_id, is_all_deleted, is_partial_deleted FROM stated",
    "deletion_crosstab": _GROUP_STATUS + " SELECT prev_revision_id, count(*) FILTER (WHERE NOT is_deleted) AS kept, count(*) FILTER (WHERE is_deleted AND NOT is_all_deleted AND NOT is_partial_deleted) AS deleted_alone, count(*) FILTER (WHERE is_all_deleted) AS deleted_with_group, count(*) FILTER (WHERE is_partial_deleted) AS deleted_from_group FROM stated WHERE prev_revision_id IS NOT NULL GROUP BY prev_revision_id",
    "revision_labels": _GROUP_STATUS + " SELECT prev_revision_id, group_id, count(*) AS n_members, CASE WHEN bool_and(is_deleted) THEN 'all_deleted' WHEN bool_or(is_deleted) THEN 'partial_deleted' ELSE 'no_deleted' END AS rev_status FROM stated WHERE prev_revision_id IS NOT NULL AND group_id IS NOT NULL GROUP BY ALL",
    "groups_deleted": _GROUP_STATUS + " SELECT prev_revision_id, group_id, count(*) AS n_members, CASE WHEN bool_and(is_deleted) THEN 'all_deleted' ELSE 'partial_deleted' END AS rev_status FROM stated WHERE prev_revision_id IS NOT NULL AND group_id IS NOT NULL GROUP BY prev_revision_id, group_id HAVING bool_or(is_deleted)",
    "group_snapshot": _SNAPSHOT + " SELECT * FROM snapshot",
    "clone_group_report": _SNAPSHOT + " SELECT * FROM snapshot WHERE n_members >= 3",
    "clone_group_report_all": _SNAPSHOT + " SELECT * FROM snapshot WHERE n_members >= 2",
    "deletion_survival": _SURVIVAL + " SELECT method_id, prev_revision_id, survival_group, CASE survival_group WHEN 'Matched' THEN 'survived' WHEN 'Absorber' THEN 'took in others' WHEN 'Absorbed' THEN 'taken in' WHEN 'Deleted' THEN 'deleted' END AS group_label, relative_time, median_similarity FROM lives",
    "survival_counts": _SURVIVAL + " SELECT relative_time, survival_group, count(median_similarity) AS n_similar, count(*) - count(median_similarity) AS n_not_similar FROM lives WHERE survival_group IS NOT NULL GROUP BY ALL",
    "survival_boxes": _SURVIVAL
    + """, q AS (SELECT relative_time, survival_group, count(*) AS n, quantile_cont(median_similarity, 0.25) AS q1, median(median_similarity) AS median, quantile_cont(median_similarity, 0.75) AS q3 FROM lives WHERE median_similarity IS NOT NULL AND survival_group IS NOT NULL GROUP BY ALL)
SELECT q.*, w.low AS whisker_low, w.high AS whisker_high FROM q JOIN (SELECT l.relative_time, l.survival_group, min(l.median_similarity) AS low, max(l.median_similarity) AS high FROM lives l JOIN q USING (relative_time, survival_group) WHERE l.median_similarity BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL) w USING (relative_time, survival_group)""",
    "survival_areas": _SURVIVAL
    + """, c AS (SELECT relative_time, survival_group, count(*) AS n FROM lives WHERE survival_group IS NOT NULL GROUP BY ALL), e AS (SELECT min(relative_time) AS a, max(relative_time) AS z, max(n) AS most FROM c),
grid AS (SELECT t AS relative_time, g AS survival_group, CAST(most * 1.05 AS DOUBLE) AS y_max FROM (SELECT unnest(range(a, z + 1)) AS t, most FROM e), (SELECT unnest(['Matched', 'Absorber', 'Absorbed', 'Deleted']) AS g))
SELECT relative_time, survival_group, coalesce(n, 0) AS n, y_max FROM grid LEFT JOIN c USING (relative_time, survival_group)""",
    "absorbed_cohorts": _SURVIVAL
    + """, s AS (SELECT * FROM lives WHERE median_similarity IS NOT NULL), h AS (SELECT method_id, list(relative_time) AS t FROM s WHERE survival_group = 'Absorbed' GROUP BY method_id),
m AS (SELECT method_id, 'at_end_only' AS cohort FROM h WHERE list_contains(t, 0) AND NOT list_contains(t, -1) UNION ALL SELECT method_id, 'before_end' FROM h WHERE list_contains(t, -1)
  UNION ALL SELECT method_id, 'lived_2' FROM h WHERE list_contains(t, -2) AND NOT list_contains(t, -3) UNION ALL SELECT method_id, 'lived_10' FROM h WHERE list_contains(t, -10) AND NOT list_contains(t, -11)),
u AS (SELECT cohort, relative_time, median_similarity AS v FROM s JOIN m USING (method_id) WHERE survival_group = 'Absorbed' UNION ALL SELECT 'absorbers', relative_time, median_similarity FROM s WHERE survival_group = 'Absorber' AND relative_time = 0)
SELECT cohort, relative_time, count(*) AS n, count(*) FILTER (WHERE v = 100) AS n_at_100, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, quantile_cont(v, 0.25) AS q1, median(v) AS median, quantile_cont(v, 0.75) AS q3, max(v) AS max FROM u GROUP BY ALL""",
    "column_statistics": f"WITH {BLOCKS_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, avg(CAST({c} AS DOUBLE)) AS mean, median(CAST({c} AS DOUBLE)) AS median, stddev_samp(CAST({c} AS DOUBLE)) AS std, min(CAST({c} AS DOUBLE)) AS min, max(CAST({c} AS DOUBLE)) AS max FROM blocks" for c in ("start_line", "end_line")),
    "similarity_histogram": f"WITH {MEDIANS_SQL} SELECT CAST(floor(median_similarity / 5) * 5 AS DOUBLE) AS bin_from, count(*) AS n FROM medians WHERE median_similarity IS NOT NULL GROUP BY 1",
    "score_correlation": f"WITH {PAIRS_SQL} SELECT 'ngram_overlap' AS x, 'verify_similarity' AS y, corr(ngram_overlap, verify_similarity) AS r FROM pairs WHERE NOT isnan(ngram_overlap) AND NOT isnan(verify_similarity) AND ngram_overlap BETWEEN 0 AND 100 AND verify_similarity BETWEEN 0 AND 100",
    "merge_splits": _LINES + " SELECT method_id, prev_revision_id, prev_loc, curr_loc, is_split, is_merged, is_modified FROM kinds",
    "count_classified": _LINES + " SELECT CASE WHEN is_deleted THEN 'deleted' WHEN is_added THEN 'added' WHEN is_split THEN 'split' WHEN is_merged THEN 'merged' WHEN is_modified THEN 'modified' WHEN is_matched THEN 'matched' ELSE 'other' END AS label, has_clone, count(*) AS n FROM kinds GROUP BY ALL",
    "method_states": f"""WITH {ENRICHED_SQL}, {BLOCKS_SQL}, t AS (SELECT e.*, b.token_hash AS h FROM enriched e LEFT JOIN blocks b ON b.revision_id = e.curr_revision_id AND b.file_path IS NOT DISTINCT FROM e.curr_file_path AND b.method_name IS NOT DISTINCT FROM e.curr_method_name)
SELECT method_id, prev_revision_id, CASE WHEN is_deleted THEN CASE WHEN has_clone THEN 'deleted_from_group' ELSE 'deleted_isolated' END WHEN is_added THEN CASE WHEN has_clone THEN 'added_to_group' ELSE 'added_isolated' END
  WHEN has_clone THEN CASE WHEN prev_token_hash IS DISTINCT FROM h THEN 'survived_clone_modified' ELSE 'survived_clone_unchanged' END ELSE CASE WHEN prev_token_hash IS DISTINCT FROM h THEN 'survived_modified' ELSE 'survived_unchanged' END END AS state FROM t""",
    "audit_triples": _AUDIT,
    "file_deletions": f"""WITH {ENRICHED_SQL}, {_DELETIONS}
SELECT coalesce(contains(prev_file_path, 'test_') OR contains(prev_file_path, '_test'), false) AS is_test_method, coalesce(contains(prev_method_name, '_'), false) AS is_private, has_clone, v.file_path IS NOT NULL AS is_file_deleted, count(*) AS n
FROM enriched e LEFT JOIN vanished v ON v.file_path = e.prev_file_path WHERE is_deleted GROUP BY ALL""",
    "deleted_file_ratio": _GROUP_STATUS.replace("WITH RECURSIVE ", f"WITH RECURSIVE {_DELETIONS}, ", 1)
    + " SELECT count(*) AS n, count(v.file_path) AS n_file_deleted, CASE WHEN count(*) > 0 THEN count(v.file_path) / CAST(count(*) AS DOUBLE) END AS ratio FROM stated s LEFT JOIN vanished v ON v.file_path = s.prev_file_path WHERE is_deleted AND is_all_deleted",
    "rules_by_pattern": f"SELECT snippet_id, {_RULE_COLUMNS} FROM code_snippets",
    "rule_evaluation": _SAMPLES
    + f", ruled AS (SELECT is_deleted AS t, {_RULE_COLUMNS} FROM samples), n AS ("
    + " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) FILTER (WHERE {r} AND t) AS tp, count(*) FILTER (WHERE {r} AND NOT t) AS fp, count(*) FILTER (WHERE NOT {r} AND t) AS fn, count(*) FILTER (WHERE NOT {r} AND NOT t) AS tn FROM ruled" for r in _RULE_NAMES)
    + ") SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) END AS precision, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1 FROM n",
    "rule_outcomes": _SAMPLES + f", ruled AS (SELECT snippet_id, is_deleted, {_RULE_COLUMNS} FROM samples) " + " UNION ALL ".join(f"SELECT snippet_id, is_deleted, '{r}' AS rule, CASE WHEN {r} THEN CASE WHEN is_deleted THEN 'TP' ELSE 'FP' END ELSE CASE WHEN is_deleted THEN 'FN' ELSE 'TN' END END AS outcome FROM ruled" for r in _RULE_NAMES),
    "deleted_soon": f"WITH {TRACKED_SQL} SELECT method_id, prev_revision_id, is_deleted, coalesce(bool_or(is_deleted) OVER (PARTITION BY method_id ORDER BY prev_revision_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), false) AS is_deleted_soon FROM tracked WHERE prev_revision_id IS NOT NULL",
    "code_patterns": f"SELECT snippet_id, {_LABELS} FROM (SELECT *, {_CODE_LINES} FROM code_snippets)",
    "pattern_statistics": _SAMPLES
    + f""", labelled AS (SELECT snippet_id, is_deleted, unnest(detected_patterns) AS pattern FROM (SELECT snippet_id, is_deleted, {_LABELS} FROM (SELECT *, {_CODE_LINES} FROM samples))),
n AS (SELECT pattern, count(*) FILTER (WHERE is_deleted) AS deleted, count(*) FILTER (WHERE NOT is_deleted) AS survived, coalesce(list_sort(list(snippet_id) FILTER (WHERE is_deleted))[1:3], CAST([] AS BIGINT[])) AS examples FROM labelled GROUP BY pattern)
SELECT pattern, deleted, survived, deleted / CAST(deleted + survived AS DOUBLE) AS ratio, CASE WHEN deleted / (deleted + survived) > 0.5 THEN 'high' WHEN deleted / (deleted + survived) < 0.3 THEN 'protective' ELSE 'neutral' END AS risk,
  CASE WHEN deleted / (deleted + survived) > 0.6 THEN 'strong' WHEN deleted / (deleted + survived) > 0.4 THEN 'balanced' ELSE 'weak' END AS band, examples FROM n""",
    "characteristics": _SAMPLES
    + " SELECT is_deleted, count(*) AS n, "
    + ", ".join(
        f"round(avg(CAST(coalesce({t}, false) AS INTEGER)) * 100, 2) AS {k}_percent"
        for k, t in {"docstring": _DOC, "try_except": "contains(code, 'try:') AND contains(code, 'except')", "debt_marker": _any("code", ["TODO", "FIXME"]), "private": "starts_with(function_name, '_')", "property": "contains(code, '@property')"}.items()
    )
    + " FROM samples GROUP BY is_deleted",
    "basic_statistics": _SAMPLES + " SELECT is_deleted, count(*) AS n, avg(CASE WHEN loc > 0 THEN loc END) AS mean_loc, avg(clone_group_size) AS mean_group_size, count(*) / CAST((SELECT count(*) FROM samples) AS DOUBLE) AS share FROM samples GROUP BY is_deleted",
    "match_types": _SAMPLES + " SELECT is_deleted, CASE WHEN clone_group_size > 1 THEN 'many' WHEN clone_group_size = 1 THEN 'one' ELSE 'none' END AS match_type, count(*) AS n FROM samples GROUP BY ALL",
    "stratified_sample": _SAMPLES + " SELECT snippet_id, is_deleted FROM (SELECT *, row_number() OVER (PARTITION BY is_deleted ORDER BY snippet_id) AS k FROM samples) WHERE k <= 50",
}
ORACLES["state_counts"] = f"SELECT prev_revision_id, state, count(*) AS n FROM ({ORACLES['method_states']}) GROUP BY ALL"
ORACLES["method_overview"] = f"""WITH {ENRICHED_SQL}, t AS (SELECT * FROM enriched WHERE prev_revision_id IS NOT NULL), l AS (SELECT count(DISTINCT prev_revision_id) AS n FROM t GROUP BY method_id)
SELECT count(*) AS n_rows, count(DISTINCT method_id) AS n_methods, avg(CAST(has_clone AS INTEGER)) AS clone_rate, (SELECT avg(n) FROM l) AS mean_lifetime, (SELECT max(n) FROM l) AS longest_lifetime FROM t"""
