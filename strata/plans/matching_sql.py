"""SQL for the matching chain, the identifiers on top of it, and what else needs sequences, line by line states or exact tests."""

from __future__ import annotations

from strata.operators.significance import CLONE_METRICS, SIMILARITY_METRICS
from strata.plans import reference_sql as base

_SIG = base._SIG
_SIDE = ("revision_id", "token_hash", *_SIG)

# The longest common subsequence a bit per place of s, in words of 60 bits; `m` has, for each token of t in order, the places of s with that token.
_ONES = (1 << 60) - 1
_STEP = f"""lambda v, x: list_reduce(list_transform(range(1, len(v) + 1), lambda w: [v[w], x[w]]), lambda r, p: list_concat([(p[1] + (p[1] & p[2]) + r[1]) >> 60], r[2:], [((p[1] + (p[1] & p[2]) + r[1]) & {_ONES}) | (p[1] - (p[1] & p[2]))]), [0::BIGINT])[2:]"""
_LCS = f"""places AS (SELECT src, token, list(i - 1) AS ps, any_value((n + 59) // 60) AS n_words FROM (SELECT src, s[i] AS token, i, n FROM (SELECT src, s, len(s) AS n, unnest(range(1, len(s) + 1)) AS i FROM (SELECT DISTINCT src, s FROM found))) GROUP BY src, token),
masks AS (SELECT src, token, list_transform(range(n_words), lambda w: CAST(coalesce(list_sum(list_transform(list_filter(ps, lambda p: p // 60 = w), lambda p: 1::BIGINT << (p % 60)::INTEGER)), 0) AS BIGINT)) AS m FROM places),
lined_up AS (SELECT f.src, f.tgt, f.n, list(coalesce(k.m, list_transform(range((f.n + 59) // 60), lambda w: 0::BIGINT)) ORDER BY f.j) AS m
  FROM (SELECT src, tgt, len(s) AS n, t, unnest(range(1, len(t) + 1)) AS j FROM found) f LEFT JOIN masks k ON k.src = f.src AND k.token = f.t[f.j] GROUP BY f.src, f.tgt, f.n),
ratios AS (SELECT src, tgt, list_sum(list_transform(list_reduce(m, {_STEP}, list_transform(range((n + 59) // 60), lambda w: {_ONES}::BIGINT)), lambda w: 60 - bit_count(w))) / CAST(n AS DOUBLE) AS raw_similarity FROM lined_up)"""

_SIMILAR = (
    base._SIM_STEPS
    + f""", found AS (SELECT h.src, h.tgt, p.s, q.s AS t FROM shared h JOIN sizes x ON x.token_hash = h.src JOIN seqs p ON p.token_hash = h.src JOIN seqs q ON q.token_hash = h.tgt
  WHERE h.n_shared >= x.n * 0.1 AND list_has_any(p.src, q.tgt) AND len(q.s) >= 0.7 * len(p.s)),
{_LCS},
alike AS (SELECT src, tgt, raw_similarity, CAST(printf('%.2f', raw_similarity) AS DOUBLE) AS similarity FROM ratios WHERE raw_similarity >= 0.7
  UNION ALL SELECT token_hash, token_hash, 1.0, 1.0 FROM seqs WHERE len(s) >= 5 AND list_has_any(src, tgt))"""
)


def _columns(*parts: tuple[str, str, tuple[str, ...]]) -> str:
    """`table.column AS name_column` of several sides."""
    return ", ".join(f"{table}.{c} AS {name}_{c}" for table, name, columns in parts for c in columns)


_ORDER = ", ".join(f"n.{c} NULLS LAST" for c in _SIG)
_PREV_KEYS = ", ".join(f"p.{c}" for c in ("revision_id", *_SIG))
_SIM = (
    _SIMILAR
    + f""", options AS (SELECT {_columns(("p", "prev", _SIDE), ("n", "curr", _SIDE))}, m.similarity,
    row_number() OVER (PARTITION BY {_PREV_KEYS} ORDER BY m.similarity DESC NULLS LAST, {_ORDER}, m.tgt) AS k
  FROM blocks p JOIN steps st ON st.revision_id = p.revision_id AND st.r1 IS NOT NULL
  LEFT JOIN (alike m JOIN blocks n ON n.token_hash = m.tgt) ON m.src = p.token_hash AND n.revision_id = st.r1),
sim AS (SELECT * EXCLUDE (k), similarity IS NOT NULL AS is_sim_matched, similarity IS NULL AS is_sim_deleted, false AS is_sim_added FROM options WHERE k = 1)"""
)


def _signature_join(a: str, b: str) -> str:
    return " AND ".join(f"{a}.prev_{c} IS NOT DISTINCT FROM {b}.prev_{c}" for c in ("revision_id", *_SIG))


def _combined(prefer: bool) -> str:
    take = "g.is_sig_matched" if prefer else "g.is_sig_matched AND NOT m.is_sim_matched"
    sig = base._SIGNATURES.split(", sig AS (", 1)[1]
    return (
        _SIM
        + f", sig AS ({sig}, combined AS (SELECT {', '.join(f'm.prev_{c}' for c in _SIDE)}, "
        + ", ".join(f"CASE WHEN {take} THEN g.curr_{c} ELSE m.curr_{c} END AS curr_{c}" for c in _SIDE)
        + f""", CASE WHEN {take} THEN h.similarity ELSE m.similarity END AS similarity, m.is_sim_matched, m.is_sim_deleted, m.is_sim_added, g.is_sig_matched, g.is_sig_deleted, false AS is_sig_added,
    g.is_sig_matched OR m.is_sim_matched AS is_matched, g.is_sig_deleted AND m.is_sim_deleted AS is_deleted, false AS is_added
  FROM sim m JOIN sig g ON {_signature_join("m", "g")} LEFT JOIN alike h ON h.src = m.prev_token_hash AND h.tgt = g.curr_token_hash)"""
    )


def _name(side: str) -> str:
    parts = [f"CAST({side}_revision_id AS VARCHAR)", *(f"{side}_{c}" for c in _SIG)]
    return "md5(" + " || ".join(f"coalesce(length({p}) || ':' || {p}, '-')" for p in parts) + ")"


_IDS = (
    _combined(True).replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", named AS (SELECT *, {_name("prev")} AS p, CASE WHEN curr_revision_id IS NOT NULL THEN {_name("curr")} END AS c, {" AND ".join(f"prev_{c} IS NOT DISTINCT FROM curr_{c}" for c in _SIG)} AS same FROM combined),
heads AS (SELECT * FROM (SELECT c, p, same, count(*) OVER (PARTITION BY c) AS n, row_number() OVER (PARTITION BY c ORDER BY NOT is_sig_matched, -coalesce(similarity, -1), {", ".join(f"prev_{c} NULLS LAST" for c in _SIG)}, p) AS k FROM named WHERE c IS NOT NULL) WHERE k = 1),
climb AS (SELECT DISTINCT p AS v, p AS u, 0 AS depth FROM named UNION ALL SELECT climb.v, h.p, depth + 1 FROM climb JOIN heads h ON h.c = climb.u),
roots AS (SELECT v, arg_max(u, depth) AS method_id FROM climb GROUP BY v)
SELECT n.* EXCLUDE (p, c, same), r.method_id, n.c IS NOT NULL AND coalesce(h.n > 1, false) AND (h.p <> n.p OR NOT h.same) AS is_absorbed, n.c IS NOT NULL AND coalesce(h.n > 1, false) AND h.p = n.p AND h.same AS is_absorber
FROM named n JOIN roots r ON r.v = n.p LEFT JOIN heads h ON h.c = n.c"""
)

_TRACK = f"""WITH RECURSIVE {base.PAIRS_SQL}, {base._PER_REVISION},
steps AS (SELECT * FROM (SELECT revision_id, lead(revision_id) OVER (ORDER BY revision_id) AS r1 FROM (SELECT DISTINCT revision_id FROM pairs)) WHERE r1 IS NOT NULL),
sized AS (SELECT revision_id, group_id, count(*) AS n FROM groups GROUP BY ALL),
common AS (SELECT a.revision_id, b.revision_id AS next_revision_id, a.group_id, b.group_id AS next_group_id, count(*) AS n_common
  FROM groups a JOIN steps s ON s.revision_id = a.revision_id JOIN groups b ON b.revision_id = s.r1 AND b.token_hash = a.token_hash GROUP BY ALL),
linked AS (SELECT c.*, a.n AS n_members, b.n AS n_next, count(*) OVER (PARTITION BY c.revision_id, c.group_id) AS n_out, count(*) OVER (PARTITION BY c.next_revision_id, c.next_group_id) AS n_in
  FROM common c JOIN sized a ON a.revision_id = c.revision_id AND a.group_id = c.group_id JOIN sized b ON b.revision_id = c.next_revision_id AND b.group_id = c.next_group_id WHERE n_common >= 0.5 * least(a.n, b.n))
SELECT revision_id, next_revision_id, group_id, next_group_id, CASE WHEN n_out > 1 THEN 'split' WHEN n_in > 1 THEN 'merged' WHEN n_next > n_members THEN 'grown' WHEN n_next < n_members THEN 'shrunk' ELSE 'continued' END AS state, n_members, n_next, n_common, n_next - n_common AS member_added, n_members - n_common AS member_removed FROM linked
UNION ALL SELECT z.revision_id, s.r1, z.group_id, NULL, 'dissolved', z.n, NULL, 0, 0, z.n FROM sized z JOIN steps s ON s.revision_id = z.revision_id WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.revision_id = z.revision_id AND l.group_id = z.group_id)
UNION ALL SELECT s.revision_id, z.revision_id, NULL, z.group_id, 'born', NULL, z.n, 0, z.n, 0 FROM sized z JOIN steps s ON s.r1 = z.revision_id WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.next_revision_id = z.revision_id AND l.next_group_id = z.group_id)"""

# Two-sided p: by counting all subsets of ranks without ties and zeros, else 1 - erf(z / sqrt 2) by the series x^(2k+1) e^(-x^2) / gamma(k + 3/2).
_P_VALUE = """, used_ties AS (SELECT metric, sum(t * t * t - t) AS tied, max(t) AS most FROM (SELECT metric, a, count(*) AS t FROM used GROUP BY ALL) GROUP BY metric),
signed AS ({ranks}),
z AS (SELECT s.*, coalesce(most, 1) AS most, abs(least(w_plus, w_minus) - n_used * (n_used + 1) / 4) / sqrt(2 * (n_used * (n_used + 1) * (2 * n_used + 1) / 24 - coalesce(tied, 0) / 48)) AS x FROM signed s LEFT JOIN used_ties USING (metric))
SELECT * EXCLUDE (x, most), CASE WHEN n_used = 0 THEN 1.0 WHEN n_used = n_pairs AND most = 1 AND n_used <= 50 THEN least(1.0, 2 * (SELECT count(*) FROM range(CAST(pow(2, n_used) AS BIGINT)) m(bits) WHERE list_sum(list_transform(range(1, n_used + 1), lambda i: i * ((bits >> (i - 1)) & 1))) <= floor(least(w_plus, w_minus))) / pow(2, n_used))
  WHEN x = 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(200), lambda k: exp((2 * k + 1) * ln(x) - x * x - lgamma(k + 1.5)))) END AS p_value FROM z"""


def _wilcoxon(columns, metrics) -> str:
    head, ranks = base._signed_ranks(columns, metrics).rsplit("\nSELECT metric,", 1)
    return head + _P_VALUE.format(ranks="SELECT metric," + ranks)


# White space as Unicode has it, which RE2's \s is not.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_FOLD = rf"""WITH RECURSIVE split AS (SELECT snippet_id, list_transform(string_split(code, chr(10)), lambda x: {_strip("x")}) AS lines FROM code_snippets WHERE code IS NOT NULL),
parts AS (SELECT snippet_id, 'body' AS mode, lines FROM split UNION ALL SELECT snippet_id, 'effective', CASE WHEN starts_with(lines[1], 'def ') OR starts_with(lines[1], 'async def ') THEN lines[2:] ELSE lines END FROM split),
marks AS (SELECT snippet_id, mode, i, lines[i] AS line, CASE WHEN starts_with(lines[i], '{'"' * 3}') THEN 'd' WHEN starts_with(lines[i], repeat('''', 3)) THEN 's' ELSE '' END AS quote FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM parts)),
facts AS (SELECT *, mode = 'body' AND (starts_with(line, 'def ') OR starts_with(line, 'async def ')) AS is_def, len(line) - len(replace(line, CASE quote WHEN 'd' THEN '{'"' * 3}' ELSE repeat('''', 3) END, '')) >= 6 AS twice FROM marks),
run AS (SELECT snippet_id, mode, 0::BIGINT AS i, '' AS open, mode = 'body' AS skip, CAST([] AS VARCHAR[]) AS kept FROM parts
  UNION ALL SELECT r.snippet_id, r.mode, f.i,
    CASE WHEN r.skip AND is_def THEN open WHEN quote <> '' AND open = '' THEN CASE WHEN twice THEN '' ELSE quote END WHEN quote <> '' AND quote = open THEN '' ELSE open END,
    r.skip AND NOT is_def,
    CASE WHEN (r.skip AND is_def) OR (quote <> '' AND (open = '' OR quote = open)) OR open <> '' OR line = '' OR starts_with(line, '#') THEN kept ELSE list_append(kept, line) END
  FROM run r JOIN facts f ON f.snippet_id = r.snippet_id AND f.mode = r.mode AND f.i = r.i + 1),
ends AS (SELECT snippet_id, mode, arg_max(kept, i) AS kept FROM run GROUP BY ALL),
rules AS (SELECT s.snippet_id, coalesce(len(e.kept) <= 3, false) AS rule_short_method, coalesce(len(list_filter(b.kept, lambda x: x NOT IN ('pass', '...', 'return', 'return None'))) = 0, false) AS rule_empty_method,
  coalesce(len(b.kept) = 1 AND starts_with(b.kept[1], 'return'), false) AS rule_single_return
  FROM code_snippets s LEFT JOIN ends e ON e.snippet_id = s.snippet_id AND e.mode = 'effective' LEFT JOIN ends b ON b.snippet_id = s.snippet_id AND b.mode = 'body')"""

_REPORTS = f"reports AS (SELECT doc_id, text FROM documents WHERE lower({_strip('source')}) = 'clone_report' AND text IS NOT NULL)"
_WHOLE = r"CASE WHEN regexp_full_match({0}, '[+-]?[0-9]+') THEN try_cast({0} AS BIGINT) END"
_MEMBERS = rf"""{_REPORTS}, tables AS (SELECT doc_id, string_split({_strip(r"regexp_extract(text, '(?s)## Members.*?\n\n(.*?)(?:\n##|\z)', 1)")}, chr(10)) AS lines FROM reports),
table_rows AS (SELECT doc_id, i - 3 AS row, string_split(lines[i], '|') AS parts FROM (SELECT *, unnest(range(3, len(lines) + 1)) AS i FROM tables) WHERE starts_with(lines[i], '|')),
cells AS (SELECT doc_id, row, list_transform(parts[2:len(parts) - 1], lambda x: {_strip("x")}) AS c FROM table_rows WHERE len(parts) >= 10),
typed AS (SELECT *, {_strip("string_split(c[5], '-')[1]")} AS first, CASE WHEN contains(c[5], '-') THEN {_strip("string_split(c[5], '-')[2]")} ELSE {_strip("string_split(c[5], '-')[1]")} END AS last FROM cells),
members AS (SELECT doc_id, CAST(row AS INTEGER) AS row, c[2] AS state, replace(c[3], '...', '') AS function, replace(c[4], '...', '') AS file, {_WHOLE.format("first")} AS start_line, {_WHOLE.format("last")} AS end_line, {_WHOLE.format("c[6]")} AS loc, c[7] AS revision, try_cast(replace(c[8], '%', '') AS DOUBLE) AS similarity FROM typed),
good AS (SELECT * FROM members WHERE start_line IS NOT NULL AND end_line IS NOT NULL AND loc IS NOT NULL AND similarity IS NOT NULL)"""


def _fenced(title: str) -> str:
    pattern = rf"(?s)#### {title}.*?```python\n(.*?)```"
    return f"CASE WHEN regexp_matches(part, '{pattern}') THEN {_strip(f'regexp_extract(part, {chr(39)}{pattern}{chr(39)}, 1)')} END"


_OVERVIEW = r"""SELECT doc_id, coalesce(try_cast(nullif(regexp_extract(text, '\|\s*Members\s*\|\s*([0-9]+)', 1), '') AS BIGINT), 0) AS members, coalesce(nullif(regexp_extract(text, '\|\s*Match Type\s*\|\s*`([^`]+)`', 1), ''), 'unknown') AS match_type,
  coalesce(try_cast(nullif(regexp_extract(text, '\|\s*Avg Similarity\s*\|\s*([0-9.]+)%', 1), '') AS DOUBLE), 0.0) AS avg_similarity FROM reports"""

ORACLES: dict[str, str] = {
    "similar_sequences": _SIMILAR + " SELECT * FROM alike",
    "similarity_match": _SIM + " SELECT * FROM sim",
    "combined_match": _combined(True) + " SELECT * FROM combined",
    "combined_match_most_similar": _combined(False) + " SELECT * FROM combined",
    "added_methods": _combined(True)
    + f" SELECT {_columns(('b', 'curr', _SIDE))} FROM blocks b JOIN (SELECT r1 FROM steps WHERE r1 IS NOT NULL) s ON s.r1 = b.revision_id WHERE NOT EXISTS (SELECT 1 FROM combined m WHERE m.curr_revision_id = b.revision_id AND {' AND '.join(f'm.curr_{c} IS NOT DISTINCT FROM b.{c}' for c in _SIG)})",
    "progressive_match": _SIM + " SELECT *, CASE WHEN similarity >= 0.9 THEN 0.9 WHEN similarity >= 0.8 THEN 0.8 ELSE 0.7 END::DOUBLE AS threshold FROM sim WHERE is_sim_matched",
    "method_ids": _IDS,
    "group_tracking": _TRACK,
    "wilcoxon_by_clone": _wilcoxon(base._BY_CLONE, CLONE_METRICS),
    "wilcoxon_by_similarity": _wilcoxon(base._BY_SIMILARITY, SIMILARITY_METRICS),
    "audit_documents": f"SELECT kind, revision_id, row, '{{\"' || row || '\":{{\"matched\":[' || array_to_string(matched, ',') || ']}}}}' AS document FROM ({base._AUDIT})",
    "rules_by_lines": _FOLD + " SELECT * FROM rules",
    "report_overview": f"WITH {_REPORTS} {_OVERVIEW}",
    "report_match_types": f"WITH {_REPORTS} SELECT match_type, count(*) AS n FROM ({_OVERVIEW}) GROUP BY match_type",
    "report_members": f"WITH {_MEMBERS} SELECT * FROM good",
    "report_methods": rf"""WITH {_MEMBERS}, sections AS (SELECT doc_id, i - 2 AS section, parts[i] AS part FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\n### [0-9]+\.') AS parts FROM reports))),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row) - 1 AS section FROM good), overview AS ({_OVERVIEW})
SELECT n.* EXCLUDE (section), CAST(n.section AS INTEGER) AS section, {_fenced("Current")} AS current, {_fenced("Previous")} AS previous, o.members, o.match_type, o.avg_similarity FROM numbered n LEFT JOIN sections s USING (doc_id, section) JOIN overview o USING (doc_id)""",
}
ORACLES |= {
    "top_patterns": f"SELECT * EXCLUDE (examples) FROM ({base.ORACLES['pattern_statistics']}) ORDER BY ratio DESC, deleted DESC, pattern LIMIT 10",
    "first_deleted_sample": base._SAMPLES + " SELECT snippet_id, function_name FROM (SELECT s.snippet_id, c.function_name, c.code, s.is_deleted FROM samples s JOIN code_snippets c USING (snippet_id)) WHERE is_deleted AND code IS NOT NULL ORDER BY snippet_id LIMIT 1",
    "ground_truth": f"WITH {base.BLOCKS_SQL} SELECT r.revision_id, s.global_block_id, s.revision, s.snippet_id, b.method_name, b.token_hash FROM code_snippets s JOIN (SELECT DISTINCT revision_dir, revision_id FROM revisions WHERE revision_id IS NOT NULL) r ON r.revision_dir = s.revision JOIN blocks b ON b.revision_id = r.revision_id AND CAST(b.block_id AS VARCHAR) = s.global_block_id",
    "group_statistics": base._SNAPSHOT + " SELECT revision_id, count(*) AS n_groups, CAST(sum(n_members) AS BIGINT) AS n_members, avg(n_members) AS mean_members, max(n_members) AS most_members, avg(density) AS mean_density, avg(avg_similarity) AS mean_similarity FROM snapshot GROUP BY revision_id",
    "group_state_counts": f"SELECT revision_id, state, count(*) AS n FROM ({_TRACK}) GROUP BY ALL",
    "formatted_means": base._rate_table(base._BY_CLONE)
    + ", cells AS ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, {a} AS f, {b} AS s FROM rates" for m, (a, b) in CLONE_METRICS.items())
    + ") SELECT metric, "
    + ", ".join(f"CASE WHEN metric LIKE '%rate' THEN printf('%.3f', avg({c}) / 100) ELSE format('{{:,}}', CAST(round_even(avg({c}), 0) AS BIGINT)) END AS mean_{n}" for c, n in (("f", "first"), ("s", "second")))
    + " FROM cells WHERE f IS NOT NULL AND s IS NOT NULL GROUP BY metric",
    "classified_union": f"WITH {base.TRACKED_SQL} SELECT method_id, prev_revision_id, prev_file_path AS deleted_from, NULL AS moved_to FROM tracked WHERE prev_revision_id IS NOT NULL AND is_deleted UNION ALL SELECT method_id, prev_revision_id, NULL, curr_file_path FROM tracked WHERE prev_revision_id IS NOT NULL AND is_matched AND prev_file_path IS DISTINCT FROM curr_file_path",
    "revision_names": r"SELECT revision_dir, CASE WHEN regexp_matches(revision_dir, '^[0-9]{8}_[0-9]{6}_[0-9A-Za-z]+$') THEN try_strptime(left(revision_dir, 15), '%Y%m%d_%H%M%S') END AS time FROM revisions",
    "ingested_blocks": f"""SELECT v.revision_id, p.* EXCLUDE (raw_id, revision_dir, line_no, method_name), n.method_name FROM ({base.P1_ROWS_SQL}) p JOIN ({base.ORACLES['renamed_duplicates']}) n USING (raw_id)
  JOIN (SELECT DISTINCT revision_dir, try_strptime(left(revision_dir, 15), '%Y%m%d_%H%M%S') AS revision_id FROM revisions WHERE regexp_matches(revision_dir, '^[0-9]{{8}}_[0-9]{{6}}_[0-9A-Za-z]+$')) v ON v.revision_dir = p.revision_dir AND v.revision_id IS NOT NULL
  WHERE p.revision_dir IN (SELECT revision_dir FROM revisions r JOIN clone_pairs c ON c.revision_id = r.revision_id)""",
    "ingested_pairs": f"WITH {base.PAIRS_SQL}, named AS (SELECT DISTINCT revision_dir, revision_id FROM revisions WHERE revision_id IS NOT NULL) SELECT p.token_hash_1, p.token_hash_2, p.ngram_overlap, p.verify_similarity, n.revision_id FROM pairs p JOIN named n ON n.revision_id = p.revision_id WHERE n.revision_dir IN (SELECT revision_dir FROM ({base.P1_ROWS_SQL}))",
    "stage_as_csv": f"WITH {base.TRACKED_SQL} SELECT method_id, prev_revision_id, prev_file_path, similarity, is_matched FROM tracked",
    "stage_as_json": base._SAMPLES + " SELECT s.snippet_id, c.function_name, c.code, c.loc, s.is_deleted FROM samples s JOIN code_snippets c USING (snippet_id)",
    "rates_from_pivot": base._rate_table(base._BY_CLONE) + " SELECT CAST(prev_revision_id AS TIMESTAMP) AS revision, * EXCLUDE (prev_revision_id) FROM rates",
}
