"""Operators of the analysis on small fixtures."""

import datetime as dt
import random
import subprocess

import pytest
from compare import against_sql, connection
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata import cli
from strata.functions import responses, sequences
from strata.functions.code import body_lines, effective_lines, last_component
from strata.operators import audits, clones, history, lineage, matching, patterns, rates, rules, significance, survival
from strata.operators.deliveries import latest
from strata.plans import inputs, reference
from strata.session import stored
from strata.sources import config, reports, repository, revisions
from strata.streaming import incremental

R = [dt.datetime(2024, m, 1) for m in range(1, 8)]


def textbook_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 4), max_size=90), st.lists(st.integers(0, 4), max_size=90)), min_size=1, max_size=5))
def test_lcs(pairs):
    import numpy as np

    want = [textbook_lcs(a, b) for a, b in pairs]
    assert [sequences.lcs_length(a, b) for a, b in pairs] == want
    flat = [np.array([x for p in pairs for x in p[i]], np.int64) for i in (0, 1)]
    sizes = [np.array([len(p[i]) for p in pairs], np.int64) for i in (0, 1)]
    assert sequences.lcs_lengths(flat[0], sizes[0], flat[1], sizes[1]).tolist() == want


def test_lcs_of_long_sequences():
    import numpy as np

    rnd = np.random.default_rng(3)
    for n, m in ((600, 40), (40, 600), (3000, 2500), (64, 64), (65, 128)):
        a, b = rnd.integers(0, 9, n), rnd.integers(0, 9, m)
        want = sequences.lcs_length(a.tolist(), b.tolist())
        assert want == textbook_lcs(a.tolist(), b.tolist())
        assert sequences.lcs_lengths(a, np.array([n]), b, np.array([m])).tolist() == [want]


def test_sequences(spark):
    df = spark.createDataFrame([("[1;2;3;1;2;3;1]",), ("[]",), (None,), ("",), ("[4]",), ("[1;x]",)], "t string").withColumn("s", sequences.parse_tokens("t"))
    rows = df.select("s", sequences.gram_digests("s", 3).alias("g"), sequences.lcs_native(F.col("s"), F.array(F.lit(3), F.lit(1))).alias("n")).collect()
    assert [r["s"] for r in rows] == [[1, 2, 3, 1, 2, 3, 1], [], None, None, [4], [1, None]]
    assert [len(r["g"]) for r in rows] == [3, 0, 0, 0, 0, 0] and rows[0]["n"] == 2
    pairs = spark.createDataFrame([(1, [1, 2, 3], [1, 3, 1]), (2, None, [1]), (3, [], [1]), (4, [None, 7], [7, None]), (5, [5], None), (6, list(range(40)), list(range(29)))], "k int, a array<int>, b array<int>")
    got = {r["k"]: (r["raw_similarity"], r["similarity"]) for r in sequences.compare_sequences(pairs, ["k"], "a", "b", 0.0).collect()}
    assert got == {1: (2 / 3, 0.67), 4: (0.5, 0.5), 5: (0.0, 0.0), 6: (0.725, round(0.725, 2))}
    assert sequences.compare_sequences(pairs.limit(0), ["k"], "a", "b", 0.0).count() == 0


def test_frequent_grams_lose_no_candidate(spark):
    """Every sequence shares a stretch, so its grams are frequent; the rows are those of plain counting, whatever counts as frequent."""
    rnd = random.Random(5)
    common = [900 + i for i in range(9)]
    rows = [block(r, f"m{i}", [rnd.randrange(6) for _ in range(rnd.randrange(20, 60))] + common * (i % 3 > 0), f"h{i}") for i in range(40) for r in (0, 1)]
    seqs = stored(matching.sequence_steps(spark.createDataFrame(rows, B)))
    plain, pruned = ({tuple(r) for r in matching.similarity_candidates(seqs, often=k).collect()} for k in (10**6, 2))
    assert plain == pruned and len(plain) > 100
    assert matching.similarity_candidates(seqs.limit(0)).count() == 0


B = "revision_id timestamp_ntz, file_path string, method_name string, return_type string, parameters string, block_id long, start_line long, end_line long, token_hash string, token_sequence array<int>"


def block(r, name, tokens, h=None, path="a.py", ret=None, par="self"):
    return (R[r], path, name, ret, par, abs(hash((r, path, name))) % 10**9, 1, 9, h or str(tokens), tokens)


def test_matching_brute_force(spark):
    rnd = random.Random(7)
    base = [[rnd.randrange(6) for _ in range(rnd.randrange(3, 30))] for _ in range(8)]
    rows = []
    for r in range(3):
        for i in range(12):
            t = list(rnd.choice(base))
            if t and rnd.random() < 0.5:
                t[rnd.randrange(len(t))] = 9
            rows.append(block(r, f"m{rnd.randrange(6)}_{i}", t, ret=rnd.choice([None, "int"])))
    blocks = spark.createDataFrame(rows, B)
    similar = matching.similar_sequences(blocks)
    got = {(r["src"], r["tgt"]): r["similarity"] for r in similar.collect()}
    grams = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    seqs = {r[8]: r[9] for r in rows}
    meets = {(a[8], b[8]) for a in rows for b in rows if R.index(b[0]) == R.index(a[0]) + 1}
    want = {}
    for a, b in meets:
        s, t = seqs[a], seqs[b]
        if grams(s) and len(grams(s) & grams(t)) >= 0.1 * len(grams(s)) and textbook_lcs(s, t) >= 0.7 * len(s):
            want[a, b] = round(textbook_lcs(s, t) / len(s), 2)
    assert {k: v for k, v in got.items() if k in want or k[0] != k[1]} == want
    near = {(r["src"], r["tgt"]) for r in matching.similar_sequences(blocks, approximate=True).collect()}
    surely = {k for k in want if len(grams(seqs[k[0]]) & grams(seqs[k[1]])) >= 0.6 * len(grams(seqs[k[0]]) | grams(seqs[k[1]]))}
    assert len(near & surely) >= 0.9 * len(surely)
    best = matching.similarity_match(blocks, similar).collect()
    assert len(best) == 24
    for r in best:
        options = [v for (a, b), v in want.items() if a == r["prev_token_hash"] and any(x[8] == b and x[0] == R[R.index(r["prev_revision_id"]) + 1] for x in rows)]
        assert r["similarity"] == (max(options) if options else None)
        assert r["is_sim_matched"] == bool(options) and r["is_sim_deleted"] == (not options)


def test_lsh_recall_over_all_true_pairs(spark):
    b = stored(inputs.blocks(spark, "/root/testdata/sf0.01", tokens=True))
    exact, near = ({(r["src"], r["tgt"]) for r in matching.similar_sequences(b, approximate=a).where("src <> tgt").collect()} for a in (False, True))
    assert len(exact) > 300 and len(near & exact) >= 0.9 * len(exact)


def test_signature_matches_nulls(spark):
    t = [1, 2, 3, 4, 5, 6]
    blocks = spark.createDataFrame([block(0, "f", t), block(1, "f", t), block(0, "g", t, ret="int"), block(1, "g", t), block(2, "f", t, par=None)], B)
    got = {(r["prev_revision_id"], r["prev_method_name"]): r["is_sig_matched"] for r in matching.signature_match(blocks).collect()}
    assert got == {(R[0], "f"): True, (R[0], "g"): False, (R[1], "f"): False, (R[1], "g"): False}
    assert matching.signature_match(blocks.limit(0)).count() == 0
    similar = matching.similar_sequences(blocks)
    merged = matching.combined_match(matching.signature_match(blocks), matching.similarity_match(blocks, similar), similar)
    r = {(x["prev_revision_id"], x["prev_method_name"]): x for x in merged.collect()}
    assert r[R[0], "f"]["curr_method_name"] == "f" and r[R[0], "f"]["similarity"] == 1.0 and r[R[0], "g"]["is_matched"] and not r[R[0], "g"]["is_sig_matched"]


STEP = "prev_revision_id timestamp_ntz, prev_file_path string, prev_method_name string, prev_return_type string, prev_parameters string, curr_revision_id timestamp_ntz, curr_file_path string, curr_method_name string, curr_return_type string, curr_parameters string, similarity double, is_sig_matched boolean, is_matched boolean, is_deleted boolean, is_added boolean"


def step(r, a, b, similarity=1.0):
    side = lambda k, n: (R[k], "a.py", n, None, "self") if n else (None,) * 5
    return (*side(r, a), *side(r + 1, b), similarity, a is not None and a == b, a is not None and b is not None, b is None, a is None)


def by_name(df):
    return {(r["prev_revision_id"], r["prev_method_name"]): r for r in df.collect()}


def test_lineage_cases(spark):
    rows = [step(0, "A", "A"), step(0, "B", "A", 0.8), step(0, "C", "N", 0.9), step(0, "D", "N", 0.8), step(0, "x", "y", 0.9), step(1, "A", "A"), step(1, "N", "N"), step(1, "y", "z", 0.9), step(2, "A", None), step(2, "z", "z"), step(1, None, "new"), step(2, "new", "new")]
    df = spark.createDataFrame(rows, STEP)
    for made in (lineage.assign_ids(df), lineage.assign_ids_in_order(df)):
        got = by_name(made)
        assert got[R[0], "A"]["is_absorber"] and got[R[0], "B"]["is_absorbed"]
        assert got[R[0], "C"]["is_absorbed"] and got[R[0], "D"]["is_absorbed"]
        assert got[R[0], "x"]["method_id"] == got[R[1], "y"]["method_id"] == got[R[2], "z"]["method_id"]
        assert got[R[0], "A"]["method_id"] == got[R[1], "A"]["method_id"] == got[R[2], "A"]["method_id"] != got[R[0], "B"]["method_id"]
    made = lineage.assign_ids(df)
    assert by_name(made)[R[2], "new"]["method_id"] == made.where("is_added").first()["method_id"]
    stats = {r["statistic"]: r["n"] for r in lineage.id_statistics(lineage.assign_ids(df)).collect()}
    assert stats["absorbed"] == 3 and stats["absorbers"] == 1 and stats["rows"] == 12


def test_lineage_forms_agree(spark):
    """Where signature matches lead to their own signature, the form that scales and the ordered pass make the same partition."""
    for seed in range(3):
        rnd = random.Random(seed)
        rows, names = [], sorted({f"m{rnd.randrange(9)}" for _ in range(7)})
        for r in range(5):
            targets = sorted({n if rnd.random() < 0.6 else f"m{rnd.randrange(12)}" for n in names})
            seen = set()
            for n in names:
                b = n if n in targets else rnd.choice([None, *targets])
                rows.append(step(r, n, b, round(rnd.uniform(0.7, 1), 2)))
                seen |= {b} - {None}
            names = sorted(seen)
        df = spark.createDataFrame(rows, STEP)
        a, b = by_name(lineage.assign_ids(df)), by_name(lineage.assign_ids_in_order(df))
        assert a.keys() == b.keys()
        pairs = {(a[k]["method_id"], b[k]["method_id"]) for k in a}
        assert len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})
        assert {k: (a[k]["is_absorbed"], a[k]["is_absorber"]) for k in a} == {k: (b[k]["is_absorbed"], b[k]["is_absorber"]) for k in b}


P = "revision_id timestamp_ntz, token_hash_1 string, token_hash_2 string, ngram_overlap double, verify_similarity double"


def test_clones(spark):
    rows = [(R[0], "a", "b", 80.0, None), (R[0], "a", "c", 10.0, 91.0), (R[0], "b", "a", 0.0, 60.0), (R[1], "c", "d", 99.0, 99.0), (R[1], "e", "e", 1.0, 1.0), (R[0], None, "z", 50.0, 50.0)]
    p = spark.createDataFrame(rows, P)
    m = {(r[0], r[1]): r[2] for r in clones.median_similarity(p).collect()}
    assert m[R[0], "a"] == 72.8 and m[R[0], "b"] == 70.0 and m[R[1], "c"] == 99.0
    groups = {(r[0], r[1]): r[2] for r in clones.cumulative_groups(p).collect()}
    assert groups == {(R[0], "a"): "a", (R[0], "b"): "a", (R[0], "c"): "a", (R[1], "a"): "a", (R[1], "b"): "a", (R[1], "c"): "a", (R[1], "d"): "a", (R[1], "e"): "e"}
    alone = {(r[0], r[1]): r[2] for r in clones.cumulative_groups(p, per_revision=True).collect()}
    assert alone[R[1], "d"] == "c" and (R[1], "a") not in alone
    assert clones.cumulative_groups(p.limit(0)).count() == 0
    t = spark.createDataFrame([(R[1], h, d, True) for h, d in (("a", True), ("b", False), ("c", True), ("e", True))], "prev_revision_id timestamp_ntz, prev_token_hash string, is_deleted boolean, has_clone boolean")
    s = {r["prev_token_hash"]: (r["is_all_deleted"], r["is_partial_deleted"]) for r in clones.with_deletion_status(clones.with_groups(t, clones.cumulative_groups(p))).collect()}
    assert s == {"a": (False, True), "b": (False, False), "c": (False, True), "e": (True, False)}


def test_long_chain_of_clones(spark):
    rows = [(R[0], f"{i:04}", f"{i + 1:04}", 1.0, 1.0) for i in range(30)]
    assert clones.cumulative_groups(spark.createDataFrame(rows, P)).select("group_id").distinct().collect()[0][0] == "0000"


def test_track_groups(spark):
    g = [(R[0], x, "g1") for x in "abcd"] + [(R[0], x, "g2") for x in "xy"] + [(R[1], x, "h1") for x in "ab"] + [(R[1], x, "h2") for x in "cd"] + [(R[1], x, "h3") for x in "pq"]
    groups = spark.createDataFrame(g, "revision_id timestamp_ntz, token_hash string, group_id string")
    got = {(r["group_id"], r["next_group_id"]): r["state"] for r in clones.track_groups(groups, matching.revision_steps(groups)).collect()}
    assert got == {("g1", "h1"): "split", ("g1", "h2"): "split", ("g2", None): "dissolved", (None, "h3"): "born"}


def test_survival(spark):
    rows = [(1, R[i], True, i == 3, False, i == 1, 80.0 + i) for i in range(3)] + [(2, R[0], True, False, False, False, None), (2, R[1], False, True, False, False, 70.0), (3, R[0], True, False, True, False, 100.0)]
    df = spark.createDataFrame(rows, "method_id long, prev_revision_id timestamp_ntz, is_matched boolean, is_deleted boolean, is_absorbed boolean, is_absorber boolean, median_similarity double")
    got = {(r["method_id"], r["prev_revision_id"]): (r["survival_group"], r["relative_time"]) for r in survival.deletion_survival(df).collect()}
    assert got == {(1, R[0]): ("Absorber", -1), (1, R[1]): ("Absorber", 0), (1, R[2]): ("Absorber", 1), (2, R[0]): ("Deleted", -1), (2, R[1]): ("Deleted", 0), (3, R[0]): ("Absorbed", 0)}
    assert survival.survival_areas(survival.deletion_survival(df)).count() == 12
    assert survival.survival_areas(survival.deletion_survival(df.limit(0))).count() == 0


def test_wilcoxon(spark):
    # Published example values: n = 5 all positive gives p = 2 / 2**5.
    assert significance.wilcoxon_p(15, 0, 5, [1] * 5) == pytest.approx(0.0625)
    assert significance.wilcoxon_p(0, 0, 0, []) == 1.0
    assert significance.wilcoxon_p(27, 18, 9, [1] * 9) == pytest.approx(0.65234375)
    assert 0 < significance.wilcoxon_p(30, 6, 8, [2, 2, 4]) < 0.2
    rows = [("m", float(i + 1), 0.0) for i in range(5)] + [("m", None, 1.0), ("n", 1.0, 2.0), ("n", 2.0, 1.0), ("z", 1.0, 1.0)] + [("with_zero", float(i), 0.0) for i in range(6)]
    got = {r["metric"]: r for r in significance.wilcoxon(spark.createDataFrame(rows, "metric string, first double, second double")).collect()}
    # A difference of 0 is left out and rules out the exact form: z = (0 - 7.5) / sqrt(13.75).
    assert got["with_zero"]["n_used"] == 5 and got["with_zero"]["p_value"] == pytest.approx(0.0431144467)
    assert got["m"]["n_used"] == 5 and got["m"]["rank_biserial"] == 1.0 and got["m"]["p_value"] == pytest.approx(0.0625)
    assert got["n"]["w_plus"] == got["n"]["w_minus"] == 1.5 and got["z"]["rank_biserial"] is None and got["z"]["p_value"] == 1.0


def plain_lines(code, first_only):
    """Straight reading of the rules for lines, in plain Python."""
    lines = code.split("\n")
    skip = not first_only
    if first_only and lines[0].strip().startswith(("def ", "async def ")):
        lines = lines[1:]
    out, quote = [], None
    for s in (x.strip() for x in lines):
        if skip and s.startswith(("def ", "async def ")):
            skip = False
        elif s[:3] in ('"""', "'''") and quote is None:
            quote = None if s.count(s[:3]) >= 2 else s[:3]
        elif s[:3] == quote:
            quote = None
        elif quote is None and s and not s.startswith("#"):
            out.append(s)
    return out


LINES = ["def f(a):", "async def g():", '"""One."""', '"""', "'''", "    x = 1", "# note", "", "  return 1", '   """Two', 'three"""', "@property", "pass", "...", "returned = 1"]


def test_lines(spark):
    rnd = random.Random(11)
    codes = ["\n".join(rnd.choice(LINES) for _ in range(rnd.randrange(8))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(codes)), "i int, c string")
    for r in df.select("i", effective_lines(F.col("c")).alias("n"), body_lines(F.col("c")).alias("b")).collect():
        assert r["n"] == len(plain_lines(codes[r["i"]], True)), codes[r["i"]]
        assert r["b"] == plain_lines(codes[r["i"]], False), codes[r["i"]]


def test_rules(spark):
    rows = [
        (1, "@dec\ndef _x(a):\n    '''Doc.'''\n    # TODO later\n    return a", "C._x"),
        (2, "def __y():\n    pass", "__y"),
        (3, "def old_z():\n    warnings.warn('deprecated')\n    a = 1\n    b = 2\n    return df.select(a).loc[b]", "K.old_z"),
        (4, None, None),
        (5, "def t():\n    returned = 1", "debug_t"),
        (6, "", "f"),
    ]
    got = {r["i"]: {k[5:] for k, v in r.asDict().items() if k.startswith("rule_") and v} for r in rules.apply_rules(spark.createDataFrame(rows, "i int, code string, function_name string")).collect()}
    assert got[1] == {"has_todo", "short_method", "private_unused"}  # the decorator is a line of its own
    assert got[2] == {"short_method", "empty_method"}
    assert got[3] == {"has_deprecated", "uses_select", "uses_loc", "deprecated_naming"}
    assert got[4] == set() and got[5] == {"short_method", "single_return", "temporary_naming"} and got[6] == {"short_method", "empty_method"}
    made = rules.make_rules()
    assert [r.name for r in rules.select_rules(made, "has_todo, uses_loc")] == ["has_todo", "uses_loc"]
    for bad in (lambda: rules.select_rules(made, ["none"]), lambda: rules.make_rules([{"name": "x", "type": "y"}]), lambda: rules.make_rules([{"name": "x", "type": "regex"}]), lambda: rules.make_rules([{"name": "x", "type": "composite", "operator": "XOR", "sub_patterns": []}])):
        with pytest.raises(ValueError):
            bad()
    either = rules.make_rules([{"name": "o", "type": "composite", "operator": "OR", "sub_patterns": [{"pattern": "pass"}, {"pattern": "TODO"}]}, {"name": "off", "type": "regex", "patterns": ["x"], "enabled": False}])
    assert {r["i"] for r in rules.apply_rules(spark.createDataFrame(rows, "i int, code string, function_name string"), either).where("rule_o").collect()} == {1, 2}


def test_rule_file(tmp_path):
    p = tmp_path / "rules.yaml"
    p.write_text("rules:\n  - {name: a, type: threshold, threshold: 2}\n  - {name: b, type: regex, patterns: ['x'], enabled: false}\n")
    assert [r.name for r in rules.load_rules(str(p))] == ["a"]


def test_rule_evaluation(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False), (False, False), (None, True)], "t boolean, rule_a boolean")
    r = rules.evaluate_rules(df, "t", ["rule_a"]).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 1, 1, 2) and r["precision"] == r["recall"] == r["f1"] == 0.5


def test_patterns(spark):
    rows = [(1, "def f(self):\n    if a:\n        x\n    elif b:\n        y\n    return self.x", "check_f", 6, True), (2, None, None, None, False), (3, "def g(a):\n    return a", "_g", 2, False)]
    df = patterns.with_patterns(spark.createDataFrame(rows, "i int, code string, function_name string, loc int, is_deleted boolean"))
    got = {r["i"]: r["detected_patterns"] for r in df.collect()}
    assert got[1] == ["validation", "complex_control_flow", "test_helper", "no_docstring"]
    assert got[2] == [] and got[3] == ["simple_wrapper", "delegation", "very_small", "private_function", "no_docstring", "static_utility"]
    stats = {r["pattern"]: r for r in patterns.pattern_statistics(df, "i").collect()}
    assert stats["validation"]["risk"] == "high" and stats["validation"]["examples"] == [1] and stats["delegation"]["risk"] == "protective" and stats["no_docstring"]["ratio"] == 0.5
    sample = patterns.stratified_sample(spark.range(1000).withColumn("s", F.col("id") % 3), "id", "s", 10)
    assert sample.count() == 30 and {r["id"] for r in sample.collect()} == {r["id"] for r in patterns.stratified_sample(spark.range(1000).repartition(9).withColumn("s", F.col("id") % 3), "id", "s", 10).collect()}


def test_all_rules_are_evaluated(spark):
    """The rules over lines by brute force, the others as in the queries that SQL follows."""
    lines = {
        "short_method": lambda c: len(plain_lines(c, True)) <= 3,
        "empty_method": lambda c: all(x in ("pass", "...", "return", "return None") for x in plain_lines(c, False)),
        "single_return": lambda c: len(plain_lines(c, False)) == 1 and plain_lines(c, False)[0].startswith("return"),
    }
    codes = {r["snippet_id"]: r["code"] for r in inputs.table(spark, SMALL, "code_snippets").collect()}
    got = {(r["snippet_id"], r["rule"][5:]): r["outcome"] for r in reference.rule_outcomes_all(spark, SMALL).collect()}
    known = {(r["snippet_id"], r["rule"][5:]): r["outcome"] for r in reference.rule_outcomes(spark, SMALL).collect()}
    assert {r for _, r in got} == {r.name for r in rules.make_rules()} and len(got) == 12 * len(codes)
    assert {k: v for k, v in got.items() if k[1] not in lines} == known
    deleted = {i: o in ("TP", "FN") for (i, _), o in known.items()}
    for name, test in lines.items():
        for i, code in codes.items():
            found = code is not None and test(code)
            assert got[i, name] == ("TP" if deleted[i] else "FP") if found else got[i, name] == ("FN" if deleted[i] else "TN"), (name, code)
    counts = {r["rule"][5:]: [r["tp"], r["fp"], r["fn"], r["tn"]] for r in reference.rule_evaluation_all(spark, SMALL).collect()}
    assert counts == {n: [sum(v == k for (_, r), v in got.items() if r == n) for k in ("TP", "FP", "FN", "TN")] for n in {r for _, r in got}}


def test_clone_group_report_has_groups_of_two(spark):
    sizes = lambda df: sorted(r["n_members"] for r in df.collect())
    every, got, large = (sizes(q(spark, SMALL)) for q in (reference.group_snapshot, reference.clone_group_report_all, reference.clone_group_report))
    assert 2 in got and got == [n for n in every if n >= 2] and large == [n for n in got if n > 2]


def test_reports_are_chosen_by_source_without_outer_white_space(spark, tmp_path):
    names = ["clone_report", "clone_report\t", "\r\n Clone_Report\n", "\u00a0clone_report", "code", "clone report", "clone_report_2", None]
    spark.createDataFrame([*((i, s, REPORT) for i, s in enumerate(names)), (9, "clone_report", None)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in reference.report_overview(spark, str(tmp_path)).collect()} == {0, 1, 2, 3}
    assert {r["doc_id"] for r in reference.report_members(spark, str(tmp_path)).collect()} == {0, 1, 2, 3}
    assert [(r["match_type"], r["n"]) for r in reference.report_match_types(spark, str(tmp_path)).collect()] == [("gapped", 4)]


def test_seeded_sample(spark):
    """Sizes, membership, the same rows each time, and no prefix of the ids."""
    d = "/root/testdata/sf0.01"
    of = lambda df: {r["snippet_id"]: r["is_deleted"] for r in df.collect()}
    every, got, prefix = of(reference._samples(spark, d)), of(reference.stratified_sample_seeded(spark, d)), of(reference.stratified_sample(spark, d))
    for state in (True, False):
        ids = sorted(i for i, s in every.items() if s == state)
        assert sum(s == state for s in got.values()) == min(50, len(ids))
    assert got.items() <= every.items() and got == of(reference.stratified_sample_seeded(spark, d))
    assert got != prefix and max(got) > 300


REPORT = """# Group

| Item | Value |
|---|---|
| Members | 3 |
| Match Type | `gapped` |
| Avg Similarity | 91.8% |

## Members

| # | State | Function | File | Lines | LOC | Revision | Similarity |
|---|---|---|---|---|---|---|---|
| 1 | deleted | `f`... | a.py | 10-20 | 11 | 2024 | 79% |
| 2 | deleted | short
| 3 | survived | `g` | b.py | 7 | x | 2024 | 83% |
| 4 | survived | `h` | c.py | 7 | 1 | 2024 | 83.5% |

### 1. `f`

#### Current

```python
def f(): pass
```

#### Previous

```python
def f():
    return 1
```

### 2. `h`

#### Current

```python
x
```
"""


def test_reports(spark):
    df = spark.createDataFrame([(1, REPORT), (2, "nothing"), (3, None)], "k int, text string")
    assert [tuple(r) for r in reports.report_overview(df, "k").orderBy("k").collect()] == [(1, 3, "gapped", 91.8), (2, 0, "unknown", 0.0), (3, 0, "unknown", 0.0)]
    rows = reports.report_methods(df, "k").orderBy("row").collect()
    assert [(r["function"], r["start_line"], r["end_line"], r["loc"], r["similarity"]) for r in rows] == [("`f`", 10, 20, 11, 79.0), ("`h`", 7, 7, 1, 83.5)]
    assert rows[0]["current"] == "def f(): pass" and rows[0]["previous"] == "def f():\n    return 1" and rows[1]["current"] == "x" and rows[1]["previous"] is None
    text = reports.render_report("T", {"a": reports.report_overview(df, "k").where("k = 1"), "b": "words"})
    assert "| 1 | 3 | gapped | 91.800 |" in text and "## b\n\nwords" in text
    with pytest.raises(ValueError):
        reports.render_table(spark.range(9), 5)


def test_revisions(spark, tmp_path):
    good = tmp_path / "20240101_120000_abc"
    old = tmp_path / "20240102_120000_abd"
    for d in (good, old, tmp_path / "backup", tmp_path / "20241301_000000_x", tmp_path / "20240103_000000_y"):
        d.mkdir()
    line = f'{"0" * 32},a.py,1,2,f,,"self, a=""b""\nc",c,[1;2]\n'
    for d in (good, old):
        (d / "code_blocks.csv").write_text(line)
        (d / "clone_pairs.csv").write_text("a,b,80.5,\n" if d == good else "")
    found = revisions.list_revisions(spark, str(tmp_path))
    assert found.count() == 5
    assert [r["revision_dir"] for r in revisions.usable_revisions(found).orderBy("revision_id").collect()] == [good.name, old.name]
    assert revisions.usable_revisions(found, start="2024-01-02 12:00:00", end="2024-01-02 12:00:00").count() == 1
    with pytest.raises(ValueError):
        revisions.usable_revisions(found, strict=True)
    assert revisions.list_revisions(spark, str(tmp_path / "none")).count() == 0
    b = revisions.read_code_blocks(spark, str(tmp_path)).orderBy("revision_id").collect()
    assert len(b) == 2 and b[0]["parameters"] == 'self, a="b"\nc' and b[0]["token_sequence"] == [1, 2] and b[0]["return_type"] is None and b[0]["revision_id"] == dt.datetime(2024, 1, 1, 12)
    p = revisions.read_clone_pairs(spark, str(tmp_path)).collect()
    assert len(p) == 1 and p[0]["ngram_overlap"] == 80.5 and p[0]["verify_similarity"] is None
    df = spark.createDataFrame([(1, 'a"b,c', None)], "i int, s string, n string")
    for form in ("parquet", "csv", "json"):
        revisions.write_stage(df, str(tmp_path / form), form)
        assert [tuple(r) for r in revisions.read_stage(spark, str(tmp_path / form), df.schema, form).collect()] == [(1, 'a"b,c', None)]
    assert [r["revision_dir"] for r in revisions.usable_revisions(found, first=1).collect()] == [good.name]
    # A field over two lines, a method twice, and a record that can't be loaded, between line ends of all kinds.
    (old / "code_blocks.csv").write_text(line + line.replace('""b""\nc', "").replace("\n", "\r\n") + line.replace("1,2", "2,1") + "\n" + line)
    assert cli.main(["ingest", str(tmp_path), "--out", str(tmp_path / "out")]) == 0
    b = spark.read.parquet(str(tmp_path / "out/code_blocks")).orderBy("revision_id", "method_name").collect()
    assert [(str(r["revision_id"])[:10], r["method_name"], r["parameters"]) for r in b] == [("2024-01-01", "f", 'self, a="b"\nc'), ("2024-01-02", "f", "self, a="), ("2024-01-02", "f_1", 'self, a="b"\nc'), ("2024-01-02", "f_2", 'self, a="b"\nc')]
    rejects = spark.read.parquet(str(tmp_path / "out/rejects")).collect()
    assert [(r["revision_dir"], r["reason"]) for r in rejects] == [(old.name, "value")] and "2,1" in rejects[0]["line"]
    report = {r["rule"]: int(r["n_violations"]) for r in spark.read.option("header", "true").csv(str(tmp_path / "out/violations")).collect()}
    assert report["start_after_end"] == 0 and report["self_pair"] == 0


def test_records_of_one_line_are_not_read_whole(spark, tmp_path, monkeypatch):
    d = tmp_path / "20240101_120000_abc"
    d.mkdir()
    (d / "code_blocks.csv").write_text("".join(f'x{i},"a ""b"" c"\n' for i in range(50)))
    rows = revisions.read_records(spark, str(tmp_path)).orderBy("at").collect()
    assert [r["line"] for r in rows] == [f'x{i},"a ""b"" c"' for i in range(50)] and {r["revision_dir"] for r in rows} == {d.name}
    assert "wholetext" not in revisions.read_records(spark, str(tmp_path))._jdf.queryExecution().toString().lower()


ODD_HASH = """CASE hash(token_hash) % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN token_hash || ',"x"' WHEN 3 THEN token_hash || chr(10) || chr(13) || chr(10) || 'x' WHEN 4 THEN ' ' || token_hash || chr(13) ELSE token_hash END"""


@pytest.mark.parametrize("rows", ["true", "false"])
def test_ingested_pairs_of_odd_rows(spark, con, tmp_path, rows):
    """Hashes that are null or need quotes, directories without a name or with one that no directory can have, scores that are no numbers; no pairs at all."""
    made = {
        "code_blocks": f"SELECT * REPLACE ({ODD_HASH} AS token_hash) FROM code_blocks",
        "clone_pairs": f"SELECT * REPLACE (CASE pair_id % 4 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN '-infinity'::DOUBLE ELSE ngram_overlap END AS ngram_overlap) FROM clone_pairs WHERE {rows}",
        "revisions": "SELECT * FROM revisions UNION ALL SELECT NULL, revision_id, commit_hash, true FROM revisions WHERE revision_id IS NOT NULL",
        "code_blocks_raw": "SELECT * FROM code_blocks_raw UNION ALL SELECT * REPLACE (CASE WHEN raw_id % 2 = 0 THEN 'a: b/c=%d' END AS revision_dir, -raw_id AS raw_id) FROM code_blocks_raw",
    }
    for name, sql in made.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path / name}.parquet' (FORMAT parquet)")
    got, want, a, b = against_sql(spark, connection(str(tmp_path)), "ingested_pairs", reference.ingested_pairs, reference.ORACLES["ingested_pairs"], str(tmp_path))
    assert a == b and got == want and (len(got) > 100) == (rows != "false")


def test_pairs_over_lines(spark, tmp_path):
    d = tmp_path / "a root" / "20240101_120000_abc"
    d.mkdir(parents=True)
    (d / "clone_pairs.csv").write_bytes(b'"a\r",b,80.5,\r\n"",,1,"2"\r\nc,"d\n""",,\n')
    read = lambda **o: {tuple(r)[1:5] for r in revisions.read_clone_pairs(spark, str(d.parent), **o).collect()}
    assert read() == {("a\r", "b", 80.5, None), (None, None, 1.0, 2.0), ("c", 'd\n"', None, None)}
    assert read(empty_texts=True) == {("a\r", "b", 80.5, None), ("", None, 1.0, 2.0), ("c", 'd\n"', None, None)}


def test_released_tables(spark):
    import os

    from strata.session import Stored, released

    with released(spark):
        made = Stored(spark.range(3))
        assert made.df.count() == 3
    kept = Stored(spark.range(2))
    assert not os.path.exists(made.path.removeprefix("file://")) and kept.df.count() == 2


def test_git(spark, tmp_path, monkeypatch):
    changes = spark.createDataFrame([("0123456789", "2024-01-01T00:00:00+09:00", "DELETE", "a.py", " gone \n"), ("1", "x", "ADD", "b.py", "m")], "commit_hash string, committed_at string, change_type string, old_path string, message string")
    assert [tuple(r) for r in repository.deleted_files(changes).collect()] == [("0123456", "2024-01-01T00:00:00+09:00", "a.py", "gone")]
    tags = spark.createDataFrame([(t,) for t in ("v1.10.0", "v1.9.0", "v1.9.1", "v2.0.0", "x1.0.0", "v1.0")], "tag string")
    assert {tuple(r) for r in repository.release_steps(tags).collect()} == {("v1.9.0", "v1.10.0"), ("v1.10.0", "v2.0.0"), ("v2.0.0", None)}
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    for name in ("a.py", "b é.py"):
        (tmp_path / name).write_text("x")
    git("add", "-A")
    git("commit", "-qm", "one")
    for name in ("a.py", "b é.py"):
        (tmp_path / name).unlink()
    git("add", "-A")
    git("commit", "-qm", "two\n\nmore")
    got = repository.read_deleted_files(spark, str(tmp_path)).collect()
    monkeypatch.setattr(repository, "COMMITS_PER_TASK", 1)
    assert sorted(map(tuple, repository.read_deleted_files(spark, str(tmp_path)).collect())) == sorted(map(tuple, got))
    assert {r["file_path"] for r in got} == {"a.py", "b é.py"} and all(len(r["commit_hash"]) == 7 and r["commit_message"] == "two\n\nmore" for r in got)


def test_responses(spark):
    rows = [('words ```json\n{"purpose": "p", "has_type_hints": true, "deletion_reasons": ["a"]}\n``` more',), ('x {"purpose": "q"} y',), ("none",), (None,), ("{broken",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(responses.parse_response(F.col("t"))).collect()]
    assert got[0]["purpose"] == "p" and got[0]["has_type_hints"] and got[0]["deletion_reasons"] == ["a"] and got[0]["complexity_level"] == "moderate" and got[0]["parsed"]
    assert got[1]["purpose"] == "q" and got[1]["parsed"]
    assert not any(r["parsed"] for r in got[2:]) and got[3]["purpose"] == "Unknown"


def test_config(tmp_path):
    c = config.Config()
    c.matching.similarity = 0.8
    c.save(tmp_path / "a/b.json")
    assert config.Config.load(tmp_path / "a/b.json") == c
    (tmp_path / "c.json").write_text('{"x": 1}')
    with pytest.raises(ValueError):
        config.Config.load(tmp_path / "c.json")
    with pytest.raises(FileNotFoundError):
        config.Config.load(tmp_path / "none.json")


def test_audits(spark):
    blocks = spark.createDataFrame([block(0, "f", [1]), block(0, "f", [1]), (R[0], None, "g", None, None, 1, 0, -1, None, None)], B)
    bad = {r["rule"]: r["n_violations"] for r in audits.validate_blocks(blocks).collect() if r["n_violations"]}
    assert bad == {"duplicate_signature": 1, "null_file_path": 1, "null_token_hash": 1, "start_after_end": 1, "line_not_positive": 1}
    with pytest.raises(ValueError):
        audits.require_valid(audits.validate_blocks(blocks))
    audits.require_valid(audits.validate_blocks(blocks.limit(0)))
    with pytest.raises(ValueError):
        audits.validate_blocks(blocks.drop("file_path"))
    assert spark.createDataFrame([("A._b",)], "n string").select(last_component("n")).first()[0] == "_b"
    renamed = matching.rename_duplicates(blocks.where("token_hash is not null").withColumn("o", F.monotonically_increasing_id()), "revision_id", ["o"])
    assert sorted(r["method_name"] for r in renamed.collect()) == ["f_1", "f_2"]


def test_rates(spark):
    rows = [(R[0], True, False, True, 95.0), (R[0], False, True, False, None), (R[1], False, False, True, 75.0)]
    t = spark.createDataFrame(rows, "prev_revision_id timestamp_ntz, is_deleted boolean, is_absorbed boolean, has_clone boolean, median_similarity double")
    by = {r["prev_revision_id"]: r for r in rates.rates_by_clone(t).collect()}
    assert by["Average"]["deleted_clone"] == 0.5 and by["Average"]["clone_deleted_rate"] == 50.0 and by["2024-02-01 00:00:00"]["no_clone_absorbed_rate"] == 0.0
    sim = {r["prev_revision_id"]: r for r in rates.rates_by_similarity(t).collect()}
    assert sim["2024-01-01 00:00:00"]["high_deleted_rate"] == 100.0 and sim["2024-01-01 00:00:00"]["low_deleted_rate"] is None and sim["Average"]["low_deleted_rate"] == 0.0


def test_stream(spark, tmp_path):
    rows = [(1, R[0], "a"), (1, R[1], "a"), (1, R[2], "b"), (2, R[0], "x")]
    schema = "id long, at timestamp_ntz, v string"
    for i, r in enumerate(R[:3]):
        spark.createDataFrame([x for x in rows if x[1] == r], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        incremental.stream_history(stream, str(tmp_path / "dim"), str(tmp_path / "state"), ["id"], ["v"], "at").awaitTermination(120)
    dim = incremental.VersionedTable(spark, str(tmp_path / "dim"))
    assert {tuple(r) for r in dim.read().collect()} == {(1, "a", R[0], R[2], False), (1, "b", R[2], None, True), (2, "x", R[0], None, True)}
    assert len(dim.versions()) == 2
    events = spark.createDataFrame([(R[0], "a"), (R[0], "a"), (R[1], "b")], "at timestamp_ntz, kind string").withColumn("at", F.col("at").cast("timestamp"))
    assert sorted(r["n"] for r in incremental.windowed_outcomes(events, "at", "kind").collect()) == [1, 2]


def test_relabel_chains(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", None)], "block_id string, matched_block_id string")
    assert {tuple(r) for r in lineage.relabel_chains(df).select("block_id", "global_block_id").collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x")}


def test_cli(spark, capsys, tmp_path):
    spec = tmp_path / "rules.yaml"
    spec.write_text("rules:\n  - {name: loops, type: regex, patterns: ['\\bfor\\b']}\n  - {name: short, type: threshold, threshold: 3}\n")
    assert cli.main(["rules", str(spec), "--only", "loops", "--data", SMALL, "--out", str(tmp_path / "ruled")]) == 0
    ruled = spark.read.parquet(str(tmp_path / "ruled"))
    assert "rule_loops" in ruled.columns and "rule_short" not in ruled.columns and ruled.where("rule_loops").count() > 0
    settings = tmp_path / "settings.json"
    settings.write_text('{"levels": {"high": 95.0, "low": 50.0}}')
    try:
        assert cli.main(["run", "nil sim-count", "--data", SMALL, "--config", str(settings), "--out", str(tmp_path / "counts")]) == 0
        assert reference.SETTINGS.levels.low == 50.0 and spark.read.parquet(str(tmp_path / "counts")).count() > 0
    finally:
        reference.configure(config.Config())
    assert cli.main(["list"]) == 0 and "signature_match" in capsys.readouterr().out
    assert set(cli.COMMANDS.values()) <= set(cli.all_queries())


def test_stream_history_in_any_order(spark, tmp_path):
    """Late updates between equal ones and older redeliveries that arrive later: as from all rows at once."""
    schema = "id long, at timestamp_ntz, loaded_at timestamp_ntz, v string"
    day = lambda n: dt.datetime(2024, 5, n)
    rnd = random.Random(5)
    batches = [[(1, day(1), day(1), "A"), (1, day(3), day(3), "A"), (2, day(1), day(9), "new"), (3, day(1), day(1), "x")], [(1, day(2), day(9), "B"), (2, day(1), day(2), "old"), (None, day(1), day(1), "z")]]
    batches += [[(rnd.randrange(4, 9), day(rnd.randrange(1, 8)), day(rnd.randrange(1, 28)), rnd.choice(["p", "q", None])) for _ in range(15)] for _ in range(2)]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        incremental.stream_history(stream, str(tmp_path / "dim"), str(tmp_path / "state"), ["id"], ["v"], "at", loaded="loaded_at").awaitTermination(120)
        every = latest(spark.createDataFrame(sum(batches[: i + 1], []), schema), {"id": F.col("id"), "at": F.col("at")}, {"v": F.col("v")})
        want = history.merge_versions(history.empty_dimension(every, ["id"], ["v"], "at"), every, ["id"], ["v"], "at")
        got = incremental.VersionedTable(spark, str(tmp_path / "dim")).read()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        if i == 1:
            assert [(r["v"], r["valid_from"]) for r in got.where("id = 1").orderBy("valid_from").collect()] == [("A", day(1)), ("B", day(2)), ("A", day(3))]
            assert [r["v"] for r in got.where("id = 2").collect()] == ["new"]
