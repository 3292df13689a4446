"""Problems 1, 2, 5 and 7 on small fixtures: defined cases, brute force, round trips."""

import csv
import datetime as dt
import io
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.functions.text import digest, squeeze, stamp
from strata.operators import history, quality, record_parser, snapshot_diff
from strata.operators.deliveries import latest
from strata.plans import core

H = "0123456789abcdef0123456789abcdef"


def record(**x):
    base = dict(token_hash=H, file_path="a.py", start_line="1", end_line="2", method_name="f", return_type="", parameters="", commit_hash="c", token_sequence="[1;2]") | x
    return ",".join(base.values())


CASES = [
    (record(), None),
    (record() + "\n", None),
    (record() + "\r\n", None),
    (record() + "\r", None),
    (record() + "\n\n", "quoting"),
    (record(parameters='"a, ""b"", c"'), None),
    (record(parameters='"a\nb"'), None),
    (record(parameters='a"b'), "quoting"),
    (record(parameters='"a"b'), "quoting"),
    (record(parameters='"a""'), "quoting"),
    (record(parameters='""a""'), "quoting"),
    (record(parameters='""""'), None),
    (record(parameters='"a'), "quoting"),
    (record(parameters=' "a"'), "quoting"),
    (record(parameters="a\nb"), "quoting"),
    (record() + ",x", "column_count"),
    ("", "column_count"),
    (None, "column_count"),
    (",,,,,,,,", "value"),
    (record(token_hash=H.upper()), "value"),
    (record(token_hash=H[1:]), "value"),
    (record(file_path='""'), "value"),
    (record(method_name=""), "value"),
    (record(start_line="0"), "value"),
    (record(start_line="3"), "value"),
    (record(start_line="+1"), "value"),
    (record(end_line="1234567890"), "value"),
    (record(end_line="٣"), "value"),
    (record(parameters="a�"), "value"),
    (record(parameters="a\x00"), "value"),
    (record(parameters="a\x7f"), "value"),
    (record(parameters="a\tb"), None),
    (record(token_sequence=""), None),
    (record(token_sequence="[]"), None),
    (record(token_sequence="[2147483647]"), None),
    (record(token_sequence="[2147483648]"), "value"),
    (record(token_sequence="[0;-1]"), "value"),
    (record(token_sequence="[1;;2]"), "value"),
    (record(token_sequence="[1;2;]"), "value"),
    (record(token_sequence="1;2"), "value"),
    (record(token_sequence="[" + ";".join(map(str, range(20_000))) + "]"), None),
]


def test_records(spark):
    df = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(CASES)], "raw_id long, line string, file string")
    got = {r["raw_id"]: r["reason"] for r in record_parser.parse_records(df, "line", ["raw_id"]).collect()}
    assert got == {i: c[1] for i, c in enumerate(CASES)}
    rows = record_parser.typed_code_blocks(record_parser.parse_records(df, "line", ["raw_id"]), ["raw_id"]).collect()
    assert {r["raw_id"] for r in rows} == {i for i, c in enumerate(CASES) if c[1] is None}
    by = {r["raw_id"]: r for r in rows}
    assert by[5]["parameters"] == 'a, "b", c' and by[0]["token_sequence"] == [1, 2] and by[0]["return_type"] is None
    assert record_parser.parse_records(df.limit(0), "line", ["raw_id"]).count() == 0
    with pytest.raises(ValueError):
        record_parser.parse_records(df.withColumnRenamed("raw_id", "reason"), "line", ["reason"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab",\n\ré', max_size=5), min_size=1, max_size=4), min_size=1, max_size=5))
def test_records_round_trip(rows):
    """What a CSV writer quotes in full is split into the same fields, whatever records lie around it."""
    lines = []
    for r in rows:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(r)
        lines.append(out.getvalue())
    for k, r in enumerate(rows):
        quoting, width, cols = record_parser.split_records(pa.array(lines), len(r))
        assert not quoting[k] and not width[k]
        assert [c[k].as_py() for c in cols] == r


def brute_split(line):
    """The definition, by a recursive reading of the grammar."""
    for end in ("\r\n", "\n", "\r"):
        if line.endswith(end):
            line = line[: -len(end)]
            break
    fields, i = 0, 0
    while True:
        if line[i : i + 1] == '"':
            j = i + 1
            while True:
                j = line.find('"', j)
                if j < 0:
                    return None
                if line[j + 1 : j + 2] == '"':
                    j += 2
                    continue
                break
            i = j + 1
        else:
            j = i
            while j < len(line) and line[j] != ",":
                if line[j] in '"\r\n':
                    return None
                j += 1
            i = j
        fields += 1
        if i == len(line):
            return fields
        if line[i] != ",":
            return None
        i += 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='a",\n\r', max_size=12), min_size=1, max_size=6))
def test_records_by_the_grammar(lines):
    quoting, width, _ = record_parser.split_records(pa.array(lines), 2)
    for k, line in enumerate(lines):
        n = brute_split(line)
        assert quoting[k] == (n is None)
        assert width[k] == (n is not None and n != 2)


def when(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_text(spark):
    df = spark.createDataFrame([(" a \t\r\n b ", when(2, 3)), ("  ", None), (None, when(1))], "t string, at timestamp_ntz")
    assert [tuple(r) for r in df.select(squeeze("t"), stamp("at")).collect()] == [("a b", "20240102_030000"), (None, None), (None, "20240101_000000")]
    pairs = spark.createDataFrame([(None, "a"), ("a", None), ("a", ""), ("", "a")], "x string, y string")
    assert pairs.select(digest("x", "y").alias("d")).distinct().count() == 4


def test_latest(spark):
    rows = [(1, "a", when(1)), (1, "b", when(3)), (1, "c", when(2)), (None, "n", when(1)), (None, "m", None), (2, None, None)]
    df = spark.createDataFrame(rows, "k int, v string, loaded_at timestamp_ntz")
    got = {(r["k"], r["v"]) for r in latest(df.unionByName(df), {"k": F.col("k")}, {"v": F.col("v")}).collect()}
    assert got == {(1, "b"), (None, "n"), (2, None)}


SNAP = "s timestamp_ntz, k string, m string, a string, extra int"


def test_diff(spark):
    rows = [(when(1), "x", "f", "1", 0), (when(1), "y", "f", None, 0), (when(1), "z", None, "1", 0), (when(2), "x", "f", "2", 0), (when(2), "y", "f", None, 0), (when(2), None, "n", "1", 0), (when(3), "x", "f", "2", 0), (when(3), "y", "f", "", 0), (None, "q", "q", "q", 0)]
    got = {tuple(r)[:4] for r in snapshot_diff.diff_snapshots(spark.createDataFrame(rows, SNAP), "s", ["k", "m"], ["a"]).collect()}
    assert got == {(when(2), "x", "f", "changed"), (when(2), "z", None, "removed"), (when(2), None, "n", "added"), (when(3), None, "n", "removed"), (when(3), "y", "f", "changed")}
    empty = spark.createDataFrame([], SNAP)
    assert snapshot_diff.diff_snapshots(empty, "s", ["k", "m"], ["a"]).count() == 0


def test_diff_brute_force(spark):
    rnd = random.Random(5)
    now = {f"k{i}": rnd.choice("abc") for i in range(400)}
    snaps = []
    for _ in range(4):
        snaps.append(dict(now))
        for k in rnd.sample(sorted(now), 20):
            now[k] = rnd.choice("abc")
        for k in rnd.sample(sorted(now), 10):
            del now[k]
        now |= {f"n{rnd.random()}": "a" for _ in range(10)}
    rows = [(when(i + 1), k, "m", v, i) for i, s in enumerate(snaps) for k, v in s.items()]
    want = set()
    for i, (a, b) in enumerate(zip(snaps, snaps[1:])):
        for k in a.keys() | b.keys():
            if a.get(k) != b.get(k):
                want.add((when(i + 2), k, "m", "added" if k not in a else "removed" if k not in b else "changed"))
    for leaf_rows in (1, 8, 1000):
        got = snapshot_diff.diff_snapshots(spark.createDataFrame(rows, SNAP), "s", ["k", "m"], ["a"], leaf_rows).collect()
        assert {tuple(r)[:4] for r in got} == want and len(got) == len(want)


def versions(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_history(spark):
    rows = [(1, when(1), "a"), (1, when(2), "a"), (1, when(4), "b"), (1, when(5), "a"), (1, when(5), "a"), (2, when(3), None), (2, when(4), None), (2, when(5), "x"), (None, when(1), "z"), (3, None, "z")]
    up = spark.createDataFrame(rows, "id long, at timestamp_ntz, v string")
    dim = history.merge_versions(history.empty_dimension(up, ["id"], ["v"], "at"), up, ["id"], ["v"], "at")
    want = [(1, "a", when(1), when(4), False), (1, "a", when(5), None, True), (1, "b", when(4), when(5), False), (2, "x", when(5), None, True), (2, None, when(3), when(5), False)]
    assert versions(dim) == sorted(want, key=repr)
    # In two merges, period by period, and again: the same.
    step = history.empty_dimension(up, ["id"], ["v"], "at")
    for first, last in ((1, 3), (4, 5), (4, 5)):
        step = history.merge_versions(step, up.where(F.col("at").between(when(first), when(last))), ["id"], ["v"], "at")
    assert versions(step) == sorted(want, key=repr)
    assert versions(history.merge_versions(dim, up.limit(0), ["id"], ["v"], "at")) == sorted(want, key=repr)


def test_median(spark):
    rnd = random.Random(3)
    rows = [("a", float(rnd.choice([1, 2, 3, 1e9, -5, 0.5]))) for _ in range(201)] + [("b", x) for x in (1.0, 2.0, 3.0, 10.0)] + [(None, 4.0), ("c", None)]
    got = {r["g"]: r["median"] for r in quality.exact_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert got == {"a": float(np.median([v for g, v in rows if g == "a"])), "b": 2.5, None: 4.0}


def test_findings(spark):
    rows = [(i, when(1), 5, 9) for i in range(100)] + [(200, when(1), None, 9), (201, when(1), 0, -1), (202, when(1), 9, 3), (202, when(1), 9, 3)] + [(300 + i, when(2), 50 if i else None, 60) for i in range(10)] + [(None, None, None, 1)]
    df = spark.createDataFrame(rows, "block_id long, revision_id timestamp_ntz, start_line long, end_line long")
    got = {tuple(r)[1:] for r in quality.quality_findings([(df, quality.CODE_BLOCKS)]).collect()}
    assert got == {
        ("start_line", "200", "null"), ("start_line", "201", "range"), ("end_line", "201", "range"), ("end_line", "202", "order"), ("end_line", "201", "order"), ("start_line", "300", "null"), ("start_line", None, "null"),
        ("start_line", "20240102_000000", "null_rate"), ("start_line", "20240102_000000", "shift"), ("end_line", "20240102_000000", "shift"),
    }
    assert quality.quality_findings([(df.limit(0), quality.CODE_BLOCKS)]).count() == 0


def test_drift(spark):
    rnd = random.Random(1)
    rows = [(i, when(1 + i % 3), rnd.gauss(100, 10) * (3 if i % 3 == 2 else 1), rnd.gauss(5, 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, s timestamp_ntz, x double, y double").withColumns({c: F.lit(1) for c in ("o", "fold", "x0", "l")})
    got = {(r["load"][:8], r["column_name"]): r for r in quality.drift_test(df, "t", "k", "s", ["x", "y"]).collect()}
    assert not got["20240102", "*"]["drifted"] and abs(got["20240102", "*"]["auc"] - 0.5) < 0.06
    assert got["20240103", "*"]["drifted"] and got["20240103", "*"]["auc"] > 0.95
    assert got["20240103", "x"]["drifted"] and not got["20240103", "y"]["drifted"]
    assert quality.drift_test(df.where("s < '2024-01-02'"), "t", "k", "s", ["x", "y"]).count() == 0


def test_column_details(spark):
    rows = [(H, " f", [3, -1], when(2), 101.0), (H[:-1], "a  b", [], when(1), -0.5), (H + "\n", "", None, None, float("nan")), (None, "g h", [7, 8, 9], when(3), 100.0), (H.upper(), "x\x07", [1], when(2), None)]
    df = spark.createDataFrame(rows, "token_hash string, method_name string, token_sequence array<int>, loaded_at timestamp_ntz, verify_similarity double")
    ranges = quality.PROFILE_RANGES["code_blocks"] | quality.PROFILE_RANGES["clone_pairs"]
    got = {r["column_name"]: r for r in quality.column_details(df, "t", ranges, quality.PROFILE_FORMS["code_blocks"]).collect()}
    assert {c: (r["n_impossible"], r["n_malformed"]) for c, r in got.items()} == {"token_hash": (0, 3), "method_name": (0, 4), "token_sequence": (1, 0), "loaded_at": (0, 0), "verify_similarity": (3, 0)}
    assert (got["token_hash"]["min_size"], got["token_hash"]["max_size"]) == (31, 33) and (got["method_name"]["min_text"], got["method_name"]["max_text"]) == ("", "x\x07")
    assert (got["token_sequence"]["min_size"], got["token_sequence"]["max_size"]) == (0, 3) and (got["loaded_at"]["min_time"], got["loaded_at"]["max_time"]) == (when(1), when(3))
    assert (got["verify_similarity"]["min_value"], got["verify_similarity"]["max_value"], got["verify_similarity"]["n_null"]) == (-0.5, 101.0, 1)


def test_drift_of_every_column(spark):
    """One column shifts with each load; `release`, which alone tells all loads apart, hides none of them."""
    rnd = random.Random(2)
    rows = []
    for i in range(4800):
        day = 1 + i % 8
        kind = rnd.choice(["int", "str"])
        rows.append((
            i, when(day), f"r{day}",
            None if day == 2 and rnd.random() < 0.3 else kind,
            kind * (5 if day == 3 else 1),
            "abc" if day == 4 and rnd.random() < 0.5 else rnd.choice(["abc", "xyz"]),
            [1] * rnd.randrange(1, 6 if day != 5 else 12),
            rnd.randrange(9) if day != 6 else 3,
            when(day) + dt.timedelta(minutes=rnd.randrange(1, 60) * (9 if day == 7 else 1)),
        ))
    df = spark.createDataFrame(rows, "k long, s timestamp_ntz, release string, nulls string, longer string, other string, sizes array<int>, ref long, at timestamp_ntz")
    columns = ["release", "nulls", "longer", "other", "sizes", "ref", "at"]
    got = {(int(r["load"][6:8]), r["column_name"]): r["drifted"] for r in quality.drift_test(df, "t", "k", "s", columns, identifiers=["ref"]).collect()}
    assert all(got[d, "release"] and got[d, "*"] for d in range(2, 9))
    for at, c in enumerate(columns[1:], 2):
        assert [d for d in range(2, 9) if got[d, c]] == [at, at + 1], c
    columns = core.p7_drift(spark, SMALL).select("table_name", "column_name").distinct().collect()
    assert {tuple(r) for r in columns if r[1] != "*"} == {("code_blocks", c) for c in "file_path start_line end_line method_name return_type parameters commit_hash token_hash token_sequence loaded_at".split()} | {("clone_pairs", c) for c in "block_id_1 block_id_2 ngram_overlap verify_similarity loaded_at".split()}


def test_profile_tells_arrays_apart(spark):
    """Nulls in arrays, and where inner arrays end, make different values."""
    rows = [([], [[1], [2]]), ([None], [[1, 2]]), ([1], [[1, 2], []]), ([1, None], None), ([1, None], [[1, 2]])]
    df = spark.createDataFrame(rows, "a array<int>, b array<array<int>>")
    got = {r["column_name"]: (r["n_distinct"], r["n_null"]) for r in quality.column_profile(df, "t", {}).collect()}
    assert got == {"a": (4, 0), "b": (3, 1)}


def test_drift_far_beyond_the_spread(spark):
    """Two loads that differ in how far their outliers lie, and in nothing else: no value is cut off."""
    rnd = random.Random(2)
    rows = [(i, f"2024-01-0{1 + i % 2} 00:00:00", (1e12 if i % 2 else 1e30) if rnd.random() < 0.3 else rnd.uniform(1, 1.001)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k long, s string, x double").withColumn("s", F.col("s").cast("timestamp_ntz"))
    assert quality.drift_test(df, "t", "k", "s", ["x"]).where("drifted").count() >= 1


def test_exact_quantiles(spark):
    rnd = random.Random(9)
    values = [rnd.choice([None, -3.5, 0.0, rnd.uniform(-5, 900)]) for _ in range(301)]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "g int, v double")
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.expr("percentile(v, array(0.1, 0.25, 0.5, 1.0))").alias("q")).collect()}
    for r in quality.exact_quantiles(df, ["g"], "v", [0.1, 0.25, 0.5, 1.0]).collect():
        assert [r[f"q{i}"] for i in range(4)] == pytest.approx(want[r["g"]])
    assert quality.exact_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_kept_snapshots_give_what_the_whole_history_does(spark, tmp_path, monkeypatch):
    """Delivery by delivery as from all snapshots at once; of the one before, only folders with a differing leaf are read."""
    from strata.streaming.snapshots import KeptSnapshot

    rnd = random.Random(3)
    state, rows = {(f"f{i % 5}", f"m{i}" if i else None): [rnd.choice("ab"), None] for i in range(60)}, []
    for n in range(4):
        for k in rnd.sample(sorted(state, key=repr), 5 if n else 0):
            state.pop(k) if rnd.random() < 0.5 else state[k].__setitem__(1, str(n))
        state[("f", f"new{n}")] = ["x", "y"]
        rows += [(n, *k, *v) for k, v in state.items()]
    df = spark.createDataFrame(rows, "s int, f string, m string, a string, b string")
    want = {tuple(r) for r in snapshot_diff.diff_snapshots(df, "s", ["f", "m"], ["a", "b"]).collect()}
    kept = KeptSnapshot(spark, str(tmp_path), ["f", "m"], ["a", "b"], bits=8)
    got = set()
    for n in range(4):
        found = kept.deliver(df.where(F.col("s") == n).drop("s"))
        changes = {(n, *r) for r in found.collect()}
        if n:
            got |= changes
            assert "dynamicpruning" in found._jdf.queryExecution().toString()
        else:
            assert len(changes) == 61 and {r[3] for r in changes} == {"added"}
    assert got == want and len(want) > 12
    assert kept.deliver(df.where("s = 3").drop("s")).count() == 0
    assert {r["change"] for r in kept.deliver(df.limit(0).drop("s")).collect()} == {"removed"}
