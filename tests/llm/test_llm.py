"""Problems 3, 4, 6, 8, 9 and 10 on small fixtures: brute force, published encoders, defined cases."""

import base64
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.llm import bpe, components, mixing, neardup, spans, splitting

# Components


def brute_components(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("pairs", [[], [(1, 1), (None, 2), (3, None)], [(1, 2), (2, 1), (2, 1)], [(i, i + 1) for i in range(150)], [(0, i) for i in range(1, 120)], [(i * 7 % 101, i * 13 % 97) for i in range(60)]])
def test_components(spark, pairs):
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], "a long, b long, node string")
    got = {r["node"]: r["component"] for r in components.connected_components(df, "a", "b").collect()}
    assert got == brute_components(pairs)


# Spans


def brute_spans(records, length):
    holders = {}
    for k, t in records.items():
        for i in range(len(t) - length + 1):
            holders.setdefault(tuple(t[i : i + length]), set()).add(k)
    out = set()
    for k, t in records.items():
        shared = [False] * len(t)
        for i in range(len(t) - length + 1):
            if len(holders[tuple(t[i : i + length])]) > 1:
                shared[i : i + length] = [True] * length
        i = 0
        while i < len(t):
            if shared[i]:
                j = i
                while j + 1 < len(t) and shared[j + 1]:
                    j += 1
                out.add((k, i, j))
                i = j
            i += 1
    return out


def test_spans(spark):
    rnd = random.Random(2)
    words = [[rnd.randrange(9) for _ in range(120)] for _ in range(6)]
    records = {"empty": [], "short": [1] * 39, "same1": [7] * 90, "same2": [7] * 41, "alone": list(range(500, 700)), "twice": list(range(900, 950)) * 2}
    for i in range(60):
        t = []
        for _ in range(rnd.randrange(1, 5)):
            w = rnd.choice(words)
            a = rnd.randrange(80)
            t += w[a : a + rnd.randrange(10, 110)]
            if rnd.random() < 0.5:
                t.append(rnd.randrange(9))
        records[f"r{i}"] = t
    records["copy"] = records["r1"]
    rows = [(k, t, 1) for k, t in records.items()] + [("null", None, 1), (None, [1] * 60, 1), ("r1", records["r1"], 1)]
    df = spark.createDataFrame(rows, "h string, t array<int>, rec int").drop("rec")
    recs = spans.numbered(spans.distinct_sequences(df, "h", "t"))
    for length in (16, 40):
        got = [tuple(r) for r in spans.shared_spans(recs, "h", "t", length).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute_spans(records, length)
    share = {r["h"]: r for r in spans.shared_share(recs, spans.shared_spans(recs, "h", "t"), "h", "t").collect()}
    assert share["empty"]["share"] == 0 and share["copy"]["share"] <= 1 and set(share) == set(records)
    assert spans.shared_spans(recs.limit(0), "h", "t").count() == 0


def test_chunks_resist_shifts():
    rnd = random.Random(4)
    t = [rnd.randrange(1000) for _ in range(3000)]
    u = t[:1500] + [5, 6] + t[1500:]

    def digests(x):
        a = np.array(x)
        _, first, past, _ = spans.chunks_of(a, np.array([0, len(a)]), 40)
        return set(zip(*[d.tolist() for d in spans.PrefixDigests(a).of(first, past)]))

    a, b = digests(t), digests(u)
    assert len(a - b) <= 10 and len(a) > 100


# Near duplicates


def brute_similar(sets, t):
    ids = sorted(sets)
    out = set()
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= t * len(x | y) - 1e-9:
                out.add((a, b))
    return out


def grams(tokens):
    return {tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4)}


@pytest.mark.parametrize("threshold", [0.6, 0.8])
@pytest.mark.parametrize("per_tree", [8192, 16])
def test_near_duplicates(spark, monkeypatch, threshold, per_tree):
    """Families of edited copies, with a frame that every record shares, exact copies, repeated grams, short and empty records."""
    monkeypatch.setattr(neardup, "ENTRIES_PER_TREE", per_tree)
    rnd = random.Random(per_tree)
    frame = [rnd.randrange(50) for _ in range(30)]
    records = {"e": [], "s": [1, 2, 3, 4], "f": [1, 2, 3, 4, 5], "g": [1, 2, 3, 4, 5], "rep": [3] * 50, "rep2": [3] * 9}
    for f in range(12):
        base = [rnd.randrange(3000) for _ in range(rnd.randrange(8, 120))]
        for i in range(8):
            t = list(base)
            for _ in range(rnd.randrange(6)):
                k = rnd.randrange(len(t))
                t[k : k + rnd.randrange(2)] = [rnd.randrange(3000)] * rnd.randrange(2)
            records[f"b{f:02}-{i}"] = frame + t if f % 3 else t
    records |= {f"c{i}": frame for i in range(20)}
    df = spark.createDataFrame([(k, v, 1) for k, v in records.items()] + [("null", None, 1)], "id string, t array<int>, n int")
    near = neardup.NearDuplicates([("block", df, "id", "t", False)], threshold)
    got = [tuple(r) for r in near.all_pairs().collect()]
    want = brute_similar({k: grams(v) for k, v in records.items()}, threshold)
    assert len(got) == len(set(got))
    assert {(a, b) for _, a, b in got} == want
    groups = {r["id"]: r["group_id"] for r in near.groups().collect()}
    assert groups == brute_components([p for p in want])


def test_a_gram_in_a_third_of_all_records(spark, monkeypatch):
    """Hot grams' buckets are dealt into blocks by size, sizes that are too far apart never meet, and no pair is lost."""
    monkeypatch.setattr(neardup, "HOT_SHARE", 40)
    monkeypatch.setattr(neardup, "ENTRIES_PER_TREE", 10)
    rnd = random.Random(4)
    hot = [1, 2, 3, 4, 5, 6]
    records = {}
    for i in range(90):
        t = [rnd.randrange(2000) for _ in range(rnd.choice((6, 12, 40, 41, 42, 120)))]
        records[f"a{i:02}"] = hot + t if i % 3 == 0 else t
        records[f"b{i:02}"] = [*records[f"a{i:02}"][:-1], 7]
    df = spark.createDataFrame(list(records.items()), "id string, t array<int>")
    got = {(a, b) for _, a, b in neardup.NearDuplicates([("block", df, "id", "t", False)], 0.6).all_pairs().collect()}
    assert got == brute_similar({k: grams(v) for k, v in records.items()}, 0.6) and len(got) > 60


def test_size_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "ENTRIES_PER_TREE", 4)
    entries = spark.createDataFrame([(1, n) for n in [5] * 9 + [6, 7, 9, 10, 100, 100]] + [(2, 5)] * 4, "bucket long, n int")
    got = {r["_n"]: (r["first"], r["last"], r["low"], r["high"]) for r in neardup.size_blocks(entries, 0.6).collect()}
    assert got == {5: (0, 2, 0, 2), 6: (2, 2, 0, 3), 7: (2, 2, 0, 3), 9: (2, 2, 2, 3), 10: (3, 3, 2, 3), 100: (3, 3, 3, 3)}


def test_equal_digests_of_one_half_keep_records_apart(spark, monkeypatch):
    """Classes are told apart by both halves of the digest: with the first half the same for all, nothing is lost or merged."""
    whole = neardup.set_classes
    monkeypatch.setattr(neardup, "set_classes", lambda *a: whole(*a).withColumn("d1", F.lit(7).cast("long")))
    records = {"a": list(range(20)), "b": list(range(20)), "c": list(range(1, 21)), "d": list(range(50, 70))}
    df = spark.createDataFrame(list(records.items()), "id string, t array<int>")
    near = neardup.NearDuplicates([("block", df, "id", "t", False)], 0.6)
    assert {(x, y) for _, x, y in near.all_pairs().collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert {r["id"]: (r["group_id"], r["n_copies"], r["n_links"]) for r in near.groups().collect()} == {"a": ("a", 2, 1), "b": ("a", 2, 1), "c": ("a", 1, 1)}


def test_near_duplicate_code(spark):
    code = {"1": "def f(a):\r\n    return a + b_1 * 'é'", "2": "def f(a):\n\treturn a + b_1 *   'é'  ", "3": "", "4": None, "5": "x"}
    df = spark.createDataFrame(list(code.items()), "id string, code string")
    assert [tuple(r) for r in neardup.NearDuplicates([("snippet", df, "id", "code", True)], 0.6).all_pairs().collect()] == [("snippet", "1", "2")]
    assert neardup.NearDuplicates([("snippet", df.limit(0), "id", "code", True)], 0.6).all_pairs().count() == 0
    assert neardup.code_tokens("a_1+é  b") == ["a_1", "+", "é", "b"]


def test_frequent_grams_lose_no_pair(spark, monkeypatch):
    """With every gram frequent, records meet in frequent grams' buckets alone."""
    monkeypatch.setattr(neardup, "HOT_SHARE", 1)
    monkeypatch.setattr(neardup, "COUNTERS", 4)
    rnd = random.Random(8)
    records = {f"r{i}": [rnd.randrange(4) for _ in range(rnd.randrange(20, 40))] for i in range(80)}
    records |= {f"x{i}": records[f"r{i}"][:-1] for i in range(40)}
    df = spark.createDataFrame(list(records.items()), "id string, t array<int>")
    got = {(a, b) for _, a, b in neardup.NearDuplicates([("block", df, "id", "t", False)], 0.6).all_pairs().collect()}
    assert got == brute_similar({k: grams(v) for k, v in records.items()}, 0.6)


# Tokenizer


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def published():
    import tiktoken

    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "\n\n  x", "a" * 5000, "don't we'LL I'm", "日本語のテキスト。です", "na\u00efve \u200b\ufeff \x1c\x1d\x85 \u3000", "🙂👩‍👩‍👧", "\t\tif x:\r\n\t\treturn", "<|endoftext|>", "１２３ ⅷ ³", "a\u0301\u0323", "'s's''s ''re", "x" * 200 + " " * 300 + "\n", "\ud7ff\ue000", "𝒳𓀀"]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_random_texts(encoder, published, text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    _, ids = encoder.encode([text])
    assert ids.tolist() == published.encode_ordinary(text)


def test_texts(encoder, published):
    offsets, ids = encoder.encode([*TEXTS, None])
    for i, t in enumerate(TEXTS):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == published.encode_ordinary(t), t
    assert offsets[-1] == offsets[-2]
    assert encoder.count([*TEXTS, None]).tolist() == np.diff(offsets).tolist()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=24))
def test_transducer_is_the_merges(encoder, word):
    assert encoder.transducer.encode(word) == encoder.transducer.merge(word)


def test_small_tables(published, monkeypatch):
    """Tables that start anew all the time give the same ids."""
    monkeypatch.setattr(bpe, "MAX_STATES", 3)
    monkeypatch.setattr(bpe, "MAX_WORDS", 2)
    e = bpe.Encoder(bpe.VOCABULARY)
    monkeypatch.setattr(bpe, "STRETCH", 7)
    rnd = random.Random(6)
    one_word = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    for t in [*TEXTS, one_word]:
        assert e.encode([t, t])[1].tolist() == published.encode_ordinary(t) * 2


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=20), st.integers(1, 5))
def test_utf8_stream(data, step):
    s = bpe.Utf8Stream()
    got = "".join(s.feed(data[i : i + step]) for i in range(0, len(data), step)) + s.end()
    assert got == data.decode("utf-8", "replace")


def test_encode_column(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (1, "hello world", "x")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode_column(df, "doc_id", "text").collect())
    assert got == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0
    assert sorted(r["text"] for r in bpe.decode_column(bpe.encode_column(df, "doc_id", "text"), "doc_id", "ids").collect()) == ["", "", "hello world", "hello world"]


# Mixing


def test_water_fill():
    got = {f.source: f for f in mixing.water_fill({"a": 10, "b": 1000, "c": 1000}, {"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 3, "b": 1, "c": 1}, 1000)}
    assert got["a"].short and got["a"].given == 30 and not got["b"].short
    assert got["b"].given == pytest.approx(485) and got["c"].given == pytest.approx(485)
    # A source that could reach its own share but not what it is given besides is clamped in a later round.
    got = {f.source: f for f in mixing.water_fill({"a": 0, "b": 300, "c": 5000}, {"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 3, "b": 1, "c": 1}, 1000)}
    assert not got["b"].short and got["b"].given == 300 and got["c"].given == pytest.approx(700)
    assert all(f.given == f.capacity for f in mixing.water_fill({"a": 1}, {"a": 1.0}, {"a": 2}, 100))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.floats(0.01, 1), st.integers(0, 5)), min_size=1, max_size=6), st.integers(1, 2000))
def test_water_fill_properties(parts, total):
    names = [str(i) for i in range(len(parts))]
    s = sum(w for _, w, _ in parts)
    fills = mixing.water_fill({n: p[0] for n, p in zip(names, parts)}, {n: p[1] / s for n, p in zip(names, parts)}, {n: p[2] for n, p in zip(names, parts)}, total)
    assert all(f.given <= f.capacity + 1e-6 for f in fills)
    assert sum(f.given for f in fills) == pytest.approx(min(total, sum(f.capacity for f in fills)), rel=1e-6, abs=1e-6)
    free = {round(f.given / f.wanted, 6) for f in fills if f.given < f.capacity - 1e-6}
    assert len(free) <= 1


def test_mix(spark):
    docs = [(i, "word " * (1 + i % 40), [" Code", "code", "TEXT\n", "other", None][i % 5]) for i in range(2000)] + [(9000, None, "code"), (9001, "", "text")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("code", 0.9, 2), ("text", 0.1, 5), ("none", 0.0, 3)], "source string, target_share double, max_repeats int")
    sizes = mixing.token_sizes(df)
    plan = mixing.plan_mix(sizes, targets)
    rows = {r["source"]: r for r in plan.collect()}
    assert set(rows) == {"code", "text", "none"} and rows["code"]["tokens"] == sum(n for n in [r["n_tokens"] for r in sizes.where("source = 'code'").collect()])
    drawn = mixing.mix(sizes, plan).collect()
    assert all(1 <= r["copies"] <= (2 if r["source"] == "code" else 5) for r in drawn)
    for s in ("code", "text"):
        got = sum(r["n_tokens"] * r["copies"] for r in drawn if r["source"] == s)
        assert abs(got - rows[s]["given"]) <= 0.02 * rows[s]["given"] + 45
    assert sorted((r["doc_id"], r["copies"]) for r in mixing.mix(sizes.repartition(7), plan).collect()) == sorted((r["doc_id"], r["copies"]) for r in drawn)
    report = {r["source"]: r for r in mixing.mix_report(df, targets).collect()}
    assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1) and report["none"]["mix_tokens"] == 0
    assert mixing.mix(sizes.limit(0), mixing.plan_mix(sizes.limit(0), targets)).count() == 0


# Splitting


def test_merge_segments():
    assert splitting.merge_segments([5, 5, 5, 5], [0, 1, 3, 1], 10) == [0, 2]
    assert splitting.merge_segments([5, 5, 5], [0, 3, 1], 10) == [0, 1]
    assert splitting.merge_segments([5], [0], 1) == [0]
    assert splitting.merge_segments([3, 3, 3, 3], [0, 1, 1, 1], 12) == [0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 6)), min_size=1, max_size=30), st.integers(9, 40))
def test_merge_segments_is_greedy(parts, most):
    """Against merging the weakest pair that fits, again and again."""
    sizes, kinds = [s for s, _ in parts], [k for _, k in parts]
    groups = [[i] for i in range(len(parts))]
    while True:
        fits = [(kinds[b[0]], sum(sizes[i] for i in a + b), b[0], k) for k, (a, b) in enumerate(zip(groups, groups[1:])) if sum(sizes[i] for i in a + b) <= most]
        if not fits:
            break
        k = min(fits)[3]
        groups[k : k + 2] = [groups[k] + groups[k + 1]]
    assert splitting.merge_segments(sizes, kinds, most) == [g[0] for g in groups]


@pytest.mark.parametrize("text", ["x = 1\n" * 900, "word " * 3000, "あいうえお。" * 900, "a" * 9000 + "é" * 9000, "# A\n\n" + "One two three. " * 700 + "\n\n# B\n\n" + "Four five. " * 900, "🙂" * 3000, "\n" * 5000, "x\n\n" * 2000 + "y" * 30000])
def test_split(spark, encoder, text):
    df = spark.createDataFrame([(1, text, 0), (2, "short", 0), (3, None, 0), (4, "", 0)], "doc_id long, text string, piece int")
    limit, overlap = 256, 16
    rows = sorted(splitting.split_documents(df, "doc_id", "text", limit, overlap).collect(), key=lambda r: r["piece"])
    ids = encoder.encode([text])[1].tolist()
    assert len(ids) > limit and {r["doc_id"] for r in rows} == {1}
    assert rows[0]["first_token"] == 0 and rows[-1]["past_token"] == len(ids)
    data, at, new = text.encode(), 0, ""
    for k, r in enumerate(rows):
        assert r["n_tokens"] == r["past_token"] - r["first_token"] <= limit
        if k:
            assert r["first_token"] == rows[k - 1]["past_token"] - overlap >= rows[k - 1]["first_token"]
        cut = int(encoder.lengths[ids[: r["past_token"]]].sum())
        new += data[at:cut].decode()
        at = cut
        assert r["text"].endswith(data[:cut].decode()[-5:]) or len(r["text"]) < 5
    assert new == text


def test_split_prefers_natural_ends(spark):
    text = "".join(f"def f{i}(a):\n    b = a + {i}\n    return b\n\n\n" for i in range(300))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = splitting.split_documents(df, "doc_id", "text", 256, 16).collect()
    assert len(rows) > 10 and all(r["text"].endswith("\n\n\n") for r in rows)
    with pytest.raises(ValueError):
        splitting.split_documents(df, "doc_id", "text", 100, 50)
