"""Column-level data quality: exact base aggregates, row and load findings, and a classifier two-sample test for drift."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.text import digest, hashed_parts, stamp
from strata.session import stored

#: Buckets per doubling of a value when a median is located; finer means smaller buckets to sort.
BUCKETS_PER_DOUBLING = 64
#: Partitions' sums added up by one task.
TREE_FAN_IN = 64
#: Bins of the score histogram from which a discrimination (AUC) is computed.
SCORE_BINS = 2000


@dataclass(frozen=True)
class TableChecks:
    """What is checked in a table: numeric columns with their least and greatest possible value, and (a, b) with a <= b."""

    table: str
    key: str
    load: str
    ranges: dict[str, tuple[float | None, float | None]]
    ordered: tuple[str, str] | None = None


CODE_BLOCKS = TableChecks("code_blocks", "block_id", "revision_id", {"start_line": (1, None), "end_line": (1, None)}, ("start_line", "end_line"))
CLONE_PAIRS = TableChecks("clone_pairs", "pair_id", "revision_id", {"ngram_overlap": (0, 100)})


def _uneven(c: Column) -> Column:
    """A text that is empty, has outer or repeated white space, control characters or U+FFFD."""
    return c.rlike(r"\A\z|\A | \z|  |[\x00-\x1F\x7F\x{FFFD}]")


#: What a profile checks beyond the defined findings: all ranges (of an array: of its elements), and the form of texts.
PROFILE_RANGES: dict[str, dict[str, tuple[float | None, float | None]]] = {
    "code_blocks": CODE_BLOCKS.ranges | {"token_sequence": (0, None)},
    "clone_pairs": CLONE_PAIRS.ranges | {"verify_similarity": (0, 100)},
}
PROFILE_FORMS: dict[str, dict[str, Callable[[Column], Column]]] = {
    "code_blocks": {"token_hash": lambda c: ~c.rlike(r"\A[0-9a-f]{32}\z"), "commit_hash": lambda c: ~c.rlike(r"\A[0-9a-f]{7,40}\z")} | dict.fromkeys(("file_path", "method_name", "return_type", "parameters"), _uneven),
    "clone_pairs": {},
}


def _is_float(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))


def _impossible(df: DataFrame, c: str, bounds: tuple[float | None, float | None]) -> Column:
    low, high = bounds
    if isinstance(df.schema[c].dataType, T.ArrayType):
        return F.exists(c, lambda x: x.isNull() | (F.lit(False) if low is None else x < low) | (F.lit(False) if high is None else x > high))
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(c) < low)
    if high is not None:
        bad = bad | (F.col(c) > high)
    return bad | F.isnan(c) if _is_float(df, c) else bad


def _values(df: DataFrame, c: str) -> Column:
    """The column as a double, null where it is NaN."""
    return F.when(~F.isnan(c), F.col(c)).cast("double") if _is_float(df, c) else F.col(c).cast("double")


def exact_quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """(by, q0, q1, ...): exact quantiles of `value` per group, interpolated between the two nearest ranks; nulls left out, groups without values have no row.

    Equal values are counted before the shuffle. Buckets of the value's logarithm are summed up to find those that
    hold the wanted ranks, and only their distinct values are put in order: no group is sorted as a whole.
    """
    v = F.col(value)
    counts = df.where(v.isNotNull()).groupBy(*by, v.alias("_v")).agg(F.count("*").alias("_c")).withColumn("_b", (F.signum("_v") * F.floor(F.log2(F.abs("_v") + 1) * BUCKETS_PER_DOUBLING)).cast("long"))
    group, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    place = [(F.col("_all") - 1) * F.lit(float(p)) for p in probabilities]
    ranks = {f"_{end}{i}": f(x).cast("long") for i, x in enumerate(place) for end, f in (("lo", F.floor), ("hi", F.ceil))}
    inside = F.lit(False)
    for r in ranks:
        inside = inside | F.col(r).between(F.col("_before"), F.col("_before") + F.col("_n") - 1)
    buckets = (
        counts.groupBy(*by, "_b")
        .agg(F.sum("_c").alias("_n"))
        .withColumn("_all", F.sum("_n").over(group))
        .withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        .withColumns(ranks)
        .where(inside)
        .select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_b").alias("_kb"), "_before", "_all", *ranks)
    )
    on = F.col("_b") == F.col("_kb")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        counts.join(buckets, on)
        .withColumn("_from", F.col("_before") + F.coalesce(F.sum("_c").over(within), F.lit(0)))
        .withColumn("_to", F.col("_from") + F.col("_c") - 1)
    )
    pick = lambda at: F.max(F.when(F.col(at).between(F.col("_from"), F.col("_to")), F.col("_v")))
    picked = ranked.groupBy(*by).agg(F.first("_all").alias("_all"), *[pick(r).alias(r) for r in ranks])
    share = [x - F.floor(x) for x in place]
    return picked.select(*by, *[(F.col(f"_lo{i}") * (1 - s) + F.col(f"_hi{i}") * s).alias(f"q{i}") for i, s in enumerate(share)])


def exact_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The exact median (mean of the two middle values) of `value` per group."""
    return exact_quantiles(df, by, value, [0.5]).withColumnRenamed("q0", "median")


def row_findings(df: DataFrame, spec: TableChecks) -> DataFrame:
    """(table_name, column_name, row_key, issue) of null, impossible and wrongly ordered values, without repeats."""
    tests: list[tuple[str, str, Column]] = []
    for c, bounds in spec.ranges.items():
        tests += [(c, "null", F.col(c).isNull()), (c, "range", _impossible(df, c, bounds))]
    if spec.ordered:
        tests.append((spec.ordered[1], "order", F.col(spec.ordered[0]) > F.col(spec.ordered[1])))
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(c).alias("column_name"), F.lit(issue).alias("issue"))) for c, issue, test in tests]))
    return (
        df.select(F.col(spec.key).cast("string").alias("row_key"), F.explode(found).alias("_f"))
        .select(F.lit(spec.table).alias("table_name"), F.col("_f.column_name").alias("column_name"), "row_key", F.col("_f.issue").alias("issue"))
        .distinct()
    )


def load_statistics(df: DataFrame, spec: TableChecks) -> DataFrame:
    """Per load and checked column: rows, nulls, values, exact median and the median of the load before. Rows of no load are left out."""
    columns = list(spec.ranges)
    long = df.where(F.col(spec.load).isNotNull()).select(F.col(spec.load).alias("load"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).isNull().alias("isnull"), _values(df, c).alias("value")) for c in columns])).alias("_x"))
    long = long.select("load", "_x.*")
    base = long.groupBy("load", "column_name").agg(F.count("*").alias("n_rows"), F.count_if("isnull").alias("n_null"), F.count("value").alias("n_values"))
    medians = exact_median(long, ["load", "column_name"], "value")
    before = Window.partitionBy("column_name").orderBy("load")
    return base.join(medians, ["load", "column_name"], "left").withColumn("median_before", F.lag("median").over(before))


def load_findings(df: DataFrame, spec: TableChecks, null_rate: float = 0.02, factor: float = 2.0) -> DataFrame:
    """(table_name, column_name, row_key, issue) of loads with too many nulls or a median that moved by more than `factor`."""
    s = load_statistics(df, spec)
    moved = (F.col("median") > F.col("median_before") * factor) | (F.col("median") < F.col("median_before") / factor)
    found = F.array_compact(F.array(F.when(F.col("n_null") > F.col("n_rows") * null_rate, "null_rate"), F.when(moved, "shift")))
    return s.select(F.lit(spec.table).alias("table_name"), "column_name", stamp("load").alias("row_key"), F.explode(found).alias("issue"))


def quality_findings(tables: list[tuple[DataFrame, TableChecks]], null_rate: float = 0.02, factor: float = 2.0) -> DataFrame:
    """Row and load findings of several tables. Empty tables have none; nulls and NaN are as each issue says."""
    parts = [f for df, spec in tables for f in (row_findings(df, spec), load_findings(df, spec, null_rate, factor))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_profile(df: DataFrame, table: str, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Per column: rows, nulls, distinct values, and for numbers the range without NaN and the impossible values.

    Distinct values are counted as 128-bit digests of all columns in one aggregation: (column, digest) pairs are
    made unique before the shuffle, so a value that fills a third of a column travels once per input split. Arrays that differ
    in a null or in where an inner array ends are different values.
    """
    numeric = {c for c, t in ((f.name, f.dataType) for f in df.schema.fields) if isinstance(t, T.NumericType)}
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            *[F.when(F.col(c).isNotNull(), digest(*hashed_parts(F.col(c), df.schema[c].dataType), seed=seed)).alias(h) for seed, h in enumerate(("h", "h2"))],
            (_values(df, c) if c in numeric else F.lit(None).cast("double")).alias("v"),
            (_impossible(df, c, ranges[c]) if c in ranges else F.lit(False)).alias("bad"),
        )
        for c in df.columns
    ]
    long = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    unique = long.groupBy("column_name", "h", "h2").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if("bad").alias("bad"))
    return unique.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("h").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.count("h").alias("n_distinct"),
        F.min("lo").alias("min_value"),
        F.max("hi").alias("max_value"),
        F.sum("bad").alias("n_impossible"),
    ).select(F.lit(table).alias("table_name"), "*")


def column_details(df: DataFrame, table: str, ranges: dict[str, tuple[float | None, float | None]], forms: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """column_profile with min_text and max_text (order of bytes), min_time and max_time, min_size and max_size (characters of a
    text, elements of an array), null for other types and without values, and n_malformed: values that `forms` finds fault with.

    The additions are one aggregation to a single row, so no text is shuffled.
    """
    none = {"text": F.lit(None).cast("string"), "time": F.lit(None).cast("timestamp_ntz"), "size": F.lit(None).cast("long")}
    rows = []
    for f in df.schema.fields:
        c, seen = F.col(f.name), dict(none)
        if isinstance(f.dataType, T.StringType):
            seen |= {"text": c, "size": F.length(c).cast("long")}
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            seen["size"] = F.when(c.isNotNull(), F.size(c)).cast("long")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            seen["time"] = c.cast("timestamp_ntz")
        ends = [g(x).alias(f"{n}_{kind}") for kind, x in seen.items() for n, g in (("min", F.min), ("max", F.max))]
        rows.append(F.struct(F.lit(f.name).alias("column_name"), *ends, (F.count_if(forms[f.name](c)) if f.name in forms else F.lit(0).cast("long")).alias("n_malformed")))
    details = df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return column_profile(df, table, ranges).join(F.broadcast(details), "column_name").select("table_name", "column_name", "n_rows", "n_null", "n_distinct", "min_value", "max_value", *[f"{n}_{kind}" for kind in none for n in ("min", "max")], "n_impossible", "n_malformed")


def _magnitude(df: DataFrame, c: str, load: str, identifiers: list[str]) -> Column:
    """A column as a number whose distribution can be compared between loads: a number as it is, a text's length, an array's size,
    a timestamp's seconds since its load (the time itself only tells loads apart), 0 for identifiers. Null for null and NaN."""
    t = df.schema[c].dataType
    if c in identifiers:
        return F.when(F.col(c).isNotNull(), 0.0)
    if isinstance(t, T.StringType):
        return F.length(c).cast("double")
    if isinstance(t, (T.ArrayType, T.MapType)):
        return F.when(F.col(c).isNotNull(), F.size(c)).cast("double")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.timestamp_diff("SECOND", F.col(load).cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz")).cast("double")
    return _values(df, c)


def drift_test(df: DataFrame, table: str, key: str, load: str, columns: list[str], iterations: int = 8, ridge: float = 1e-3, sigmas: float = 4.0, identifiers: list[str] | None = None, bits: int = 8) -> DataFrame:
    """Classifier two-sample tests between each load and the one before.

    For every pair of loads a logistic regression learns to tell their rows apart from, per column, the standardised
    signed logarithm of its number (of a text the length, of an array the size, of a timestamp the seconds since the load),
    its square (both after an inverse hyperbolic sine, which tames outliers but cuts none off) and whether it is null (NaN counts as null); texts, arrays and `identifiers` (numbers without magnitude) also
    have the lowest `bits` of a hash of their value as indicators (two values differ in none once in 2**bits). Two folds by hash of the key are cross-fitted: each half is scored
    by the model of the other. AUC near 0.5 means the loads look alike. Each column is then left out in turn (the others' weights move by
    the one Newton step that makes up for it, from the whole model's Hessian, so no model per column has to be fitted); `auc_drop` is
    what the others can't make up for. It is 0 for all where one column tells the loads apart by itself, so each column is
    also tested alone (`auc_alone`). All pairs, folds and models are fitted together by Newton's method: a pass over the
    stored features adds up every model's gradient and Hessian per partition (numpy), partitions' sums are added in a tree of tasks, and only the
    totals, bounded by loads x columns, reach the driver. A partition holds loads x 2 x width^2 numbers, width being about 3 a column
    and `bits` more for hashed ones: 90 MB for 100 columns, half of them hashed, and 12 loads. All rows are used.

    Returns table_name, load, column_name (`*` for the whole model), n_before, n_after, auc, auc_drop, auc_alone, drifted (AUC
    above 0.5 by `sigmas` standard errors; for a column: its AUC alone, or its drop by as much). Loads are stamps. A null load
    is left out; fewer than two loads give no rows; a pair whose side has no rows in one fold scores 0.5.
    """
    spark = df.sparkSession
    identifiers = identifiers or []
    out = T.StructType([T.StructField("table_name", T.StringType()), T.StructField("load", T.StringType()), T.StructField("column_name", T.StringType()), T.StructField("n_before", T.LongType()), T.StructField("n_after", T.LongType()), T.StructField("auc", T.DoubleType()), T.StructField("auc_drop", T.DoubleType()), T.StructField("auc_alone", T.DoubleType()), T.StructField("drifted", T.BooleanType())])
    sizes = {c: _magnitude(df, c, load, identifiers) for c in columns}
    logs = {c: F.signum(x) * F.log1p(F.abs(x)) for c, x in sizes.items()}
    hashed = [i for i, c in enumerate(columns) if c in identifiers or isinstance(df.schema[c].dataType, (T.StringType, T.ArrayType))]
    rows = df.where(F.col(load).isNotNull()).select(*dict.fromkeys([key, load, *columns]))
    # One row per load: a small table, whose size is the number of loads.
    loads = [r[0] for r in rows.select(F.col(load).alias("l")).distinct().orderBy("l").collect()]
    if len(loads) < 2:
        return spark.createDataFrame([], out)
    scale = rows.agg(*[f(logs[c]).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    number = spark.createDataFrame([(x, i) for i, x in enumerate(loads)], T.StructType([T.StructField("_load", df.schema[load].dataType), T.StructField("_number", T.IntegerType())]))
    feats = stored(
        rows.join(F.broadcast(number), F.col(load) == F.col("_load")).select(
            F.col("_number").alias("o"),
            F.pmod(digest(F.col(key), seed=7), F.lit(2)).cast("int").alias("fold"),
            *[F.when(logs[c].isNotNull(), (logs[c] - F.lit(scale[f"m{i}"] or 0.0)) / F.lit(scale[f"s{i}"] or 1.0)).cast("float").alias(f"x{i}") for i, c in enumerate(columns)],
            *[F.when(F.col(columns[i]).isNotNull(), F.pmod(digest(F.col(columns[i]), seed=11), F.lit(2**bits))).otherwise(0).cast("int").alias(f"h{i}") for i in hashed],
        )
    )
    k, pairs = len(columns), len(loads) - 1
    first = np.cumsum([1] + [3 + bits * (i in hashed) for i in range(k)])
    width = int(first[-1])
    own = [np.arange(first[i], first[i + 1]) for i in range(k)]
    # What is fitted: the whole model and each column alone. What is scored: each column left out as well.
    alone = [np.concatenate([[0], c]) for c in own] if k > 1 else []
    fitted = [np.arange(width), *alone]
    live = [np.arange(width), *([np.setdiff1d(np.arange(width), c) for c in own] if k > 1 else []), *alone]
    variants = len(live)

    def design(pdf: pd.DataFrame) -> np.ndarray:
        x = np.zeros((len(pdf), width))
        x[:, 0] = 1
        for i in range(k):
            v = pdf[f"x{i}"].to_numpy(np.float64, na_value=np.nan)
            null = np.isnan(v)
            v = np.arcsinh(np.where(null, 0, v))
            x[:, first[i]], x[:, first[i] + 1], x[:, first[i] + 2] = v, v * v, null
            if i in hashed:
                x[:, first[i] + 3 : first[i + 1]] = pdf[f"h{i}"].to_numpy()[:, None] >> np.arange(bits) & 1
        return x

    def of_pair(o: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of loads p and p + 1, and whether they are of the later."""
        at = np.flatnonzero((o == p) | (o == p + 1))
        return at, (o[at] == p + 1).astype(float)

    def sums(beta: list[np.ndarray]):
        """Per model the sum of gradients, then of Hessians: a row of bytes for each partition, added up by model."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g, h = [np.zeros((pairs, 2, len(w))) for w in fitted], [np.zeros((pairs, 2, len(w), len(w))) for w in fitted]
            for pdf in batches:
                x, o, fold = design(pdf), pdf["o"].to_numpy(), pdf["fold"].to_numpy()
                for p in range(pairs):
                    at, y = of_pair(o, p)
                    for f in (0, 1):
                        use = fold[at] != f
                        whole, ys = x[at[use]], y[use]
                        if not len(ys):
                            continue
                        for v, w in enumerate(fitted):
                            xs = whole[:, w]
                            q = 1 / (1 + np.exp(-np.clip(xs @ beta[v][p, f], -30, 30)))
                            g[v][p, f] += xs.T @ (ys - q)
                            xs *= np.sqrt(q * (1 - q))[:, None]
                            h[v][p, f] += xs.T @ xs
            ids, here = list(np.ndindex(pairs, 2, len(fitted))), TaskContext.get().partitionId()
            yield pd.DataFrame({"i": np.arange(len(ids)), "part": here, "v": [np.concatenate([g[v][p, f], h[v][p, f].ravel()]).tobytes() for p, f, v in ids]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(len(pdf["v"].iloc[0]) // 8)
            for part in pdf["v"]:
                total += np.frombuffer(part)
            return pd.DataFrame({"i": pdf["i"].iloc[:1], "part": pdf["part"].iloc[:1] // TREE_FAN_IN, "v": [total.tobytes()]})

        form = "i long, part long, v binary"
        got, left = feats.mapInPandas(run, form), feats.rdd.getNumPartitions()
        while left > 1:
            got, left = got.groupBy("i", F.floor(F.col("part") / TREE_FAN_IN)).applyInPandas(add, form), -(-left // TREE_FAN_IN)
        got = got.toPandas()
        return {int(i): np.frombuffer(v) for i, v in zip(got["i"], got["v"])}

    beta = [np.zeros((pairs, 2, len(w))) for w in fitted]
    for _ in range(iterations):
        total = sums(beta)
        move = 0.0
        for i, (p, f, v) in enumerate(np.ndindex(pairs, 2, len(fitted))):
            n = len(fitted[v])
            g, h = total[i][:n], total[i][n:].reshape(n, n)
            step = np.linalg.solve(h + ridge * max(1.0, h[0, 0]) * np.eye(n), g - ridge * beta[v][p, f])
            step = np.clip(step, -4, 4)
            beta[v][p, f] += step
            move = max(move, np.abs(step).max())
        if move < 1e-4:
            break
    if k > 1:
        less = [np.zeros((pairs, 2, len(w))) for w in live[1 : 1 + k]]
        for i, (p, f, v) in enumerate(np.ndindex(pairs, 2, len(fitted))):
            if v == 0:
                h = total[i][width:].reshape(width, width)
                h = h + ridge * max(1.0, h[0, 0]) * np.eye(width)
                for c, kept in enumerate(live[1 : 1 + k]):
                    less[c][p, f] = beta[0][p, f, kept] + np.linalg.solve(h[np.ix_(kept, kept)], h[np.ix_(kept, own[c])] @ beta[0][p, f, own[c]])
        beta = [beta[0], *less, *beta[1:]]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hist = np.zeros((pairs, 2, variants, 2, SCORE_BINS), np.int64)
        for pdf in batches:
            x, o, fold = design(pdf), pdf["o"].to_numpy(), pdf["fold"].to_numpy()
            for p in range(pairs):
                at, y = of_pair(o, p)
                for f in (0, 1):
                    use = fold[at] == f
                    whole, ys = x[at[use]], y[use].astype(int)
                    for v, w in enumerate(live):
                        q = 1 / (1 + np.exp(-np.clip(whole[:, w] @ beta[v][p, f], -30, 30)))
                        np.add.at(hist[p, f, v], (ys, np.minimum((q * SCORE_BINS).astype(int), SCORE_BINS - 1)), 1)
        i = np.flatnonzero(hist)
        yield pd.DataFrame({"i": i, "n": hist.ravel()[i]})

    got = feats.mapInPandas(score, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    hist = np.zeros(pairs * 2 * variants * 2 * SCORE_BINS)
    hist[got["i"].to_numpy()] = got["n"].to_numpy()
    hist = hist.reshape(pairs, 2, variants, 2, SCORE_BINS)
    result = []
    stamps = [r[0] for r in number.orderBy("_number").select(stamp("_load")).collect()]
    for p in range(pairs):
        n0, n1 = (int(hist[p, :, 0, s].sum()) for s in (0, 1))
        se = float(np.sqrt((n0 + n1 + 1) / (12 * n0 * n1))) if n0 and n1 else 0.0
        aucs = []
        for v in range(variants):
            parts = []
            for f in (0, 1):
                a, b = hist[p, f, v]
                below = np.cumsum(a) - a
                parts.append(float((b * (below + a / 2)).sum() / (a.sum() * b.sum())) if a.sum() and b.sum() else 0.5)
            aucs.append(sum(parts) / 2)
        result.append((table, stamps[p + 1], "*", n0, n1, aucs[0], None, None, aucs[0] > 0.5 + sigmas * se))
        result += [(table, stamps[p + 1], c, n0, n1, aucs[1 + v], aucs[0] - aucs[1 + v], aucs[1 + k + v], max(aucs[0] - aucs[1 + v], aucs[1 + k + v] - 0.5) > sigmas * se) for v, c in enumerate(columns) if variants > 1]
    return spark.createDataFrame(result, out)
