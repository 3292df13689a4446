"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.bpe import VOCABULARY, count_column
from strata.session import stored

#: Steps in which the fraction of a source that is repeated once more can be set.
FRACTION_BINS = 4096
#: Times that what a source still lacks is filled from documents that fit.
PASSES = 4


@dataclass
class Fill:
    """A source's part of the mix: size wanted at first, most it can give, whether it can't reach the first, and what it gets."""

    source: str
    wanted: float
    capacity: float
    short: bool
    given: float
    rounds: int


def water_fill(sizes: dict[str, int], weights: dict[str, float], repeats: dict[str, int], total: float) -> list[Fill]:
    """Clamps sources at their size times their repeats and shares the rest among the others by weight, until all fit.

    At most one round per source. If every source is clamped the mix stays below `total`. A source without weight gets
    nothing; weights need not sum to one among the sources that are left.
    """
    capacity = {s: float(sizes.get(s, 0)) * max(0, repeats[s]) for s in weights}
    clamped: set[str] = set()
    rounds = 0
    given = {s: w * total for s, w in weights.items()}
    while over := [s for s in weights if s not in clamped and given[s] > capacity[s]]:
        clamped |= {*over}
        rounds += 1
        rest = max(0.0, total - sum(capacity[s] for s in clamped))
        free = sum(weights[s] for s in weights if s not in clamped)
        given = {s: capacity[s] if s in clamped else rest * weights[s] / free for s in weights}
    return [Fill(s, w * total, capacity[s], capacity[s] < w * total, given[s], rounds) for s, w in weights.items()]


def source_name(c: Column | str) -> Column:
    """A source's spelling without outer white space and in lower case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def plan_mix(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: what it has, can give and is given. `sizes` has source and n_tokens per document (null sources aside).

    Sizes are summed up per source before anything reaches the driver; what does is one row per source of `targets`
    and the total.
    """
    spark = sizes.sparkSession
    # Sources that aren't targets count towards the total only, so the rows collected are as many as targets.
    named = [r.asDict() for r in targets.select("source", "target_share", "max_repeats").where("source is not null").collect()]
    wanted = F.when(F.col("source").isin([r["source"] for r in named]), F.col("source"))
    sums = {r["s"]: r["n"] for r in sizes.where("source is not null").groupBy(wanted.alias("s")).agg(F.sum("n_tokens").alias("n")).collect()}
    total = sum(sums.values())
    fills = water_fill({k: v for k, v in sums.items() if k}, {r["source"]: float(r["target_share"] or 0) for r in named}, {r["source"]: int(r["max_repeats"] or 0) for r in named}, total)
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("target_share", T.DoubleType()), T.StructField("max_repeats", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("capacity", T.LongType()), T.StructField("total", T.LongType()), T.StructField("short", T.BooleanType()), T.StructField("given", T.DoubleType())])
    by = {f.source: f for f in fills}
    return spark.createDataFrame([(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0), int(sums.get(r["source"], 0)), int(by[r["source"]].capacity), int(total), by[r["source"]].short, by[r["source"]].given) for r in named], schema)


def token_sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that have a source, its name normalised."""
    return count_column(documents.where(F.col("source").isNotNull()).select("doc_id", source_name("source").alias("source"), "text"), ["doc_id", "source"], "text", vocabulary)


def mix(sizes: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents used, each `copies` times. `sizes` is stored.

    A source given g of its t tokens is used floor(g / t) times whole; of the documents, those whose seeded hash falls
    in the first bins are used once more. The last such bin is found from token sums per bin, so no source is sorted as a
    whole. What is then still missing is filled in the same way, PASSES times in all, from the documents that aren't larger than
    it: a document too large for the rest is passed over, and the size reached is never above the one given but for rounding.
    Copies never exceed max_repeats. Documents without tokens are used like others of their source.
    """
    spark = sizes.sparkSession
    parts = []
    for r in plan.select("source", "tokens", "given", "max_repeats").collect():  # one row per target source
        ratio = min(r["given"] / r["tokens"], float(r["max_repeats"])) if r["tokens"] else 0.0
        whole = int(ratio)
        parts.append((r["source"], whole, (ratio - whole) * r["tokens"] if whole < r["max_repeats"] else 0.0))
    binned = sizes.withColumn("_bin", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(FRACTION_BINS)))
    gaps, edges = {s: rest for s, _, rest in parts}, []
    for _ in range(PASSES):
        # Documents taken in an earlier pass are out: those in its bins that fitted its gap.
        gap = spark.createDataFrame([(s, float(g), [float(e[s][0]) for e in edges], [int(e[s][1]) for e in edges]) for s, g in gaps.items()], "_s string, _gap double, _gaps array<double>, _edges array<int>")
        free = ~F.exists(F.arrays_zip("_gaps", "_edges"), lambda e: (F.col("n_tokens") <= e["_gaps"]) & (F.col("_bin") <= e["_edges"]))
        bins = binned.join(F.broadcast(gap), F.col("source") == F.col("_s")).where(free & (F.col("n_tokens") <= F.col("_gap"))).groupBy("_s", "_gap", "_bin").agg(F.sum("n_tokens").alias("_n"))
        # Source and bin: at most FRACTION_BINS rows per source.
        upto = bins.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_s").orderBy("_bin")))
        reached = {r["_s"]: r for r in upto.where("_upto <= _gap").groupBy("_s").agg(F.max("_bin").alias("edge"), F.max("_upto").alias("n")).collect()}
        edges.append({s: (g, reached[s]["edge"] if s in reached and g > 0 else -1) for s, g in gaps.items()})
        gaps = {s: g - (reached[s]["n"] if s in reached and g > 0 else 0) for s, g in gaps.items()}
    use = spark.createDataFrame([(s, whole, [float(e[s][0]) for e in edges], [int(e[s][1]) for e in edges]) for s, whole, _ in parts], "_s string, _whole int, _gaps array<double>, _edges array<int>")
    once_more = F.exists(F.arrays_zip("_gaps", "_edges"), lambda e: (F.col("n_tokens") <= e["_gaps"]) & (F.col("_bin") <= e["_edges"])).cast("int")
    # One row per target source.
    return binned.join(F.broadcast(use), F.col("source") == F.col("_s")).select("doc_id", "source", "n_tokens", (F.col("_whole") + once_more).cast("int").alias("copies")).where("copies > 0")


def mix_report(documents: DataFrame, targets: DataFrame, seed: int = 42, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per target source the share wanted, the share the plan gives and the share that the drawn mix reaches, with the most copies of a document."""
    sizes = stored(token_sizes(documents, vocabulary))
    plan = plan_mix(sizes, targets)
    drawn = mix(sizes, plan, seed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.max("copies").alias("most_copies"), F.count("*").alias("documents"))
    all_given, all_drawn = Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1))
    return (
        plan.join(drawn, "source", "left")
        .withColumn("mix_tokens", F.coalesce("mix_tokens", F.lit(0)))
        .select("source", "target_share", "max_repeats", "tokens", "short", (F.col("given") / F.sum("given").over(all_given)).alias("planned_share"), "mix_tokens", F.try_divide(F.col("mix_tokens").cast("double"), F.sum("mix_tokens").over(all_drawn)).alias("actual_share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("documents", F.lit(0)).alias("documents"))
    )
