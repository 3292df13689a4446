"""Contextual patterns of code samples and how often they go with deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.code import contains_any, occurrences, strip


def detected_patterns(code: Column, name: Column, loc: Column) -> Column:
    """The labels that apply to a sample, in a fixed order; null code has none. `if ` within `elif ` counts for both."""
    lower, name_lower = F.lower(code), F.lower(name)
    lines = F.filter(F.split(strip(code), "\n"), lambda x: (strip(x) != "") & ~strip(x).startswith("#"))
    flow = occurrences(code, "for ") + occurrences(code, "while ") + occurrences(code, "if ") + occurrences(code, "elif ")
    first = F.get(F.split(code, "\n"), F.lit(0))
    documented = contains_any(code, ['"""', "'''"])
    # The words that each label looks for.
    tests: list[tuple[str, Column]] = [
        ("simple_wrapper", code.contains("return ") & (occurrences(code, "return") == 1) & (loc <= 5)),
        ("delegation", (F.size(lines) <= 3) & F.exists(lines, lambda x: x.contains("return "))),
        ("conversion_utility", contains_any(lower, ["convert", "cast", "to_", "as_", "from_"]) & (loc <= 15)),
        ("validation", contains_any(code, ["raise", "assert"]) | F.coalesce(name_lower.contains("check"), F.lit(False))),
        ("deprecated_or_todo", contains_any(lower, ["deprecated", "todo", "fixme", "xxx", "hack"])),
        ("very_small", loc <= 3),
        ("complex_control_flow", flow >= 3),
        ("has_error_handling", code.contains("try:") & code.contains("except")),
        ("property_decorator", contains_any(code, ["@property", "@cached_property"])),
        ("private_function", name.startswith("_") & ~name.startswith("__")),
        ("test_helper", contains_any(name_lower, ["assert", "check", "verify", "mock"])),
        ("compatibility_shim", contains_any(lower, ["compat", "fallback", "backward"])),
        ("has_docstring", documented),
        ("no_docstring", ~documented),
        ("modifies_state", code.contains("self.") & contains_any(code, [" = ", "+=", "-=", "*="])),
        ("static_utility", first.contains("def ") & ~first.contains("self")),
    ]
    return F.when(code.isNotNull(), F.array_compact(F.array(*[F.when(test, label) for label, test in tests]))).otherwise(F.array().cast("array<string>"))


def with_patterns(samples: DataFrame) -> DataFrame:
    return samples.withColumn("detected_patterns", detected_patterns(F.col("code"), F.col("function_name"), F.col("loc")))


def pattern_statistics(samples: DataFrame, key: str, examples: int = 3) -> DataFrame:
    """(pattern, deleted, survived, ratio, risk, examples) of samples with patterns and is_deleted.

    ratio = deleted / both. risk: high above 0.5, protective below 0.3, else neutral. Examples are the first deleted samples' keys;
    aggregated as the least few per partition, never as a whole group.
    """
    long = samples.select(key, "is_deleted", F.explode("detected_patterns").alias("pattern"))
    n = long.groupBy("pattern").agg(F.count_if("is_deleted").alias("deleted"), F.count_if(~F.col("is_deleted")).alias("survived"))
    ranked = long.where("is_deleted").withColumn("_k", F.row_number().over(Window.partitionBy("pattern").orderBy(key))).where(F.col("_k") <= examples)
    first = ranked.groupBy("pattern").agg(F.array_sort(F.collect_list(key)).alias("examples"))
    ratio = F.col("deleted") / (F.col("deleted") + F.col("survived"))
    return n.join(first, "pattern", "left").select("pattern", "deleted", "survived", ratio.alias("ratio"), F.when(ratio > 0.5, "high").when(ratio < 0.3, "protective").otherwise("neutral").alias("risk"), F.when(ratio > 0.6, "strong").when(ratio > 0.4, "balanced").otherwise("weak").alias("band"), F.coalesce("examples", F.array().cast(f"array<{long.schema[key].dataType.simpleString()}>")).alias("examples"))


def top_patterns(statistics: DataFrame, k: int = 10) -> DataFrame:
    """The `k` patterns that go with deletion most, in order (a top-k report): by ratio, then by how many were deleted, then by name."""
    return statistics.orderBy(F.desc("ratio"), F.desc("deleted"), "pattern").limit(k)


def first_sample(samples: DataFrame, test: Column, order: list[str]) -> DataFrame:
    """The first row in `order` for which `test` holds; none if there is none."""
    return samples.where(test).orderBy(*order).limit(1)


def characteristics(samples: DataFrame) -> DataFrame:
    """Percent of deleted and surviving samples with a docstring, error handling, debt markers, a private name, a property decorator."""
    code, name = F.col("code"), F.col("function_name")
    # What each characteristic looks for.
    flags = {
        "docstring": contains_any(code, ['"""', "'''"]),
        "try_except": F.coalesce(code.contains("try:"), F.lit(False)) & F.coalesce(code.contains("except"), F.lit(False)),
        "debt_marker": contains_any(code, ["TODO", "FIXME"]),
        "private": F.coalesce(name.startswith("_"), F.lit(False)),
        "property": contains_any(code, ["@property"]),
    }
    percent = lambda c: F.round(F.avg(c.cast("double")) * 100, 2)
    return samples.groupBy("is_deleted").agg(F.count("*").alias("n"), *[percent(c).alias(f"{k}_percent") for k, c in flags.items()])


def basic_statistics(samples: DataFrame) -> DataFrame:
    """Per state: samples, mean lines (of those above 0), mean clone group size, share of all samples."""
    n = F.count("*")
    return samples.groupBy("is_deleted").agg(n.alias("n"), F.avg(F.when(F.col("loc") > 0, F.col("loc"))).alias("mean_loc"), F.avg("clone_group_size").alias("mean_group_size")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def match_types(samples: DataFrame) -> DataFrame:
    """(is_deleted, match_type, n)."""
    return samples.groupBy("is_deleted", "match_type").agg(F.count("*").alias("n"))


def stratified_sample(df: DataFrame, key: str, stratum: str, per_stratum: int, seed: int = 42, order: Column | None = None) -> DataFrame:
    """`per_stratum` rows of each stratum without replacement, the same at every partitioning: the first by a seeded hash of
    the key, or by `order`. Spark limits each partition to as many rows before the shuffle."""
    by = [order if order is not None else F.xxhash64(F.lit(seed), key), F.col(key)]
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(stratum).orderBy(*by))).where(F.col("_k") <= per_stratum).drop("_k")
