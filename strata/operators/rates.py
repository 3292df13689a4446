"""Outcome counts and rates by revision, and their averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.quality import exact_quantiles


def status() -> Column:
    """absorbed before deleted before survived."""
    return F.when(F.col("is_absorbed"), "absorbed").when(F.col("is_deleted"), "deleted").otherwise("survived")


def similarity_level(high: float = 90.0, low: float = 70.0) -> tuple[Column, Column]:
    """(high, low): at least `high`; at least `low` and below `high`. A null similarity is neither."""
    s = F.col("median_similarity")
    return F.coalesce(s >= high, F.lit(False)), F.coalesce((s >= low) & (s < high), F.lit(False))


def _with_average(table: DataFrame, key: str) -> DataFrame:
    """Adds a row whose key is `Average`: the mean of each column over the rows (nulls left out), to two decimals."""
    values = [c for c in table.columns if c != key]
    rows = table.select(F.col(key).cast("string").alias(key), *[F.col(c).cast("double").alias(c) for c in values])
    mean = table.agg(*[F.round(F.avg(c), 2).alias(c) for c in values]).select(F.lit("Average").alias(key), *values)
    return rows.unionByName(mean)


def _rate(flag: str, among: Column) -> Column:
    return F.round(F.avg(F.when(among, F.col(flag).cast("double"))) * 100, 2)


def rates_by_clone(tracked: DataFrame) -> DataFrame:
    """Per revision the counts of each status without and with clones, and the deletion and absorption rates (percent) of both.

    Combinations that don't occur count 0, and so do rates without rows. Last comes the Average row. Fixed columns: no pivot
    has to look for values first. Revisions are text.
    """
    s, clone = status(), F.col("has_clone")
    counts = [F.count_if((s == x) & (clone if c else ~clone)).alias(f"{x}_{'clone' if c else 'no_clone'}") for x in ("absorbed", "deleted", "survived") for c in (False, True)]
    rates = [F.coalesce(_rate(f"is_{x}", clone if c == "clone" else ~clone), F.lit(0.0)).alias(f"{c}_{x}_rate") for x in ("deleted", "absorbed") for c in ("clone", "no_clone")]
    return _with_average(tracked.where("prev_revision_id is not null").groupBy("prev_revision_id").agg(*counts, *rates), "prev_revision_id")


def rates_by_similarity(tracked: DataFrame, high: float = 90.0, low: float = 70.0) -> DataFrame:
    """Per revision the counts of each status at high, low and neither similarity, and the rates (percent) of methods with clones
    at high and low similarity; a rate without rows is null. Last comes the Average row."""
    s, (is_high, is_low) = status(), similarity_level(high, low)
    levels = {"high": is_high, "low": is_low, "neither": ~is_high & ~is_low}
    counts = [F.count_if((s == x) & level).alias(f"{x}_{name}") for x in ("absorbed", "deleted", "survived") for name, level in levels.items()]
    rates = [_rate(f"is_{x}", levels[name] & F.col("has_clone")).alias(f"{name}_{x}_rate") for name in ("high", "low") for x in ("deleted", "absorbed")]
    return _with_average(tracked.where("prev_revision_id is not null").groupBy("prev_revision_id").agg(*counts, *rates), "prev_revision_id")


def similarity_counts(tracked: DataFrame, high: float = 90.0, low: float = 70.0) -> DataFrame:
    """(level, n_matched, n_unmatched) for high and low similarity."""
    is_high, is_low = similarity_level(high, low)
    level = F.when(is_high, "high").when(is_low, "low")
    return tracked.withColumn("level", level).where("level is not null").groupBy("level").agg(F.count_if("is_matched").alias("n_matched"), F.count_if(~F.col("is_matched")).alias("n_unmatched"))


def clone_crosstab(tracked: DataFrame) -> DataFrame:
    """Per revision the rows by (has_clone, is_matched, is_deleted), as columns; combinations without rows count 0."""
    cell = lambda f, v: F.col(f) if v else ~F.col(f)
    return tracked.where("prev_revision_id is not null").groupBy("prev_revision_id").agg(*[F.count_if(cell("has_clone", c) & cell("is_matched", m) & cell("is_deleted", d)).alias(f"{'clone' if c else 'no_clone'}_{'matched' if m else 'unmatched'}_{'deleted' if d else 'kept'}") for c in (False, True) for m in (False, True) for d in (False, True)])


def deletion_crosstab(tracked: DataFrame) -> DataFrame:
    """Per revision the rows by (is_deleted, is_all_deleted, is_partial_deleted); those that can't occur have no column."""
    d, a, p = F.col("is_deleted"), F.col("is_all_deleted"), F.col("is_partial_deleted")
    return tracked.where("prev_revision_id is not null").groupBy("prev_revision_id").agg(F.count_if(~d).alias("kept"), F.count_if(d & ~a & ~p).alias("deleted_alone"), F.count_if(a).alias("deleted_with_group"), F.count_if(p).alias("deleted_from_group"))


def rate_series(rates: DataFrame) -> DataFrame:
    """(revision, metric, value) of a rate table, for line charts; the Average row is left out."""
    values = [c for c in rates.columns if c != "prev_revision_id"]
    return rates.where("prev_revision_id <> 'Average'").unpivot(["prev_revision_id"], values, "metric", "value").withColumnRenamed("prev_revision_id", "revision")


def describe(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles (exact, interpolated) and max of a column per group; nulls left out, a group without values missing.

    The quartiles come from counted values (quality.exact_quantiles): no group's values are held together.
    """
    v = df.where(F.col(column).isNotNull())
    base = v.groupBy(*by).agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    q = exact_quantiles(v, by, column, [0.25, 0.5, 0.75]).select(*by, F.col("q0").alias("lower"), F.col("q1").alias("median"), F.col("q2").alias("q3")).withColumnRenamed("lower", "q1")
    return base.join(q, by)


def column_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, mean, median, std, min, max) of several numeric columns."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    return describe(long, "v", ["column_name"]).select("column_name", "n", "mean", "median", "std", "min", "max")


def coerce(df: DataFrame, numbers: list[str] = (), times: list[str] = (), booleans: list[str] = (), names: dict[str, str] | None = None) -> DataFrame:
    """Texts as doubles, timestamps or booleans (True, true, 1 and their opposites), null for what is none; then `names` renames columns."""
    truth = lambda c: F.when(F.lower(c).isin("true", "1", "1.0"), True).when(F.lower(c).isin("false", "0", "0.0"), False)
    made = {c: F.col(c).cast("string").try_cast("double") for c in numbers} | {c: F.col(c).cast("string").try_cast("timestamp_ntz") for c in times} | {c: truth(F.col(c).cast("string")) for c in booleans}
    return (df.withColumns(made) if made else df).withColumnsRenamed(names or {})


def formatted_means(pairs: DataFrame) -> DataFrame:
    """(metric, mean_first, mean_second) of paired_metrics as texts for people: whole numbers with commas for counts, three decimals of a share for rates."""
    text = lambda c: F.when(F.col("metric").endswith("_rate"), F.format_number(F.avg(c) / 100, 3)).otherwise(F.format_number(F.avg(c), 0))
    return pairs.where("first is not null and second is not null").groupBy("metric").agg(text("first").alias("mean_first"), text("second").alias("mean_second"))


def union_aligned(*frames: DataFrame) -> DataFrame:
    """All rows of several frames, columns by name; null where a frame lacks one."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    """(bin_from, n): rows by bins of equal width; nulls left out."""
    return df.where(F.col(column).isNotNull()).groupBy((F.floor(F.col(column) / width) * width).cast("double").alias("bin_from")).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, r): Pearson's r of each two columns over rows that have both."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"`{i}`").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("e")).select("e.*")
