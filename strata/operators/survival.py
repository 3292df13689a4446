"""What became of methods over their lives: survival groups, relative time, cohorts, plot data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUPS = ("Matched", "Absorber", "Absorbed", "Deleted")


def deletion_survival(tracked: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Adds survival_group and relative_time (and group_label from `labels`) to a row per method and revision.

    The group is the last row's state: matched, then deleted, then absorbed override each other; a matched method that ever
    absorbed another is an absorber. Time counts revisions up to the last row, which has 0; for absorbers up to the last row in
    which they absorbed, so rows after it are positive. One window per method, whose rows are as many as revisions.
    Rows without method or revision are left out.
    """
    rows = tracked.where("method_id is not null and prev_revision_id is not null")
    whole = Window.partitionBy("method_id")
    order = whole.orderBy("prev_revision_id")
    last = F.struct("prev_revision_id", "is_matched", "is_deleted", "is_absorbed")
    rows = (
        rows.withColumn("_last", F.max(last).over(whole))
        .withColumn("_any", F.bool_or("is_absorber").over(whole))
        .withColumn("_k", F.row_number().over(order))
        .withColumn("_n", F.count("*").over(whole))
    )
    state = F.when(F.col("_last.is_absorbed"), "Absorbed").when(F.col("_last.is_deleted"), "Deleted").when(F.col("_last.is_matched"), F.when(F.col("_any"), "Absorber").otherwise("Matched"))
    rows = rows.withColumn("survival_group", state)
    anchor = F.when(F.col("survival_group") == "Absorber", F.max(F.when(F.col("is_absorber"), F.col("_k"))).over(whole)).otherwise(F.col("_n"))
    rows = rows.withColumn("relative_time", (F.col("_k") - anchor).cast("long"))
    if labels is not None:
        rows = rows.withColumn("group_label", F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col("survival_group")])
    return rows.drop("_last", "_any", "_k", "_n")


def survival_counts(rows: DataFrame) -> DataFrame:
    """Per relative time and group: rows with and without a similarity."""
    return rows.where("survival_group is not null").groupBy("relative_time", "survival_group").agg(F.count("median_similarity").alias("n_similar"), F.count_if(F.col("median_similarity").isNull()).alias("n_not_similar"))


def survival_boxes(rows: DataFrame) -> DataFrame:
    """Box plot data per relative time and group: exact quartiles and whiskers within 1.5 interquartile ranges."""
    s = rows.where("median_similarity is not null and survival_group is not null")
    boxes = s.groupBy("relative_time", "survival_group").agg(F.expr("percentile(median_similarity, array(0.25, 0.5, 0.75))").alias("q"), F.count("*").alias("n"))
    boxes = boxes.select("relative_time", "survival_group", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    keys = ["relative_time", "survival_group"]
    reach = F.col("q3") - F.col("q1")
    inside = F.col("median_similarity").between(F.col("q1") - 1.5 * reach, F.col("q3") + 1.5 * reach)
    return s.join(boxes, keys).groupBy(*keys, "n", "q1", "median", "q3").agg(F.min(F.when(inside, F.col("median_similarity"))).alias("whisker_low"), F.max(F.when(inside, F.col("median_similarity"))).alias("whisker_high"))


def survival_areas(rows: DataFrame) -> DataFrame:
    """Area plot data: a row for every time between the first and last and every group, missing ones 0, and the axis' top (1.05 times the most)."""
    counts = rows.where("survival_group is not null").groupBy("relative_time", "survival_group").agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("relative_time").alias("a"), F.max("relative_time").alias("z"), F.max("n").alias("most"))
    grid = ends.where("a is not null").select(F.explode(F.sequence("a", "z")).alias("relative_time"), (F.col("most") * 1.05).alias("y_max")).select("*", F.explode(F.array(*[F.lit(g) for g in GROUPS])).alias("survival_group"))
    return grid.join(counts, ["relative_time", "survival_group"], "left").select("relative_time", "survival_group", F.coalesce("n", F.lit(0)).alias("n"), "y_max")


def absorbed_cohorts(rows: DataFrame) -> DataFrame:
    """Absorbed methods by how long a similarity is known before they vanish: (cohort, time, n, n_methods_at_100, and a description of the similarity).

    Cohorts: at_end_only (a similarity at 0 but none at -1), before_end (one at -1), lived_2 (at -2 but not -3), lived_10
    (at -10 but not -11); absorbers for the groups that took them in, at 0. A cohort without rows is missing.
    """
    s = rows.where("median_similarity is not null")
    absorbed = s.where("survival_group = 'Absorbed'")
    has = lambda t: F.bool_or(F.col("relative_time") == t)
    life = absorbed.groupBy("method_id").agg(*[has(t).alias(f"h{-t}") for t in (0, -1, -2, -3, -10, -11)])
    cohort = F.array_compact(F.array(F.when(F.col("h0") & ~F.col("h1"), "at_end_only"), F.when(F.col("h1"), "before_end"), F.when(F.col("h2") & ~F.col("h3"), "lived_2"), F.when(F.col("h10") & ~F.col("h11"), "lived_10")))
    member = life.select("method_id", F.explode(cohort).alias("cohort"))
    taken = s.where("survival_group = 'Absorber' and relative_time = 0").select(F.lit("absorbers").alias("cohort"), "relative_time", "median_similarity")
    every = absorbed.join(member, "method_id").select("cohort", "relative_time", "median_similarity").unionByName(taken)
    q = lambda p: F.expr(f"percentile(median_similarity, {p})")
    return every.groupBy("cohort", "relative_time").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("median_similarity") == 100).alias("n_at_100"),
        F.avg("median_similarity").alias("mean"),
        F.stddev_samp("median_similarity").alias("std"),
        F.min("median_similarity").alias("min"),
        q(0.25).alias("q1"),
        q(0.5).alias("median"),
        q(0.75).alias("q3"),
        F.max("median_similarity").alias("max"),
    )
