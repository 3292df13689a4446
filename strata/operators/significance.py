"""Paired significance tests over revisions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def wilcoxon_p(plus: float, minus: float, n: int, ties: list[int], zeros: int = 0) -> float:
    """Two-sided p of a signed-rank test of `n` differences other than 0: exact without ties and without differences of 0 up to 50
    pairs, else the normal approximation corrected for ties."""
    if n == 0:
        return 1.0
    least = min(plus, minus)
    if n <= 50 and not zeros and all(t == 1 for t in ties):
        ways = [1] + [0] * (n * (n + 1) // 2)
        for rank in range(1, n + 1):
            for s in range(len(ways) - 1, rank - 1, -1):
                ways[s] += ways[s - rank]
        return min(1.0, 2 * sum(ways[: int(least) + 1]) / 2**n)
    mean = n * (n + 1) / 4
    variance = n * (n + 1) * (2 * n + 1) / 24 - sum(t**3 - t for t in ties) / 48
    if variance <= 0:
        return 1.0
    return math.erfc(abs(least - mean) / math.sqrt(2 * variance))


def signed_rank_sums(pairs: DataFrame) -> DataFrame:
    """(metric, n_pairs, n_used, mean_first, mean_second, w_plus, w_minus, rank_biserial, ties): `pairs` has metric, first, second, a row per revision.

    Differences of 0 and pairs with a null are left out; equal differences share the mean of their ranks. The rank-biserial
    correlation is (W+ - W-) / (W+ + W-), null without differences; it is positive if the first is larger.
    """
    both = pairs.where("first is not null and second is not null")
    d = both.withColumn("d", F.col("first") - F.col("second")).withColumn("a", F.round(F.abs("d"), 9))
    used = d.where("a > 0")
    rank = F.rank().over(Window.partitionBy("metric").orderBy("a")) + (F.count("*").over(Window.partitionBy("metric", "a")) - 1) / 2
    ranked = used.withColumn("r", rank)
    sums = ranked.groupBy("metric").agg(F.count("*").alias("n_used"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("w_minus"))
    tied = used.groupBy("metric", "a").agg(F.count("*").alias("t")).groupBy("metric").agg(F.array_sort(F.collect_list("t")).alias("ties"))
    means = both.groupBy("metric").agg(F.count("*").alias("n_pairs"), F.avg("first").alias("mean_first"), F.avg("second").alias("mean_second"))
    r = F.try_divide(F.col("w_plus") - F.col("w_minus"), F.col("w_plus") + F.col("w_minus"))
    return means.join(sums, "metric", "left").join(tied, "metric", "left").select("metric", "n_pairs", F.coalesce("n_used", F.lit(0)).alias("n_used"), "mean_first", "mean_second", F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), F.coalesce("w_minus", F.lit(0.0)).alias("w_minus"), r.alias("rank_biserial"), "ties")


@F.udf(T.DoubleType())
def _p(plus, minus, n, ties, zeros):
    return wilcoxon_p(plus, minus, n, list(ties or []), zeros)


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """signed_rank_sums with the two-sided `p_value`; one row per metric."""
    return signed_rank_sums(pairs).withColumn("p_value", _p("w_plus", "w_minus", F.col("n_used").cast("int"), "ties", (F.col("n_pairs") - F.col("n_used")).cast("int"))).drop("ties")


def paired_metrics(rates: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(metric, revision, first, second) of a rate table's columns; the Average row is left out."""
    rows = rates.where("prev_revision_id <> 'Average'")
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(a).cast("double").alias("first"), F.col(b).cast("double").alias("second")) for m, (a, b) in pairs.items()])
    return rows.select(F.col("prev_revision_id").alias("revision"), F.explode(cells).alias("x")).select("x.metric", "revision", "x.first", "x.second")


#: Metric: first, second column of rates_by_clone and of rates_by_similarity.
CLONE_METRICS = {
    "survived": ("survived_no_clone", "survived_clone"),
    "absorbed": ("absorbed_no_clone", "absorbed_clone"),
    "deleted": ("deleted_no_clone", "deleted_clone"),
    "absorbed_rate": ("no_clone_absorbed_rate", "clone_absorbed_rate"),
    "deleted_rate": ("no_clone_deleted_rate", "clone_deleted_rate"),
}
SIMILARITY_METRICS = {
    "survived": ("survived_low", "survived_high"),
    "absorbed": ("absorbed_low", "absorbed_high"),
    "deleted": ("deleted_low", "deleted_high"),
    "absorbed_rate": ("low_absorbed_rate", "high_absorbed_rate"),
    "deleted_rate": ("low_deleted_rate", "high_deleted_rate"),
}
