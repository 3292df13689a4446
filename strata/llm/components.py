"""Consolidating pairwise matches into groups: connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.session import Stored


def connected_components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every value of `a` and `b` that a pair of different values links; the component is its least node.

    Each round gives the vertices a fresh random order (a seeded hash) and hooks each vertex to the first in its closed
    neighbourhood; edges are relabelled, made unique and loops dropped. A vertex hooks to itself only if it is first
    among its neighbours, so a constant share of vertices vanishes in every round, whatever the graph's diameter, and at least
    one (the last in order of any that have an edge), so the rounds end without a bound on their number. The rounds' mappings are then composed from the last to the first.

    A hub with a third of all edges is no hot spot: its edges are reduced by partial aggregation where a neighbourhood's first
    is sought, and the relabelling joins, one row per vertex on the other side, are split by adaptive execution. Every
    round is a written table, so lost executors cost no rounds, and nothing but row counts reaches the driver.
    Null ends, self-pairs and repeated or reversed pairs link nothing further; no pairs give no rows.
    """
    kind = pairs.schema[a].dataType
    ends = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).cast(kind).alias("a"), F.col(b).cast(kind).alias("b"))
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    edges = Stored(ends.select(both.alias("e")).select("e.a", "e.b").distinct())
    steps: list[Stored] = []
    while not edges.df.isEmpty():
        seed = F.lit(len(steps))
        order = lambda c: F.struct(F.xxhash64(seed, F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        first = F.least(F.min(order("b")), order("a"))
        steps.append(Stored(edges.df.groupBy("a").agg(first.alias("r")).select(F.col("a").alias("v"), F.col("r.v").alias("r"))))
        hooks = steps[-1].df
        # A vertex's edges are kept once, from the smaller end; the other direction comes back after relabelling.
        half = edges.df.where("a < b")
        moved = half.join(hooks.select(F.col("v").alias("a"), F.col("r").alias("ra")), "a").join(hooks.select(F.col("v").alias("b"), F.col("r").alias("rb")), "b")
        again = moved.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        old, edges = edges, Stored(again.select(both.alias("e")).select("e.a", "e.b"))
        old.drop()
    if not steps:
        return edges.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = steps[-1]
    for step in reversed(steps[:-1]):
        last = labels.df.select(F.col("v").alias("r"), F.col("r").alias("label"))
        new = Stored(step.df.join(last, "r", "left").select("v", F.coalesce("label", "r").alias("r")))
        labels.drop()
        step.drop()
        labels = new
    least = labels.df.groupBy("r").agg(F.min("v").alias("component"))
    return labels.df.join(least, "r").select(F.col("v").alias("node"), "component")
