"""Clone pairs within revisions: median similarity, membership, cumulative groups and what became of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.matching import null_safe
from strata.session import Stored, stored


def pair_similarity() -> Column:
    """verify_similarity, or ngram_overlap where that is null."""
    return F.coalesce("verify_similarity", "ngram_overlap")


def median_similarity(pairs: DataFrame) -> DataFrame:
    """(revision_id, token_hash, median_similarity): the median of the medians over pairs in which the hash is first and second.

    Not the median of all its pairs. Exact and interpolated, rounded half even to one decimal; NaN and null scores are left out.
    Needs revision_id, token_hash_1, token_hash_2 and the scores. A hash's scores are counted by value before its median is taken.
    """
    score = pair_similarity()
    scored = pairs.withColumn("_s", score).where(F.col("_s").isNotNull() & ~F.isnan("_s"))
    sides = [scored.groupBy("revision_id", F.col(f"token_hash_{i}").alias("token_hash")).agg(F.expr("percentile(_s, 0.5)").alias("_m")) for i in (1, 2)]
    both = sides[0].unionByName(sides[1]).where("token_hash is not null")
    return both.groupBy("revision_id", "token_hash").agg(F.bround(F.expr("percentile(_m, 0.5)"), 1).alias("median_similarity"))


def with_median_similarity(tracked: DataFrame, medians: DataFrame) -> DataFrame:
    m = medians.select(F.col("revision_id").alias("_r"), F.col("token_hash").alias("_h"), "median_similarity")
    return tracked.join(m, (F.col("prev_revision_id") == F.col("_r")) & (F.col("prev_token_hash") == F.col("_h")), "left").drop("_r", "_h")


def pair_members(pairs: DataFrame) -> DataFrame:
    """(revision_id, token_hash) of every hash in a pair, without repeats."""
    return pairs.select("revision_id", F.explode(F.array("token_hash_1", "token_hash_2")).alias("token_hash")).where("token_hash is not null").distinct()


def with_has_clone(tracked: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds has_clone: the method's sequence is in a clone pair of its revision; false where it has none."""
    m = pair_members(pairs).select(F.col("revision_id").alias("_r"), F.col("token_hash").alias("_h"))
    return tracked.join(m, (F.col("prev_revision_id") == F.col("_r")) & (F.col("prev_token_hash") == F.col("_h")), "left").withColumn("has_clone", F.col("_h").isNotNull()).drop("_r", "_h")


def pair_summary(pairs: DataFrame) -> DataFrame:
    """(revision_id, token_hash, median_similarity) of every hash in a pair: median_similarity and pair_members in one pass over the pairs.

    A hash whose scores are all null or NaN has a null median.
    """
    score = F.when(~F.isnan(pair_similarity()), pair_similarity())
    ends = F.explode(F.array(*[F.struct(F.col(f"token_hash_{i}").alias("token_hash"), F.when(F.lit(i) == 1, score).alias("one"), F.when(F.lit(i) == 2, score).alias("two")) for i in (1, 2)]))
    sides = pairs.select("revision_id", ends.alias("e")).select("revision_id", "e.*").where("token_hash is not null").groupBy("revision_id", "token_hash").agg(F.expr("percentile(one, 0.5)").alias("a"), F.expr("percentile(two, 0.5)").alias("b"))
    return sides.select("revision_id", "token_hash", F.bround(F.coalesce((F.col("a") + F.col("b")) / 2, "a", "b"), 1).alias("median_similarity"))


def with_pairs(tracked: DataFrame, summary: DataFrame) -> DataFrame:
    """Adds median_similarity and has_clone from pair_summary, in one join."""
    m = summary.select(F.col("revision_id").alias("_r"), F.col("token_hash").alias("_h"), "median_similarity")
    return tracked.join(m, (F.col("prev_revision_id") == F.col("_r")) & (F.col("prev_token_hash") == F.col("_h")), "left").withColumn("has_clone", F.col("_h").isNotNull()).drop("_r", "_h")


def least_labels(edges: DataFrame, by: str) -> DataFrame:
    """(by, node, label) of every node of `edges` (by, a, b): the least node it is connected with in its graph; all graphs at once.

    Each node takes the least label around it, and its label's own is lowered as well (pointer jumping), until nothing
    changes. Every round is a written table. Graphs and nodes are spread by both, so a large graph is no hot spot.
    """
    ends = edges.where(f"a is not null and b is not null and {by} is not null").select(F.col(by).alias("g"), "a", "b")
    both = stored(ends.select("g", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("g", "e.x", "e.y").distinct())
    at = Stored(both.groupBy("g", "x").agg(F.least(F.min("y"), F.col("x")).alias("label")).select("g", F.col("x").alias("node"), "label", F.lit(True).alias("moved")))
    while True:
        here = at.df.select("g", "node", "label")
        around = both.join(here.select("g", F.col("node").alias("y"), "label"), ["g", "y"]).groupBy("g", F.col("x").alias("node")).agg(F.min("label").alias("near"))
        hooked = here.join(around, ["g", "node"]).select("g", "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # The least seen from any of a label's members lowers the label itself.
        pull = hooked.groupBy("g", F.col("old").alias("label")).agg(F.min("label").alias("lower"))
        lowest = F.least("label", F.coalesce("lower", "label"))
        new = Stored(hooked.join(pull, ["g", "label"], "left").select("g", "node", lowest.alias("label"), (lowest != F.col("old")).alias("moved")))
        moved = not new.df.where("moved").isEmpty()
        at.drop()
        at = new
        if not moved:
            return at.df.select(F.col("g").alias(by), "node", "label")


def label_steps(edges: DataFrame) -> DataFrame:
    """(node, since, label) of edges (a, b, first): the least node that each node is connected with by edges of any time up to `since`.

    A node's label only falls as time goes on, so it is kept as the steps at which it does rather than once for every time.
    In each round a node takes over the steps of its neighbours (from the time of the edge) and of its labels (pointer jumping), and
    a label those of the nodes that had it, until nothing changes. Before steps are put in order they are reduced to the least label per node and time, before the
    shuffle, so a hub's window holds no more rows than there are times. Every round is a written table.
    """
    ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    both = stored(edges.select("first", ends.alias("e")).groupBy("e.x", "e.y").agg(F.min("first").alias("t")))

    def reduced(candidates: DataFrame) -> Stored:
        """Of (node, since, label, fresh) the steps at which the label falls; `fresh` ones were not there before, and `old` was the label then."""
        least = candidates.groupBy("node", "since").agg(F.min(F.struct("label", "fresh")).alias("m"), F.min(F.when(~F.col("fresh"), F.col("label"))).alias("o")).select("node", "since", "m.*", "o")
        upto = Window.partitionBy("node").orderBy("since")
        before = F.min("label").over(upto.rowsBetween(Window.unboundedPreceding, -1))
        return Stored(least.withColumns({"_b": before, "old": F.min("o").over(upto)}).where("_b is null or label < _b").drop("_b", "o"))

    at = reduced(both.select(F.col("x").alias("node"), F.col("t").alias("since"), F.least("x", "y").alias("label"), F.lit(True).alias("fresh")))
    while True:
        here = at.df.select("node", "since", "label")
        around = both.join(here.withColumnRenamed("node", "y"), "y").select(F.col("x").alias("node"), F.greatest("t", "since").alias("since"), "label", F.lit(True).alias("fresh"))
        further = here.select(F.col("node").alias("label"), F.col("since").alias("s"), F.col("label").alias("l")).where("label <> l")
        jumped = here.join(further, "label").select("node", F.greatest("since", "s").alias("since"), F.col("l").alias("label"), F.lit(True).alias("fresh"))
        pulled = at.df.where("fresh and old is not null").select(F.col("old").alias("node"), "since", "label", "fresh")
        new = reduced(here.withColumn("fresh", F.lit(False)).unionByName(around).unionByName(jumped).unionByName(pulled))
        done = new.df.where("fresh").isEmpty()
        at.drop()
        at = new
        if done:
            return at.df.select("node", "since", "label")


def cumulative_groups(pairs: DataFrame, per_revision: bool = False) -> DataFrame:
    """(revision_id, token_hash, group_id): in every revision, each hash seen so far and the least hash it is connected with by
    the pairs of that revision or any before. `per_revision` looks at each revision's own pairs alone.

    Each different pair is looked at once, with its first revision (label_steps); only the result has a row for each hash and revision.
    """
    links = pairs.where("token_hash_1 is not null and token_hash_2 is not null and revision_id is not null").select("revision_id", F.least("token_hash_1", "token_hash_2").alias("a"), F.greatest("token_hash_1", "token_hash_2").alias("b"))
    if per_revision:
        return least_labels(links.distinct(), "revision_id").select("revision_id", F.col("node").alias("token_hash"), F.col("label").alias("group_id"))
    links = stored(links.groupBy("a", "b").agg(F.min("revision_id").alias("first"), F.collect_set("revision_id").alias("all")))
    kind = pairs.schema["revision_id"].dataType
    # One row per revision; as texts, free of time zones.
    revisions = [r[0] for r in links.select(F.explode("all").alias("r")).distinct().select(F.col("r").cast("string")).collect()]
    steps = label_steps(links.select("a", "b", "first")).withColumn("until", F.lead("since").over(Window.partitionBy("node").orderBy("since")))
    times = F.filter(F.array(*[F.lit(r).cast(kind) for r in revisions]).cast(f"array<{kind.simpleString()}>"), lambda r: (r >= F.col("since")) & (F.col("until").isNull() | (r < F.col("until"))))
    return steps.select(F.explode(times).alias("revision_id"), F.col("node").alias("token_hash"), F.col("label").alias("group_id"))


def with_groups(tracked: DataFrame, groups: DataFrame) -> DataFrame:
    g = groups.select(F.col("revision_id").alias("_r"), F.col("token_hash").alias("_h"), "group_id")
    return tracked.join(g, (F.col("prev_revision_id") == F.col("_r")) & (F.col("prev_token_hash") == F.col("_h")), "left").drop("_r", "_h")


def with_deletion_status(tracked: DataFrame) -> DataFrame:
    """Adds is_all_deleted and is_partial_deleted to the deleted rows with clones whose group, in that revision, is deleted
    wholly or in part. Groups are aggregated before they are joined, so a large one is no hot spot."""
    members = tracked.where(F.col("has_clone") & F.col("group_id").isNotNull())
    state = members.groupBy(F.col("prev_revision_id").alias("_r"), F.col("group_id").alias("_g")).agg(F.bool_and("is_deleted").alias("_all"), F.bool_or("is_deleted").alias("_any"))
    deleted = F.col("is_deleted") & F.col("has_clone")
    return (
        tracked.join(state, null_safe({"r": F.col("prev_revision_id")}, {"r": F.col("_r")}) & (F.col("group_id") == F.col("_g")), "left")
        .withColumn("is_all_deleted", F.coalesce(deleted & F.col("_all"), F.lit(False)))
        .withColumn("is_partial_deleted", F.coalesce(deleted & F.col("_any") & ~F.col("_all"), F.lit(False)))
        .drop("_r", "_g", "_all", "_any")
    )


def revision_labels(tracked: DataFrame) -> DataFrame:
    """(prev_revision_id, group_id, rev_status): all_deleted, partial_deleted or no_deleted for every group and revision."""
    g = tracked.where("group_id is not null").groupBy("prev_revision_id", "group_id").agg(F.bool_and("is_deleted").alias("_all"), F.bool_or("is_deleted").alias("_any"), F.count("*").alias("n_members"))
    return g.select("prev_revision_id", "group_id", "n_members", F.when(F.col("_all"), "all_deleted").when(F.col("_any"), "partial_deleted").otherwise("no_deleted").alias("rev_status"))


def filter_labels(labels: DataFrame, statuses: list[str]) -> DataFrame:
    return labels.where(F.col("rev_status").isin(statuses))


def group_snapshot(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """(revision_id, group_id, n_members, n_edges, density, avg/min/max_similarity) of groups in each revision."""
    size = groups.groupBy("revision_id", "group_id").agg(F.count("*").alias("n_members"))
    g = groups.select(F.col("revision_id").alias("_r"), F.col("token_hash").alias("_h"), "group_id")
    edges = (
        pairs.withColumn("_s", pair_similarity())
        .where("token_hash_1 <> token_hash_2")
        .groupBy("revision_id", F.least("token_hash_1", "token_hash_2").alias("x"), F.greatest("token_hash_1", "token_hash_2").alias("y"))
        .agg(F.max(F.when(~F.isnan("_s"), F.col("_s"))).alias("s"))
        .join(g, (F.col("revision_id") == F.col("_r")) & (F.col("x") == F.col("_h")))
        .groupBy("revision_id", "group_id")
        .agg(F.count("*").alias("n_edges"), F.avg("s").alias("avg_similarity"), F.min("s").alias("min_similarity"), F.max("s").alias("max_similarity"))
    )
    n = F.col("n_members")
    return size.join(edges, ["revision_id", "group_id"], "left").select("revision_id", "group_id", "n_members", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.try_divide(2.0 * F.coalesce("n_edges", F.lit(0)), (n * (n - 1)).cast("double")).alias("density"), "avg_similarity", "min_similarity", "max_similarity")


def clone_group_report(snapshot: DataFrame, least_members: int = 2, group_id: str | None = None) -> DataFrame:
    """Groups with at least `least_members`, or a single one by its id."""
    kept = snapshot.where(F.col("n_members") >= least_members)
    return kept.where(F.col("group_id") == group_id) if group_id is not None else kept


def track_groups(groups: DataFrame, steps: DataFrame, overlap: float = 0.5) -> DataFrame:
    """What became of each group from one revision to the next.

    (revision_id, next_revision_id, group_id, next_group_id, state, n_members, n_next, n_common, member_added, member_removed). Groups match
    if their common members are at least `overlap` of the smaller group. state: split (one to several), merged (several
    to one), grown, shrunk, continued; dissolved (no match after), born (none before).
    """
    sizes = groups.groupBy("revision_id", "group_id").agg(F.count("*").alias("n"))
    before = groups.join(steps.where("next_revision_id is not null").select("revision_id", "next_revision_id"), "revision_id").select("revision_id", "next_revision_id", "token_hash", "group_id")
    after = groups.select(F.col("revision_id").alias("next_revision_id"), "token_hash", F.col("group_id").alias("next_group_id"))
    common = before.join(after, ["next_revision_id", "token_hash"]).groupBy("revision_id", "next_revision_id", "group_id", "next_group_id").agg(F.count("*").alias("n_common"))
    a = sizes.select("revision_id", "group_id", F.col("n").alias("n_members"))
    b = sizes.select(F.col("revision_id").alias("next_revision_id"), F.col("group_id").alias("next_group_id"), F.col("n").alias("n_next"))
    linked = common.join(a, ["revision_id", "group_id"]).join(b, ["next_revision_id", "next_group_id"]).where(F.col("n_common") >= overlap * F.least("n_members", "n_next"))
    outs = linked.groupBy("revision_id", "group_id").agg(F.count("*").alias("n_out"))
    ins = linked.groupBy("next_revision_id", "next_group_id").agg(F.count("*").alias("n_in"))
    state = F.when(F.col("n_out") > 1, "split").when(F.col("n_in") > 1, "merged").when(F.col("n_next") > F.col("n_members"), "grown").when(F.col("n_next") < F.col("n_members"), "shrunk").otherwise("continued")
    columns = ["revision_id", "next_revision_id", "group_id", "next_group_id", "state", "n_members", "n_next", "n_common", "member_added", "member_removed"]
    moved = linked.join(outs, ["revision_id", "group_id"]).join(ins, ["next_revision_id", "next_group_id"]).withColumns({"state": state, "member_added": F.col("n_next") - F.col("n_common"), "member_removed": F.col("n_members") - F.col("n_common")}).select(*columns)
    gone = before.select("revision_id", "next_revision_id", "group_id").distinct().join(linked.select("revision_id", "group_id"), ["revision_id", "group_id"], "left_anti").join(a, ["revision_id", "group_id"])
    gone = gone.select("revision_id", "next_revision_id", "group_id", F.lit(None).cast("string").alias("next_group_id"), F.lit("dissolved").alias("state"), "n_members", F.lit(None).cast("long").alias("n_next"), F.lit(0).cast("long").alias("n_common"), F.lit(0).cast("long").alias("member_added"), F.col("n_members").alias("member_removed"))
    born = b.join(steps.where("next_revision_id is not null").select("revision_id", "next_revision_id"), "next_revision_id").join(linked.select("next_revision_id", "next_group_id"), ["next_revision_id", "next_group_id"], "left_anti")
    born = born.select("revision_id", "next_revision_id", F.lit(None).cast("string").alias("group_id"), "next_group_id", F.lit("born").alias("state"), F.lit(None).cast("long").alias("n_members"), "n_next", F.lit(0).cast("long").alias("n_common"), F.col("n_next").alias("member_added"), F.lit(0).cast("long").alias("member_removed"))
    return moved.unionByName(gone).unionByName(born)


def group_statistics(snapshot: DataFrame) -> DataFrame:
    """Per revision: groups, members, mean and greatest size, mean density and similarity of the groups (see group_snapshot)."""
    return snapshot.groupBy("revision_id").agg(F.count("*").alias("n_groups"), F.sum("n_members").alias("n_members"), F.avg("n_members").alias("mean_members"), F.max("n_members").alias("most_members"), F.avg("density").alias("mean_density"), F.avg("avg_similarity").alias("mean_similarity"))


def group_state_counts(tracking: DataFrame) -> DataFrame:
    """(revision_id, state, n) of track_groups."""
    return tracking.groupBy("revision_id", "state").agg(F.count("*").alias("n"))
