"""Stable method identifiers over a series of matches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.clones import least_labels
from strata.schemas import SIGNATURE
from strata.session import stored

#: Rows that are passed over in order in one task.
ROWS_PER_TASK = 100_000


def name_digest(*parts: Column) -> Column:
    """128 bits (md5, as hexadecimal text) of texts in which null differs from every text and no two lists of parts run together."""
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]))


def _node(side: str) -> Column:
    """A digest of a method in a revision."""
    return name_digest(F.col(f"{side}_revision_id").cast("string"), *[F.col(f"{side}_{c}") for c in SIGNATURE])


def _order(c: str) -> tuple[Column, Column]:
    return F.col(c).isNull(), F.col(c)


def assign_ids(matches: DataFrame) -> DataFrame:
    """Adds method_id, is_absorbed and is_absorber to combined matches in which every signature match leads to its own signature.

    Methods in revisions are nodes. Of the matches that lead to a node one is primary: a signature match before others, then the
    greatest similarity, then the first source by signature. The primary matches form chains; a chain's id is the digest of
    its first node, found by pointer doubling: with s steps log2(s) self-joins. The others are absorbed, and go on under
    ids of their own until there. The primary match into a node that absorbs is an absorber if it keeps its signature, else
    it is absorbed as well: several methods became one that none of them was. Ids are digests, the same at every
    partitioning. Added methods (null prev_revision_id) begin a chain; deleted ones end it.
    """
    # A row's own node is the method before the step, for an added method the one after it.
    rows = matches.withColumn("_p", F.when(F.col("prev_revision_id").isNotNull(), _node("prev"))).withColumn("_c", F.when(F.col("curr_revision_id").isNotNull(), _node("curr")))
    rows = stored(rows)
    same = F.lit(True)
    for c in SIGNATURE:
        same = same & F.col(f"prev_{c}").eqNullSafe(F.col(f"curr_{c}"))
    moves = rows.where(F.col("_p").isNotNull() & F.col("_c").isNotNull()).withColumn("_same", same)
    rank = F.struct((~F.col("is_sig_matched")).alias("a"), (-F.coalesce("similarity", F.lit(-1.0))).alias("b"), *[F.struct(*_order(f"prev_{c}")).alias(f"k{i}") for i, c in enumerate(SIGNATURE)], F.col("_p").alias("p"), F.col("_same").alias("same"))
    into = stored(moves.groupBy("_c").agg(F.min(rank).alias("_r"), F.count("*").alias("_n")).select(F.col("_c").alias("_to"), F.col("_r.p").alias("_from"), F.col("_r.same").alias("_keeps"), "_n"))
    # Chains: each node points to its primary source; pointers are doubled until none moves.
    jump = stored(into.select(F.col("_to").alias("v"), F.col("_from").alias("up")))
    while True:
        ahead = jump.select(F.col("v").alias("up"), F.col("up").alias("further"))
        new = stored(jump.join(ahead, "up", "left").select("v", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")))
        moved = not new.where("moved").isEmpty()
        jump = new.select("v", "up")
        if not moved:
            break
    joined = rows.join(into, F.col("_c") == F.col("_to"), "left").withColumn("_own", F.coalesce("_p", "_c")).join(jump, F.col("_own") == F.col("v"), "left")
    primary = F.col("_p").isNotNull() & F.col("_c").isNotNull() & F.col("_from").eqNullSafe(F.col("_p"))
    shared = F.coalesce(F.col("_n") > 1, F.lit(False))
    moving = F.col("_p").isNotNull() & F.col("_c").isNotNull()
    return joined.select(
        *matches.columns,
        F.coalesce("up", "_own").alias("method_id"),
        (moving & shared & (~primary | ~F.col("_keeps"))).alias("is_absorbed"),
        (moving & shared & primary & F.col("_keeps")).alias("is_absorber"),
    )


def id_statistics(assigned: DataFrame) -> DataFrame:
    """(statistic, n): rows, ids, and rows by what became of them."""
    one = assigned.agg(
        F.count("*").alias("rows"),
        F.count_distinct("method_id").alias("methods"),
        F.count_if("is_matched").alias("matched"),
        F.count_if("is_deleted").alias("deleted"),
        F.count_if("is_added").alias("added"),
        F.count_if("is_sig_matched").alias("signature_matched"),
        F.count_if(F.col("is_matched") & ~F.col("is_sig_matched")).alias("similarity_matched"),
        F.count_if("is_absorbed").alias("absorbed"),
        F.count_if("is_absorber").alias("absorbers"),
        F.count_if(F.col("is_matched") & ~F.col("is_absorbed") & ~F.col("is_absorber")).alias("continued"),
        F.count_distinct(F.when(F.col("is_absorbed"), F.col("method_id"))).alias("absorbed_methods"),
    )
    return one.unpivot([], one.columns, "statistic", "n")


def assign_ids_in_order(matches: DataFrame) -> DataFrame:
    """Identifiers as the original analysis assigns them: a pass in order over a table of the keys now alive, without revisions.

    A matched or deleted row takes its key out of the table and goes on under its number, or under a new one; a matched row
    enters its new key, unless that is taken: then it is absorbed, and the row that holds the key is an absorber if that row kept its
    signature or was added, else absorbed as well. An added row takes a new number and its key, whoever holds it.

    The order matters and one row may change what an earlier one became. But rows act on each other through signatures
    only, so signatures linked by rows, directly or through others (least_labels), are passed over by themselves. A set is as large as renames and merges make it; assign_ids needs no such pass and is the form for tables in which
    a set outgrows a task. A number is the digest of the row that opened it, the same at every partitioning.
    """
    keys = [f"{s}_{c}" for s in ("prev", "curr") for c in SIGNATURE]
    columns = ["prev_revision_id", "curr_revision_id", *keys, "is_sig_matched", "is_matched", "is_deleted", "is_added"]
    sides = {s: name_digest(*[F.col(f"{s}_{c}") for c in SIGNATURE]) for s in ("prev", "curr")}
    rows = matches.select(*columns, sides["prev"].alias("_p"), sides["curr"].alias("_c"), (~F.col("is_sig_matched")).cast("int").alias("_sig"), (-F.coalesce("similarity", F.lit(-1.0))).alias("_far"))
    rows = stored(rows.withColumn("_row", name_digest(F.col("prev_revision_id").cast("string"), F.col("_p"), F.col("curr_revision_id").cast("string"), F.col("_c"))).withColumn("_own", F.when(F.col("is_added"), F.col("_c")).otherwise(F.col("_p"))))
    links = rows.where("is_matched and _p <> _c").select(F.lit(0).alias("g"), F.col("_p").alias("a"), F.col("_c").alias("b"))
    # Many small sets share a task: sets do not act on each other, so they may be passed over together.
    tasks = max(1, rows.count() // ROWS_PER_TASK)
    sets = least_labels(links, "g").select(F.col("node").alias("_own"), "label")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["prev_revision_id", "curr_revision_id", "_sig", "_far", *keys, "_row"], na_position="last", ignore_index=True, kind="stable")
        alive: dict[str, tuple[str, int, bool]] = {}
        ids, absorbed, absorber = [], [False] * len(pdf), [False] * len(pdf)
        for i, r in enumerate(zip(pdf["_row"], pdf["_p"], pdf["_c"], pdf["is_matched"], pdf["is_deleted"], pdf["is_added"])):
            number, before, after, matched, deleted, added = r
            if (matched or deleted) and before in alive:
                number = alive.pop(before)[0]
            ids.append(number)
            if matched and after in alive:
                absorbed[i] = True
                _, holder, keeps = alive[after]
                (absorber if keeps else absorbed)[holder] = True
            elif matched:
                alive[after] = number, i, before == after
            elif added and not deleted:
                alive[after] = number, i, True
        return pdf[columns].assign(method_id=ids, is_absorbed=absorbed, is_absorber=absorber)

    kinds = {f.name: f.dataType.simpleString() for f in matches.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", method_id string, is_absorbed boolean, is_absorber boolean"
    return rows.join(sets, "_own", "left").withColumn("_task", F.pmod(F.xxhash64(F.coalesce("label", "_own")), F.lit(tasks))).drop("label", "_own").groupBy("_task").applyInPandas(run, schema)


def relabel_chains(tracking: DataFrame, block: str = "block_id", matched: str = "matched_block_id") -> DataFrame:
    """Replaces a column that names a row's successor by `global_block_id`, the first block of its chain (pointer doubling)."""
    up = stored(tracking.where(F.col(matched).isNotNull()).groupBy(F.col(matched).alias("v")).agg(F.min(block).alias("up")))
    while True:
        new = stored(up.join(up.select(F.col("v").alias("up"), F.col("up").alias("further")), "up", "left").select("v", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")))
        done = new.where("moved").isEmpty()
        up = new.select("v", "up")
        if done:
            break
    return tracking.join(up, F.col(block) == F.col("v"), "left").withColumn("global_block_id", F.coalesce("up", F.col(block))).drop("v", "up", matched)


def lifetimes(rows: DataFrame, key: str, time: str) -> DataFrame:
    """Per key the number of revisions it occurs in, the days from the first to the last, and both."""
    return rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key).agg(F.count_distinct(time).alias("lifetime_revisions"), F.datediff(F.max(time), F.min(time)).cast("long").alias("lifetime_days"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))


