"""What changed between consecutive full snapshots: Merkle trees over hash ranges of the keys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.text import digest
from strata.session import stored

#: Hash bits by which one level of the tree is finer than the one above.
FAN_OUT_BITS = 4


def tree_bits(rows: int, snapshots: int, leaf_rows: int) -> int:
    """Levels' total bits such that a leaf has about `leaf_rows` keys of a snapshot; a multiple of FAN_OUT_BITS."""
    leaves = max(1, rows / max(1, snapshots) / leaf_rows)
    return min(60, max(FAN_OUT_BITS, FAN_OUT_BITS * math.ceil(math.log2(leaves) / FAN_OUT_BITS)))


def differing_leaves(digests: DataFrame, bits: int) -> DataFrame:
    """(_p, _node): the leaves that differ, from the XORed digests (_pair, _leaf, _d1, _d2, _c) of both sides: top-down, children of differing nodes only."""
    differs = (F.col("_d1") != 0) | (F.col("_d2") != 0) | (F.col("_c") != 0)
    above: DataFrame | None = None
    for level in range(0, bits + 1, FAN_OUT_BITS):
        up = F.shiftrightunsigned(F.col("_leaf"), bits - level)
        at = digests if above is None else digests.join(above, (digests["_pair"] == above["_p"]) & (F.shiftrightunsigned(F.col("_leaf"), bits - level + FAN_OUT_BITS) == above["_node"]), "left_semi")
        above = (
            at.groupBy("_pair", up.alias("_node"))
            .agg(F.bit_xor("_d1").alias("_d1"), F.bit_xor("_d2").alias("_d2"), F.sum("_c").alias("_c"))
            .where(differs)
            .select(F.col("_pair").alias("_p"), "_node")
        )
    assert above is not None
    return above


def hashed_rows(df: DataFrame, keys: list[str], attrs: list[str], others: list[str]) -> DataFrame:
    """The columns with the hash of the keys and the two digests of the row."""
    return df.select(*others, *keys, *attrs, digest(*keys, seed=1).alias("_h"), digest(*keys, *attrs, seed=2).alias("_d1"), digest(*attrs, *keys, seed=3).alias("_d2"))


def diff_snapshots(df: DataFrame, snapshot: str, keys: list[str], attrs: list[str], leaf_rows: int = 8) -> DataFrame:
    """The keys added, removed or changed from each snapshot to the next.

    `df` has one row per (snapshot, keys). Returns the later snapshot, the keys, `change`, and the attributes before
    and after as `old_*` and `new_*`.

    Keys are spread over 2**bits hash ranges (leaves). A node's digest is the XOR of its rows' two 64-bit digests,
    beside their number, so a parent's comes from its children and nothing has to be sorted. For two consecutive
    snapshots the digests of both sides are XORed: a node differs if that isn't zero or the counts differ. From the
    root down, only children of differing nodes are looked at, and only rows in differing leaves are compared, by
    value. A node that differs can cancel out with probability 2**-128.

    Nulls in keys and attributes are values like others; rows without a snapshot are left out; an empty table or a
    single snapshot gives no rows. Repeated rows must have been resolved (see deliveries.latest).
    """
    if any(c.startswith("_") for c in (snapshot, *keys, *attrs)):
        raise ValueError("column names must not begin with an underscore")
    base = stored(hashed_rows(df.where(F.col(snapshot).isNotNull()), keys, attrs, [snapshot]))
    # One row per snapshot: their number is small, and the window runs over these only.
    order = stored(base.select(snapshot).distinct().select(snapshot, F.row_number().over(Window.orderBy(snapshot)).alias("_n")))
    snapshots, rows = order.count(), base.count()
    bits = tree_bits(rows, snapshots, leaf_rows)

    def node(level: int):
        return F.shiftrightunsigned(F.col("_h"), 64 - level) if level else F.lit(0).cast("long")

    leaf = base.join(order, snapshot).withColumn("_leaf", node(bits))
    # As the new side a snapshot belongs to the pair of its own number, as the old side to the next one's.
    pairs = F.explode(F.array(*[F.struct((F.col("_n") + k).alias("_pair"), F.lit(bool(k)).alias("_old")) for k in (0, 1)]))
    inside = F.col("_pair").between(2, snapshots)
    digests = stored(
        leaf.groupBy("_n", "_leaf")
        .agg(F.bit_xor("_d1").alias("_d1"), F.bit_xor("_d2").alias("_d2"), F.count("*").alias("_c"))
        .select("*", pairs.alias("_p"))
        .select(F.col("_p._pair").alias("_pair"), "_leaf", "_d1", "_d2", F.when(F.col("_p._old"), -F.col("_c")).otherwise(F.col("_c")).alias("_c"))
        .where(inside)
        .groupBy("_pair", "_leaf")
        .agg(F.bit_xor("_d1").alias("_d1"), F.bit_xor("_d2").alias("_d2"), F.sum("_c").alias("_c"))
    )
    above = differing_leaves(digests, bits)
    rows_in_pairs = leaf.select("*", pairs.alias("_s")).select("*", F.col("_s._pair").alias("_pair"), F.col("_s._old").alias("_old")).where(inside)
    touched = rows_in_pairs.join(above, (F.col("_pair") == F.col("_p")) & (F.col("_leaf") == F.col("_node")), "left_semi")
    side = F.struct(*attrs) if attrs else F.struct(F.lit(1).alias("_"))
    both = touched.groupBy("_pair", *keys).agg(F.max(F.when(F.col("_old"), side)).alias("_o"), F.max(F.when(~F.col("_old"), side)).alias("_w"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_w").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_w")), "changed")
    return (
        both.withColumn("change", change)
        .where(F.col("change").isNotNull())
        .join(order.select(F.col("_n").alias("_pair"), snapshot), "_pair")
        .select(snapshot, *keys, "change", *[F.col(f"_o.{a}").alias(f"old_{a}") for a in attrs], *[F.col(f"_w.{a}").alias(f"new_{a}") for a in attrs])
    )
