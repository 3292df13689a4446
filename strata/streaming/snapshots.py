"""Full snapshots as they are delivered: the last one and its digests are kept, so that the next is compared with what is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.snapshot_diff import FAN_OUT_BITS, differing_leaves, hashed_rows
from strata.streaming.incremental import VersionedTable

#: Hash bits of the folders in which a snapshot's rows lie.
FOLDER_BITS = 4


class KeptSnapshot:
    """A table of full snapshots at `path`. `deliver` compares a snapshot with the one before it.

    Kept are the last snapshot's rows, in folders by hash range of the key, and the digests of its leaves (see
    snapshot_diff). A delivery hashes its own rows only; of the snapshot before it reads the digests, and the rows of those
    folders in which a leaf differs (dynamic partition pruning). `bits` is fixed when a table begins.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], attrs: list[str], bits: int = 16):
        if bits % FAN_OUT_BITS or bits < FOLDER_BITS:
            raise ValueError(f"bits must be a multiple of {FAN_OUT_BITS}")
        self.keys, self.attrs, self.bits = keys, attrs, bits
        self.rows, self.digests = VersionedTable(spark, f"{path.rstrip('/')}/rows"), VersionedTable(spark, f"{path.rstrip('/')}/digests")

    def deliver(self, snapshot: DataFrame) -> DataFrame:
        """(keys, change, old_*, new_*) against the last snapshot delivered (against nothing: all added); one row per key, as in diff_snapshots."""
        number = len(self.digests.versions()) and self.digests.versions()[-1] + 1
        leaf = F.shiftrightunsigned(F.col("_h"), 64 - self.bits)
        made = hashed_rows(snapshot, self.keys, self.attrs, []).withColumn("_leaf", leaf).withColumn("_folder", F.shiftrightunsigned(F.col("_leaf"), self.bits - FOLDER_BITS).cast("int"))
        made = made.drop("_h")
        self.rows.write(made, number, by=["_folder"])
        new = self.rows.read(number + 1, made.schema)
        self.digests.write(new.groupBy("_leaf").agg(F.bit_xor("_d1").alias("_d1"), F.bit_xor("_d2").alias("_d2"), F.count("*").alias("_c")), number)
        old_rows, old = self.rows.read(number, made.schema), self.digests.read(number)
        sides = self.digests.read(number + 1)
        if old is not None:
            sides = sides.unionByName(old.withColumn("_c", -F.col("_c")))
        both = sides.groupBy(F.lit(0).alias("_pair"), "_leaf").agg(F.bit_xor("_d1").alias("_d1"), F.bit_xor("_d2").alias("_d2"), F.sum("_c").alias("_c"))
        differ = differing_leaves(both, self.bits).select("_node", F.shiftrightunsigned("_node", self.bits - FOLDER_BITS).cast("int").alias("_f"))

        def touched(rows: DataFrame, is_old: bool) -> DataFrame:
            return rows.join(differ, (rows["_folder"] == differ["_f"]) & (rows["_leaf"] == differ["_node"]), "left_semi").select(*self.keys, *self.attrs, F.lit(is_old).alias("_old"))

        looked_at = touched(new, False) if old_rows is None else touched(new, False).unionByName(touched(old_rows, True))
        side = F.struct(*self.attrs) if self.attrs else F.struct(F.lit(1).alias("_"))
        pairs = looked_at.groupBy(*self.keys).agg(F.max(F.when(F.col("_old"), side)).alias("_o"), F.max(F.when(~F.col("_old"), side)).alias("_w"))
        change = F.when(F.col("_o").isNull(), "added").when(F.col("_w").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_w")), "changed")
        return pairs.withColumn("change", change).where("change is not null").select(*self.keys, "change", *[F.col(f"_o.{a}").alias(f"old_{a}") for a in self.attrs], *[F.col(f"_w.{a}").alias(f"new_{a}") for a in self.attrs])
