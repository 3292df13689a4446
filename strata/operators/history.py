"""History of changing attributes: a type-two dimension kept by merging updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.text import digest


def empty_dimension(like: DataFrame, keys: list[str], attrs: list[str], time: str) -> DataFrame:
    """A dimension without versions, with the types of `like`."""
    return like.limit(0).select(*keys, *attrs, F.col(time).alias("valid_from"), F.col(time).alias("valid_to"), F.lit(True).alias("is_current"))


def merge_versions(dimension: DataFrame, updates: DataFrame, keys: list[str], attrs: list[str], time: str) -> DataFrame:
    """Merges `updates` (any number of periods, one row per key and time) into a type-two dimension.

    The dimension has the keys, the attributes, valid_from, valid_to (null while open) and is_current. Each update is
    compared, by attribute hash and then by value, with the version that holds before it; an equal one changes
    nothing, another one closes that version at its time and opens a new one. All periods are merged at once: the
    versions of a key and its updates are laid out in time order and only the first row of each run is kept, so
    one shuffle on the key does for one period or for a thousand. A key has at most one row per period, so
    no group grows with the table.

    Defined cases: null attributes are values like others; rows with a null time or with all keys null are left out
    (some keys null: a key like others); repeated updates change nothing; of two different updates of one key at one
    time the larger attributes win; an update older than the open version splits the version that held at its time.
    An empty update set returns the dimension, an empty dimension the history of the updates. Other columns are dropped.
    """
    some_key = F.greatest(*[F.col(k).isNotNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNotNull()
    old = dimension.select(*keys, F.col("valid_from").alias("_t"), F.lit(0).alias("_new"), *attrs)
    new = updates.where(F.col(time).isNotNull() & some_key).select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_new"), *attrs)
    # At equal time an update replaces the stored version; of several updates the largest holds.
    events = old.unionByName(new).groupBy(*keys, "_t").agg(F.max(F.struct("_new", *attrs)).alias("_v")).select(*keys, "_t", *[F.col(f"_v.{a}").alias(a) for a in attrs])
    by_time = Window.partitionBy(*keys).orderBy("_t")
    current = F.struct(*attrs)
    kept = (
        events.withColumn("_hash", digest(*attrs))
        .withColumn("_first", F.row_number().over(by_time) == 1)
        .withColumn("_same", (F.lag("_hash").over(by_time) == F.col("_hash")) & F.lag(current).over(by_time).eqNullSafe(current))
        .where(F.col("_first") | ~F.col("_same"))
    )
    closing = F.lead("_t").over(by_time)
    return kept.select(*keys, *attrs, F.col("_t").alias("valid_from"), closing.alias("valid_to"), closing.isNull().alias("is_current"))
