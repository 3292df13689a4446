"""Redelivered rows: the latest delivery of each key holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: dict[str, Column], attrs: dict[str, Column], loaded: str = "loaded_at") -> DataFrame:
    """One row per key with the attributes of the row delivered last.

    A maximum over (loaded, attributes) rather than a sorted window: it is aggregated before the shuffle, so a key
    that holds a third of all rows travels as one row per input split. Null keys form a group like others. A null
    `loaded` counts as earlier than any; rows that tie in `loaded` but differ resolve to the largest attributes, so
    the result is the same at every partitioning. Columns not named are ignored, whatever they are called.
    """
    names = list(attrs)
    shaped = df.select(*[c.alias(k) for k, c in keys.items()], F.struct(F.col(loaded).alias("_at"), *[c.alias(k) for k, c in attrs.items()]).alias("_row"))
    return shaped.groupBy(*keys).agg(F.max("_row").alias("_row")).select(*keys, *[F.col(f"_row.{n}").alias(n) for n in names])
