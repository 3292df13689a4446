"""Rate tables as csv files with several header lines, as spreadsheets of the original analysis have them, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.rates import coerce


def write_pivot(table: DataFrame, path: str, levels: int = 2) -> None:
    """A rate table with `levels` header lines: a name is cut at its underscores, the last part being the lowest level.

    A table has one row per revision, so it is written as one file, in order, the Average row last.
    """
    heads = [[*([""] * (levels - 1)), c] if i == 0 else [*(x := c.rsplit("_", levels - 1)), *([""] * (levels - len(x)))] for i, c in enumerate(table.columns)]
    key, spark = table.columns[0], table.sparkSession
    header = spark.createDataFrame([(k, ",".join(h[k] for h in heads)) for k in range(levels)], "_n int, line string")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns]
    rows = table.select(F.lit(levels).alias("_n"), F.concat_ws(",", *cells).alias("line"), (F.col(key) == "Average").alias("_last"), F.col(key).alias("_key"))
    whole = header.withColumns({"_last": F.lit(False), "_key": F.lit("")}).unionByName(rows)
    whole.orderBy("_n", "_last", "_key").coalesce(1).select("line").write.mode("overwrite").text(path)


def read_pivot(spark: SparkSession, path: str, columns: list[str], levels: int = 2, names: dict[str, str] | None = None) -> DataFrame:
    """The table again, columns by position: without the header lines and the Average row, numbers as doubles (null for what is
    none), the first column as a timestamp. `names` renames columns."""
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    # A header line is one in which the first column is no time.
    return coerce(raw, times=columns[:1], numbers=columns[1:], names=names or {}).where(F.col((names or {}).get(columns[0], columns[0])).isNotNull())
