"""Incremental forms: histories and drift counts that follow a stream of deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from strata.operators.deliveries import latest
from strata.operators.history import empty_dimension, merge_versions
from strata.operators.matching import null_safe


class VersionedTable:
    """A table kept as one folder per version. A reader sees the last version that was written whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, fs = self._fs()
        if not fs.exists(at):
            return []
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def read(self, before: int | None = None, schema: StructType | None = None) -> DataFrame | None:
        """The last version, or the last before `before`; a version in folders may be empty, so it needs a schema."""
        v = [x for x in self.versions() if before is None or x < before]
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(f"{self.path}/v{v[-1]}") if v else None

    def write(self, df: DataFrame, version: int, keep: int = 2, by: list[str] | None = None) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/v{version}")
        _, fs = self._fs()
        for old in self.versions()[:-keep]:
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{old}"), True)


def stream_history(stream: DataFrame, path: str, checkpoint: str, keys: list[str], attrs: list[str], time: str, available_now: bool = True, loaded: str | None = None) -> StreamingQuery:
    """Keeps a type-two dimension in a VersionedTable at `path` from a stream of updates (see history.merge_versions).

    The dimension forgets updates that changed nothing when they came, yet a later one between two of them brings them back.
    So all updates are kept beside it (`path`/updates), the one delivered last by `loaded` for each key and time (without
    `loaded`, that of the latest batch), and the keys of a batch are built anew from theirs: the result is that of all rows at
    once, in whatever order they come. A dimension without kept updates starts from its versions.

    Each micro-batch is merged as a whole; its version is the batch's number, so a batch that is run again after a failure
    writes the same versions from those before and nothing is merged twice.
    """

    def merge(batch: DataFrame, number: int) -> None:
        dimensions, kept = VersionedTable(batch.sparkSession, path), VersionedTable(batch.sparkSession, f"{path.rstrip('/')}/updates")
        dimension, updates = dimensions.read(number), kept.read(number)
        order = F.col(loaded) if loaded else F.lit(number).cast("long")
        new = batch.where(F.col(time).isNotNull()).select(*keys, time, *attrs, order.alias("_loaded"))
        if dimension is None:
            dimension = empty_dimension(batch, keys, attrs, time)
        if updates is None:
            updates = dimension.select(*keys, F.col("valid_from").alias(time), *attrs, F.lit(None).cast(new.schema["_loaded"].dataType).alias("_loaded"))
        held = latest(updates.unionByName(new), {k: F.col(k) for k in (*keys, time)}, {"_loaded": F.col("_loaded")} | {a: F.col(a) for a in attrs}, "_loaded")
        kept.write(held, number)
        touched = new.select(*[F.col(k).alias(f"_touched_{k}") for k in keys]).distinct()
        on = null_safe({k: F.col(k) for k in keys}, {k: F.col(f"_touched_{k}") for k in keys})
        again = kept.read(number + 1).join(touched, on, "left_semi")
        built = merge_versions(empty_dimension(batch, keys, attrs, time), again, keys, attrs, time)
        dimensions.write(dimension.join(touched, on, "left_anti").unionByName(built), number)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_outcomes(stream: DataFrame, time: str, kind: str, window: str = "1 day", late: str | None = None) -> DataFrame:
    """Rows per window of delivery time and kind. Every delivery counts, however late it is; with `late` (a time like `7 days`) windows that
    old are closed and their state is freed, and deliveries further behind the newest are left out."""
    return (stream.withWatermark(time, late) if late else stream).groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
