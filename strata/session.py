"""Session helpers: a local session for tests, and written intermediate tables that survive lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, SparkSession] = {}
_SCOPES: list[list[str]] = []


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strata")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a temporary folder is made, but only on a local master: on a cluster no machine-local
    folder is visible to all executors, so this raises instead.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = at.get() if at.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="strata-")
        spark.sparkContext.setCheckpointDir(named)
    folder = f"{named.rstrip('/')}/strata-{spark.sparkContext.applicationId}"
    if folder not in _MADE:
        _MADE[folder] = spark
        atexit.register(_remove, folder)
    return folder


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _remove(path: str) -> None:
    try:
        discard(_MADE[path], path)
    except Exception:  # the session has ended already
        if path.startswith("file://"):
            import shutil

            shutil.rmtree(path[7:], ignore_errors=True)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that nothing will read again."""
    at = _path(spark, path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def found(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match `pattern`."""
    at = _path(spark, pattern)
    return [s.getPath().toString() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []]


def rename(spark: SparkSession, path: str, new: str) -> None:
    at, to = _path(spark, path), _path(spark, new)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(to.getParent())
    if not fs.rename(at, to):
        raise OSError(f"can't rename {path} to {new}")


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the intermediate tables written within: what was made of them must have been read or written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            discard(spark, path)


class Stored:
    """An intermediate table: `df` reads it, `drop` deletes it. Lineage is cut, so a lost executor costs no recomputation."""

    def __init__(self, df: DataFrame, by: list[str] | None = None):
        self.spark = df.sparkSession
        self.path = os.path.join(shared_folder(self.spark), uuid.uuid4().hex)
        df.write.parquet(self.path, compression="zstd")
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        if _SCOPES:
            _SCOPES[-1].append(self.path)

    def drop(self) -> None:
        discard(self.spark, self.path)


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again."""
    return Stored(df).df
