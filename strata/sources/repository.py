"""Version control as a source: deleted files and release tags of a git repository."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strata.functions.code import strip


#: Commits read by one task.
COMMITS_PER_TASK = 2000


class _Commits(InputPartition):
    """A range of the log, counted from the latest commit."""

    def __init__(self, skip: int):
        super().__init__(skip)
        self.skip = skip


class _DeletedFilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.git = options["path"], options.get("git", "git")

    def _run(self, *args: str, given: bytes | None = None) -> bytes:
        return subprocess.run([self.git, "-C", self.path, *args], input=given, capture_output=True, check=True).stdout

    def partitions(self):
        return [_Commits(i) for i in range(0, int(self._run("rev-list", "--count", "HEAD")), COMMITS_PER_TASK)]

    def read(self, partition):
        # By name: log itself would count only the commits that it shows.
        commits = self._run("rev-list", f"--skip={partition.skip}", f"--max-count={COMMITS_PER_TASK}", "HEAD")
        out = self._run("log", "--no-walk=unsorted", "--stdin", "-z", "--diff-filter=D", "--no-renames", "--name-only", "--format=%x01%H%x02%cI%x02%B%x02", given=commits).decode("utf-8", "replace")
        for commit in out.split("\x01")[1:]:
            head, when, message, files = commit.split("\x02", 3)
            for f in filter(None, (x.strip("\n") for x in files.split("\0"))):
                yield head[:7], when, f, message.strip()


class DeletedFiles(DataSource):
    """spark.read.format("git_deleted_files").option("path", repository): (commit_hash, revision_id, file_path, commit_message)."""

    @classmethod
    def name(cls) -> str:
        return "git_deleted_files"

    def schema(self) -> str:
        return "commit_hash string, revision_id string, file_path string, commit_message string"

    def reader(self, schema) -> DataSourceReader:
        return _DeletedFilesReader(self.options)


def read_deleted_files(spark: SparkSession, path: str) -> DataFrame:
    """The files deleted by each commit of a repository."""
    spark.dataSource.register(DeletedFiles)
    return spark.read.format("git_deleted_files").option("path", path).load()


def deleted_files(changes: DataFrame) -> DataFrame:
    """The same from an extracted table (commit_hash, committed_at, change_type, old_path, message)."""
    return changes.where("change_type = 'DELETE'").select(F.substring("commit_hash", 1, 7).alias("commit_hash"), F.col("committed_at").alias("revision_id"), F.col("old_path").alias("file_path"), strip(F.col("message")).alias("commit_message"))


def release_parts(tag: Column) -> Column:
    """[major, minor, patch] of a tag like v1.2.0, to sort by; null for another form."""
    number = lambda i: F.regexp_extract(tag, r"^v(\d+)\.(\d+)\.(\d+)$", i).cast("int")
    return F.when(tag.rlike(r"^v\d+\.\d+\.\d+$"), F.array(number(1), number(2), number(3)))


def release_steps(tags: DataFrame, tag: str = "tag") -> DataFrame:
    """(tag, next_tag) of the releases whose patch number is 0, in numeric order. One row per release."""
    from pyspark.sql import Window

    v = release_parts(F.col(tag))
    kept = tags.where(v.isNotNull() & (F.element_at(v, 3) == 0)).select(F.col(tag).alias("tag"), v.alias("_v")).distinct()
    return kept.select("tag", F.lead("tag").over(Window.orderBy("_v")).alias("next_tag"))
