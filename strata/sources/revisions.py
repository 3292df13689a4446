"""Revision directories: <root>/yyyyMMdd_HHmmss_<commit>/{code_blocks,clone_pairs}.csv."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.sequences import parse_tokens
from strata.operators import record_parser
from strata.operators.matching import rename_duplicates
from strata.schemas import CLONE_PAIRS_FILE, CLONE_PAIRS_FILE_OLD, CODE_BLOCKS_FILE, CODE_BLOCKS_FILE_OLD
from strata.session import discard, found, rename, shared_folder, stored

NAME = r"^(\d{8}_\d{6})_([0-9A-Za-z]+)$"
FILES = ("code_blocks.csv", "clone_pairs.csv")
_SCHEMA = "revision_dir string, revision_id timestamp_ntz, commit_hash string, path string, has_files boolean"


def revision_time(name: Column) -> Column:
    """The time a directory's name begins with; null for names of another form or impossible times."""
    digits = F.regexp_extract(name, NAME, 1)
    return F.when(digits != "", F.try_to_timestamp(digits, F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz"))


def list_revisions(spark: SparkSession, root: str) -> DataFrame:
    """(revision_dir, revision_id, commit_hash, path, has_files) of the directories in `root`; none for a missing root.

    A listing of names: its size is the number of revisions, whatever is in them.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    if fs.exists(at):
        for s in fs.listStatus(at):
            if s.isDirectory():
                p = s.getPath()
                rows.append((p.getName(), p.toString(), all(fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, f)) for f in FILES)))
    df = spark.createDataFrame(rows, T.StructType([T.StructField("revision_dir", T.StringType()), T.StructField("path", T.StringType()), T.StructField("has_files", T.BooleanType())]))
    return df.select("revision_dir", revision_time(F.col("revision_dir")).alias("revision_id"), F.nullif(F.regexp_extract("revision_dir", NAME, 2), F.lit("")).alias("commit_hash"), "path", "has_files")


def usable_revisions(revisions: DataFrame, strict: bool = False, start: str | None = None, end: str | None = None, first: int | None = None) -> DataFrame:
    """Revisions with a time and both files, from `start` to `end` (both included), the `first` of them if asked. Strict: any other is an error."""
    good = F.col("revision_id").isNotNull() & F.col("has_files")
    if strict and (bad := revisions.where(~good).select("revision_dir").collect()):
        raise ValueError("unusable revisions: " + ", ".join(sorted(r[0] for r in bad)))
    kept = revisions.where(good)
    if start is not None:
        kept = kept.where(F.col("revision_id") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        kept = kept.where(F.col("revision_id") <= F.lit(end).cast("timestamp_ntz"))
    return kept if first is None else kept.orderBy("revision_id", "revision_dir").limit(first)


def _revision_dir(path: Column, file: str) -> Column:
    return F.regexp_extract(path, rf"([^/]+)/{re.escape(file)}(?:/[^/]*)?$", 1)


def _read(spark: SparkSession, root: str, file: str, schema: T.StructType) -> DataFrame:
    raw = spark.read.schema(schema).option("escape", '"').option("multiLine", "true").csv(f"{root}/*/{file}")
    return raw.select(_revision_dir(F.col("_metadata.file_path"), file).alias("revision_dir"), "*").withColumn("revision_id", revision_time(F.col("revision_dir"))).where("revision_id is not null")


def read_records(spark: SparkSession, root: str, file: str = FILES[0]) -> DataFrame:
    """(revision_dir, file_path, at, line): the records of all revisions' files, `at` giving their order within a file.

    Files are read by lines, in splits of any size. Only a file in which a line has an odd number of quotes may hold a record of
    several lines: such files (their names are what reaches the driver, one for each at most) are read as a whole, and their records end at
    line ends at which the number of quotes before is even. Empty lines are no records.
    """
    pattern = f"{root}/*/{file}"
    if not found(spark, pattern):
        return spark.createDataFrame([], "revision_dir string, file_path string, at struct<start: long, n: long>, line string")
    # Within a split rows are numbered in order, and splits of a file by where they start.
    at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("file_path"), at.alias("at"), F.col("value").alias("line"))
    odd = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    folded = [r[0] for r in lines.where(odd % 2 == 1).select("file_path").distinct().collect()]
    plain = lines.where(~F.col("file_path").isin(folded)) if folded else lines
    if folded:

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                    outside = np.cumsum(raw == 34) % 2 == 0
                    ends = np.flatnonzero(outside & ((raw == 10) | (raw == 13)))
                    first, past = np.concatenate([[0], ends + 1]), np.concatenate([ends, [len(raw)]])
                    some = np.flatnonzero(past > first)
                    records = [raw[first[i] : past[i]].tobytes().decode("utf-8", "surrogatepass") for i in some]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(some), pa.string()), pa.array(first[some].astype(np.int64)), pa.array(records, pa.string())], names=["file_path", "n", "line"])

        whole = spark.read.text([unquote(x) for x in folded], wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value").mapInArrow(split, "file_path string, n long, line string")
        plain = plain.unionByName(whole.select("file_path", F.struct(F.lit(0).cast("long").alias("start"), "n").alias("at"), "line"))
    return plain.where("line <> ''").select(_revision_dir(F.col("file_path"), file).alias("revision_dir"), "file_path", "at", "line")


def read_code_blocks(spark: SparkSession, root: str, old: bool = False) -> DataFrame:
    """All revisions' code blocks in one frame, with revision_dir, revision_id and parsed token sequences; an empty field is null.

    As they are: no record is checked or left out, and what can't be read is null (load_code_blocks checks).
    """
    df = _read(spark, root, FILES[0], CODE_BLOCKS_FILE_OLD if old else CODE_BLOCKS_FILE)
    return df.withColumn("token_sequence", parse_tokens("token_sequence"))


def load_code_blocks(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, rejects) of all usable revision directories: the well-formed records as typed rows, methods that share a signature in a
    revision numbered in the order of their file, and the others as (revision_dir, reason, line)."""
    records = read_records(spark, root)
    usable = usable_revisions(list_revisions(spark, root)).select("revision_dir", "revision_id")
    parsed = stored(record_parser.parse_records(records.join(usable, "revision_dir").withColumn("record", F.col("line")), "line", ["revision_dir", "revision_id", "at", "record"]))
    typed = record_parser.typed_code_blocks(parsed, ["revision_dir", "revision_id", "at"])
    blocks = rename_duplicates(typed, "revision_dir", ["at"]).drop("at")
    return blocks, parsed.where("reason is not null").select("revision_dir", "reason", F.col("record").alias("line"))


def read_clone_pairs(spark: SparkSession, root: str, old: bool = False, empty_texts: bool = False) -> DataFrame:
    """All revisions' clone pairs in one frame; an empty file has no rows. An empty field is null, a quoted one as well unless `empty_texts`."""
    schema = CLONE_PAIRS_FILE_OLD if old else CLONE_PAIRS_FILE
    options = {"escape": '"'} | ({"nullValue": "\0"} if empty_texts else {})
    rows = read_records(spark, root, FILES[1]).select("revision_dir", F.from_csv("line", schema.toDDL(), options).alias("row"))
    return rows.select("revision_dir", "row.*", revision_time(F.col("revision_dir")).alias("revision_id")).where("revision_id is not null")


def write_stage(df: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None, order: list[str] | None = None) -> None:
    """A stage's result: parquet (partitioned if asked), csv with a header, or json; in order, nulls last, if asked."""
    if order:
        df = df.orderBy(*[F.col(c).asc_nulls_last() for c in order])
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    {"parquet": writer.parquet, "csv": lambda p: writer.option("header", "true").option("escape", '"').csv(p), "json": writer.json}[form](path)


def write_revisions(records: DataFrame, pairs: DataFrame, root: str) -> None:
    """Writes revision directories: `records` (revision_dir, n, line) and `pairs` (revision_dir, line), a file (or folder of parts) for each.

    Rows without a directory go nowhere; names that can't be a directory's, which are no revision's either, are written as Spark escapes them.
    """
    spark = records.sparkSession
    for df, file in ((records.repartition("revision_dir").sortWithinPartitions("revision_dir", "n").select("revision_dir", "line"), FILES[0]), (pairs, FILES[1])):
        made = f"{shared_folder(spark)}/{file}-{uuid.uuid4().hex}"
        df.where("revision_dir is not null").write.partitionBy("revision_dir").text(made)
        for at in found(spark, f"{made}/revision_dir=*"):
            rename(spark, at, f"{root}/{at.rsplit('/revision_dir=', 1)[1]}/{file}")
        discard(spark, made)


def read_stage(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet") -> DataFrame:
    """A stage's result with the columns and types of `schema`; others aren't read."""
    reader = spark.read.schema(schema)
    return {"parquet": reader.parquet, "csv": reader.option("header", "true").option("enforceSchema", "false").option("escape", '"').csv, "json": reader.json}[form](path)
