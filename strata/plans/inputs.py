"""The cleaned inputs of the analysis: the delivery that holds of each row, white space squeezed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.text import squeeze
from strata.operators.deliveries import latest

TRACKED_TEXTS = ("prev_file_path", "prev_method_name", "prev_return_type", "prev_parameters", "curr_file_path", "curr_method_name", "curr_return_type", "curr_parameters")
TRACKED_OTHERS = ("prev_token_hash", "curr_revision_id", "similarity", "is_sim_matched", "is_sim_deleted", "is_sim_added", "is_sig_matched", "is_sig_deleted", "is_sig_added", "is_matched", "is_deleted", "is_added", "is_absorbed", "is_absorber")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, d: str, tokens: bool = False) -> DataFrame:
    """One row per (revision, file, method); token sequences only where they are needed."""
    others = ["block_id", "start_line", "end_line", "token_hash"] + ["token_sequence"] * tokens
    keys = {"revision_id": F.col("revision_id"), "file_path": squeeze("file_path"), "method_name": squeeze("method_name")}
    return latest(table(spark, d, "code_blocks").where("revision_id is not null"), keys, {"return_type": squeeze("return_type"), "parameters": squeeze("parameters"), **{c: F.col(c) for c in others}})


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Clone pairs by token hash within a revision."""
    held = latest(table(spark, d, "clone_pairs"), {"pair_id": F.col("pair_id")}, {c: F.col(c) for c in ("revision_id", "block_id_1", "block_id_2", "ngram_overlap", "verify_similarity")})
    names = latest(table(spark, d, "code_blocks"), {"revision_id": F.col("revision_id"), "block_id": F.col("block_id")}, {"token_hash": F.col("token_hash")})
    for i in (1, 2):
        held = held.join(names.select("revision_id", F.col("block_id").alias(f"block_id_{i}"), F.col("token_hash").alias(f"token_hash_{i}")), ["revision_id", f"block_id_{i}"])
    return held.select("pair_id", "revision_id", "block_id_1", "block_id_2", "token_hash_1", "token_hash_2", "ngram_overlap", "verify_similarity")


def tracked(spark: SparkSession, d: str) -> DataFrame:
    """One row per method and step, added ones with a null prev_revision_id."""
    rows = table(spark, d, "methods_tracked").where("method_id is not null")
    return latest(rows, {"method_id": F.col("method_id"), "prev_revision_id": F.col("prev_revision_id")}, {**{c: squeeze(c) for c in TRACKED_TEXTS}, **{c: F.col(c) for c in TRACKED_OTHERS}})


def _sq(c: str) -> str:
    return rf"nullif(trim(regexp_replace({c}, '[ \t\r\n]+', ' ', 'g')), '')"


BLOCKS_SQL = f"""blocks AS (SELECT * EXCLUDE (k) FROM (
  SELECT revision_id, {", ".join(f"{_sq(c)} AS {c}" for c in ("file_path", "method_name", "return_type", "parameters"))}, block_id, start_line, end_line, token_hash, token_sequence,
    row_number() OVER (PARTITION BY revision_id, {_sq("file_path")}, {_sq("method_name")} ORDER BY loaded_at DESC) AS k FROM code_blocks WHERE revision_id IS NOT NULL) WHERE k = 1),
steps AS (SELECT revision_id, lead(revision_id) OVER (ORDER BY revision_id) AS r1, lead(revision_id, 2) OVER (ORDER BY revision_id) AS r2 FROM (SELECT DISTINCT revision_id FROM blocks))"""
PAIRS_SQL = """held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY loaded_at DESC) AS k FROM clone_pairs) WHERE k = 1),
names AS (SELECT * FROM (SELECT revision_id, block_id, token_hash, row_number() OVER (PARTITION BY revision_id, block_id ORDER BY loaded_at DESC) AS k FROM code_blocks) WHERE k = 1),
pairs AS (SELECT h.revision_id, h.block_id_1, h.block_id_2, a.token_hash AS token_hash_1, b.token_hash AS token_hash_2, h.ngram_overlap, h.verify_similarity FROM held h
  JOIN names a ON a.revision_id = h.revision_id AND a.block_id = h.block_id_1 JOIN names b ON b.revision_id = h.revision_id AND b.block_id = h.block_id_2)"""
TRACKED_SQL = f"""tracked AS (SELECT * EXCLUDE (k) FROM (
  SELECT method_id, prev_revision_id, {", ".join(f"{_sq(c)} AS {c}" for c in TRACKED_TEXTS)}, {", ".join(TRACKED_OTHERS)},
    row_number() OVER (PARTITION BY method_id, prev_revision_id ORDER BY loaded_at DESC) AS k FROM methods_tracked WHERE method_id IS NOT NULL) WHERE k = 1)"""
MEDIANS_SQL = (
    PAIRS_SQL
    + """,
scored AS (SELECT *, coalesce(verify_similarity, ngram_overlap) AS s FROM pairs),
sides AS (SELECT revision_id, token_hash_1 AS token_hash, median(s) AS m FROM scored WHERE s IS NOT NULL AND NOT isnan(s) GROUP BY ALL
  UNION ALL SELECT revision_id, token_hash_2, median(s) FROM scored WHERE s IS NOT NULL AND NOT isnan(s) GROUP BY ALL),
medians AS (SELECT revision_id, token_hash, round_even(median(m), 1) AS median_similarity FROM sides GROUP BY ALL),
members AS (SELECT DISTINCT revision_id, unnest([token_hash_1, token_hash_2]) AS token_hash FROM pairs)"""
)
ENRICHED_SQL = (
    TRACKED_SQL
    + ", "
    + MEDIANS_SQL
    + """,
enriched AS (SELECT t.*, m.median_similarity, c.token_hash IS NOT NULL AS has_clone FROM tracked t
  LEFT JOIN medians m ON m.revision_id = t.prev_revision_id AND m.token_hash = t.prev_token_hash
  LEFT JOIN members c ON c.revision_id = t.prev_revision_id AND c.token_hash = t.prev_token_hash)"""
)
