"""Queries of the llm problems (p3, p4, p6, p8, p9, p10) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import bpe, components, mixing, neardup, spans, splitting
from strata.session import stored

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    score = F.coalesce("verify_similarity", "ngram_overlap")
    links = table(spark, d, "clone_pairs").where(~F.isnan(score) & score.between(70, 100))
    return components.connected_components(links, "block_id_1", "block_id_2").select(F.col("node").alias("block_id"), F.col("component").alias("group_id"))


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    return spans.numbered(spans.distinct_sequences(table(spark, d, "code_blocks"), "token_hash", "token_sequence"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(_sequences(spark, d), "token_hash", "token_sequence")


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    records = _sequences(spark, d)
    return spans.shared_share(records, spans.shared_spans(records, "token_hash", "token_sequence"), "token_hash", "token_sequence")


def _near(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    blocks = spans.distinct_sequences(table(spark, d, "code_blocks"), "token_hash", "token_sequence")
    snippets = table(spark, d, "code_snippets").select(F.lpad(F.col("snippet_id").cast("string"), 12, "0").alias("snippet"), "code")
    return neardup.NearDuplicates([("block", blocks, "token_hash", "token_sequence", False), ("snippet", snippets, "snippet", "code", True)], 0.6)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).all_pairs()


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).groups()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(table(spark, d, "documents"), "doc_id", "text")


def p8_text(spark: SparkSession, d: str) -> DataFrame:
    """Every text encoded and decoded again; null texts come back empty."""
    return bpe.decode_column(p8_ids(spark, d), "doc_id", "ids")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.plan_mix(mixing.token_sizes(table(spark, d, "documents")), table(spark, d, "mix_targets")).where("short").select("source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    sizes = stored(mixing.token_sizes(table(spark, d, "documents")))
    return mixing.mix(sizes, mixing.plan_mix(sizes, table(spark, d, "mix_targets")))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_documents(table(spark, d, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_pieces(spark, d).where("piece = 0").select("doc_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p3_found, p4_found, p4_shares, p6_found, p6_groups, p8_ids, p8_text, p9_found, p9_mix, p9_report, p10_found, p10_pieces)}

_P4 = """
WITH records AS (SELECT token_hash, any_value(token_sequence) AS s FROM code_blocks WHERE token_hash IS NOT NULL AND token_sequence IS NOT NULL GROUP BY token_hash),
windows AS (SELECT token_hash, i - 1 AS pos, s[i:i + 39] AS w FROM (SELECT token_hash, s, unnest(range(1, len(s) - 38)) AS i FROM records WHERE len(s) >= 40)),
shared AS (SELECT w FROM windows GROUP BY w HAVING count(DISTINCT token_hash) > 1),
hits AS (SELECT token_hash, pos FROM windows SEMI JOIN shared USING (w)),
marked AS (SELECT *, CASE WHEN pos > lag(pos) OVER (PARTITION BY token_hash ORDER BY pos) + 40 OR lag(pos) OVER (PARTITION BY token_hash ORDER BY pos) IS NULL THEN 1 ELSE 0 END AS starts FROM hits),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY token_hash ORDER BY pos) AS k FROM marked),
spans AS (SELECT token_hash, CAST(min(pos) AS BIGINT) AS span_start, CAST(max(pos) + 39 AS BIGINT) AS span_end FROM numbered GROUP BY token_hash, k)
"""

_P6 = r"""
WITH records AS (SELECT token_hash AS id, any_value(token_sequence) AS s FROM code_blocks WHERE token_hash IS NOT NULL AND token_sequence IS NOT NULL GROUP BY token_hash),
snippets AS (SELECT lpad(CAST(snippet_id AS VARCHAR), 12, '0') AS id, regexp_extract_all(code, '[A-Za-z0-9_]+|[^\sA-Za-z0-9_]') AS s FROM code_snippets WHERE code IS NOT NULL),
grams AS (
  SELECT DISTINCT 'block' AS kind, id, CAST(s[i:i + 4] AS VARCHAR) AS g FROM (SELECT id, s, unnest(range(1, len(s) - 3)) AS i FROM records WHERE len(s) >= 5)
  UNION ALL SELECT DISTINCT 'snippet', id, array_to_string(s[i:i + 4], ' ') FROM (SELECT id, s, unnest(range(1, len(s) - 3)) AS i FROM snippets WHERE len(s) >= 5)
), sizes AS (SELECT kind, id, count(*) AS n FROM grams GROUP BY kind, id),
both_have AS (SELECT a.kind, a.id AS id_1, b.id AS id_2, count(*) AS k FROM grams a JOIN grams b ON a.kind = b.kind AND a.g = b.g AND a.id < b.id GROUP BY 1, 2, 3), alike AS (
SELECT p.kind, id_1, id_2 FROM both_have p JOIN sizes x ON x.kind = p.kind AND x.id = id_1 JOIN sizes y ON y.kind = p.kind AND y.id = id_2 WHERE 10 * k >= 6 * (x.n + y.n - k))
"""

ORACLES: dict[str, str] = {
    "p3_found": """
WITH RECURSIVE links AS (
  SELECT DISTINCT block_id_1 AS a, block_id_2 AS b FROM clone_pairs
  WHERE block_id_1 <> block_id_2 AND coalesce(verify_similarity, ngram_overlap) BETWEEN 70 AND 100
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS seen FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.seen = e.a)
SELECT node AS block_id, min(seen) AS group_id FROM reach GROUP BY node""",
    "p4_found": _P4 + "SELECT token_hash, span_start, span_end FROM spans",
    "p4_shares": _P4
    + """, sums AS (SELECT token_hash, sum(span_end - span_start + 1) AS n FROM spans GROUP BY token_hash)
SELECT token_hash, CAST(len(s) AS BIGINT) AS n_tokens, CAST(coalesce(n, 0) AS BIGINT) AS n_shared, CASE WHEN len(s) = 0 THEN 0.0 ELSE coalesce(n, 0) / CAST(len(s) AS DOUBLE) END AS share
FROM records LEFT JOIN sums USING (token_hash)""",
    "p6_found": _P6 + "SELECT * FROM alike",
    "p6_groups": _P6.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, sets AS (SELECT kind, id, CAST(list_sort(list(g)) AS VARCHAR) AS content FROM grams GROUP BY kind, id),
sized AS (SELECT kind, id, content, count(*) OVER (PARTITION BY kind, content) AS n_copies FROM sets),
edges AS (SELECT kind, id_1 AS a, id_2 AS b FROM alike UNION ALL SELECT kind, id_2, id_1 FROM alike),
reach AS (SELECT kind, a AS id, b AS seen FROM edges UNION SELECT r.kind, r.id, e.b FROM reach r JOIN edges e ON e.kind = r.kind AND e.a = r.seen),
links AS (SELECT e.kind, e.a AS id, count(DISTINCT y.content) FILTER (WHERE y.content <> x.content) AS n_links FROM edges e JOIN sized x ON x.kind = e.kind AND x.id = e.a JOIN sized y ON y.kind = e.kind AND y.id = e.b GROUP BY ALL)
SELECT r.kind, r.id, least(r.id, min(r.seen)) AS group_id, s.n_copies, l.n_links FROM reach r JOIN sized s ON s.kind = r.kind AND s.id = r.id JOIN links l ON l.kind = r.kind AND l.id = r.id GROUP BY r.kind, r.id, s.n_copies, l.n_links""",
    "p8_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
