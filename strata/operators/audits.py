"""Validation of inputs, audits of matches, and counts of classified rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.schemas import SIGNATURE


def _require(df: DataFrame, columns: list[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def _violations(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    one = df.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in tests.items()])
    return one.unpivot([], one.columns, "rule", "n_violations")


def validate_blocks(blocks: DataFrame) -> DataFrame:
    """(rule, n_violations) of code blocks: repeated signatures in a revision, nulls in needed columns, impossible lines. One pass
    for the latter and one aggregation for the former; an empty table has no violations."""
    _require(blocks, ["revision_id", "token_hash", "start_line", "end_line", *SIGNATURE])
    needed = ["token_hash", "file_path", "start_line", "end_line", "method_name"]
    tests = {f"null_{c}": F.count_if(F.col(c).isNull()) for c in needed}
    tests |= {"start_after_end": F.count_if(F.col("start_line") > F.col("end_line")), "line_not_positive": F.count_if((F.col("start_line") <= 0) | (F.col("end_line") <= 0))}
    same = blocks.groupBy("revision_id", *SIGNATURE).agg((F.count("*") - 1).alias("_n")).where("_n > 0").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("duplicate_signature"))
    return _violations(blocks, tests).unionByName(same.unpivot([], same.columns, "rule", "n_violations"))


def validate_pairs(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """(rule, n_violations) of clone pairs: null ends, self-pairs, overlaps outside 0 to 100 or NaN."""
    _require(pairs, [first, second, "ngram_overlap", "verify_similarity"])
    o = F.col("ngram_overlap")
    return _violations(pairs, {f"null_{first}": F.count_if(F.col(first).isNull()), f"null_{second}": F.count_if(F.col(second).isNull()), "self_pair": F.count_if(F.col(first) == F.col(second)), "overlap_out_of_range": F.count_if((o < 0) | (o > 100) | F.isnan(o))})


def require_valid(report: DataFrame) -> None:
    """Raises with all violations of a report (a row per rule)."""
    if bad := report.where("n_violations > 0").collect():
        raise ValueError("; ".join(f"{r['rule']}: {r['n_violations']}" for r in bad))


def merge_splits(tracked: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Adds prev_loc, curr_loc and, for matched rows, is_split (shorter than `threshold` of before), is_merged (longer than before /
    `threshold`), is_modified (neither). Needs prev/curr_start_line and end_line."""
    prev, curr = F.col("prev_end_line") - F.col("prev_start_line") + 1, F.col("curr_end_line") - F.col("curr_start_line") + 1
    split, merged = prev * threshold > curr, prev < curr * threshold
    m = F.col("is_matched")
    false = F.lit(False)
    return tracked.withColumns({"prev_loc": prev, "curr_loc": curr, "is_split": F.coalesce(m & split, false), "is_merged": F.coalesce(m & merged, false), "is_modified": F.coalesce(m & ~split & ~merged, false)})


def count_classified(rows: DataFrame) -> DataFrame:
    """(label, has_clone, n): rows by what became of them, each label by its own test rather than its place."""
    label = F.when(F.col("is_deleted"), "deleted").when(F.col("is_added"), "added").when(F.col("is_split"), "split").when(F.col("is_merged"), "merged").when(F.col("is_modified"), "modified").when(F.col("is_matched"), "matched").otherwise("other")
    return rows.groupBy(label.alias("label"), "has_clone").agg(F.count("*").alias("n"))


def audit_triples(tracked: DataFrame, steps: DataFrame, key: str) -> DataFrame:
    """False positives over three revisions: (kind, revision_id, row, matched).

    For rows of step k: `deleted` with the rows of step k+1 whose method before is theirs; `matched` with the rows of step k+1
    whose method after is theirs before; `added` rows of step k+1 with the rows of step k that start from what
    they added. By file and method name; `matched` is the ordered list of the others' keys (empty if none). All triples are joined at once on the
    revision; a list is as long as methods share a name in a file and revision.
    """
    after = steps.where("after_next_revision_id is not null").select(F.col("revision_id").alias("r0"), F.col("next_revision_id").alias("r1"))
    k0 = tracked.join(after, F.col("prev_revision_id") == F.col("r0"))
    one = tracked.where("is_matched and prev_revision_id is not null").select(F.col(key).alias("other"), F.col("prev_revision_id").alias("o_prev_r"), F.col("prev_file_path").alias("pf"), F.col("prev_method_name").alias("pm"), F.col("curr_file_path").alias("cf"), F.col("curr_method_name").alias("cm"))
    listed = F.array_sort(F.array_compact(F.collect_list("other"))).alias("matched")
    out = []
    d = k0.where("is_deleted").join(one, (F.col("r1") == F.col("o_prev_r")) & (F.col("prev_file_path") == F.col("pf")) & (F.col("prev_method_name") == F.col("pm")), "left")
    out.append(d.groupBy(F.lit("deleted").alias("kind"), F.col("r0").alias("revision_id"), F.col(key).alias("row")).agg(listed))
    m = k0.where("is_matched").join(one, (F.col("r1") == F.col("o_prev_r")) & (F.col("prev_file_path") == F.col("cf")) & (F.col("prev_method_name") == F.col("cm")), "left")
    out.append(m.groupBy(F.lit("matched").alias("kind"), F.col("r0").alias("revision_id"), F.col(key).alias("row")).agg(listed))
    nexts = steps.where("next_revision_id is not null").select(F.col("revision_id").alias("r0"), F.col("next_revision_id").alias("r1"))
    new = tracked.where("is_added").join(nexts, F.col("curr_revision_id") == F.col("r1")).select(F.col(key).alias("row"), "r0", F.col("curr_file_path").alias("f"), F.col("curr_method_name").alias("m"))
    a = new.join(one, (F.col("r0") == F.col("o_prev_r")) & (F.col("f") == F.col("pf")) & (F.col("m") == F.col("pm")), "left")
    out.append(a.groupBy(F.lit("added").alias("kind"), F.col("r0").alias("revision_id"), "row").agg(listed))
    return out[0].unionByName(out[1]).unionByName(out[2])


def audit_json(audit: DataFrame) -> DataFrame:
    """(kind, revision_id, row, document): each row's part of the audit's JSON object, from the row to the rows it matched.

    A line of JSON for each row rather than one object for each revision, which would be as long as its methods; write it with
    revisions.write_stage(..., "json", by=["kind", "revision_id"]).
    """
    return audit.select("kind", "revision_id", "row", F.to_json(F.create_map(F.col("row").cast("string"), F.struct("matched"))).alias("document"))


def file_deletions(tracked: DataFrame, deleted_files: DataFrame, prefix: str = "") -> DataFrame:
    """Deleted methods with is_test_method, is_private and is_file_deleted (their file, without `prefix`, is among the deleted files)."""
    files = deleted_files.select(F.col("file_path").alias("_f")).where("_f is not null").distinct()
    path = F.replace(F.col("prev_file_path"), F.lit(prefix), F.lit("")) if prefix else F.col("prev_file_path")
    rows = tracked.where("is_deleted").withColumn("_path", path)
    return rows.join(files, F.col("_path") == F.col("_f"), "left").withColumns({"is_test_method": F.coalesce(path.contains("test_") | path.contains("_test"), F.lit(False)), "is_private": F.coalesce(F.col("prev_method_name").contains("_"), F.lit(False)), "is_file_deleted": F.col("_f").isNotNull()}).drop("_f", "_path")


def file_deletion_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("is_test_method", "is_private", "has_clone", "is_file_deleted").agg(F.count("*").alias("n"))


def deleted_file_ratio(rows: DataFrame, among: str) -> DataFrame:
    """(n, n_file_deleted, ratio) of the rows where `among` holds."""
    kept = rows.where(F.col(among))
    return kept.agg(F.count("*").alias("n"), F.count_if("is_file_deleted").alias("n_file_deleted")).withColumn("ratio", F.try_divide(F.col("n_file_deleted").cast("double"), F.col("n").cast("double")))


def method_states(tracked: DataFrame) -> DataFrame:
    """Adds `state` of each row: deleted or survived or added, alone or with clones, changed or not. Needs has_clone and both sides' hashes."""
    changed = ~F.col("prev_token_hash").eqNullSafe(F.col("curr_token_hash"))
    clone = F.col("has_clone")
    state = (
        F.when(F.col("is_deleted"), F.when(clone, "deleted_from_group").otherwise("deleted_isolated"))
        .when(F.col("is_added"), F.when(clone, "added_to_group").otherwise("added_isolated"))
        .when(clone, F.when(changed, "survived_clone_modified").otherwise("survived_clone_unchanged"))
        .otherwise(F.when(changed, "survived_modified").otherwise("survived_unchanged"))
    )
    return tracked.withColumn("state", state)


def ground_truth(snippets: DataFrame, revisions: DataFrame, blocks: DataFrame) -> DataFrame:
    """The snippets whose block is in their own revision, beside it: joined on revision and block id (a block of another revision is none)."""
    times = revisions.where("revision_id is not null").select(F.col("revision_dir").alias("revision"), "revision_id").distinct()
    held = blocks.select("revision_id", F.col("block_id").cast("string").alias("global_block_id"), "method_name", "token_hash")
    return snippets.join(times, "revision").join(held, ["revision_id", "global_block_id"])
