"""Command line: python -m strata list | run QUERY --data DIR [--out PATH] | ingest ROOT --out DIR | rules FILE --data DIR --out PATH | deleted-files REPOSITORY --out PATH."""

from __future__ import annotations

import argparse
from importlib import import_module

from pyspark.sql import SparkSession

from strata.operators import audits, rules
from strata.plans import core, reference
from strata.session import released, stored
from strata.sources import revisions
from strata.sources.config import Config

#: What the commands of the original analysis are called here.
COMMANDS = {
    "nil track-sim": "similarity_match",
    "nil track-sig": "signature_match",
    "nil track-sim-sig": "combined_match",
    "nil track-median-similarity": "median_similarity",
    "nil evaluate": "audit_documents",
    "nil track-merge-splits": "merge_splits",
    "nil track-clone": "tracked_with_clones",
    "nil classify-clone": "clone_groups",
    "nil track-deletion-status": "deletion_status",
    "nil class-delete": "rates_by_clone",
    "nil class-high-low-sim": "rates_by_similarity",
    "nil sim-count": "similarity_counts",
    "nil count-classified": "count_classified",
    "method-tracker assign-method-ids": "method_ids",
    "survival deletion-survival": "deletion_survival",
    "survival analyze-absorbed": "absorbed_cohorts",
    "test-analysis deleted-rate": "wilcoxon_by_clone",
    "test-analysis deleted-high-low": "wilcoxon_by_similarity",
    "test-analysis plot-deleted-rate": "rate_series",
    "test-analysis plot-high-low-sim": "similarity_rate_series",
    "git classify-is-deleted": "file_deletions",
}


def all_queries() -> dict:
    return core.QUERIES | reference.QUERIES


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strata")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    run = sub.add_parser("run", help="runs a query over a folder of tables")
    run.add_argument("query", help="a query, or a command of the original analysis")
    run.add_argument("--data", required=True)
    run.add_argument("--out")
    run.add_argument("--config", help="a file of settings; else the usual places")
    run.add_argument("--format", choices=["parquet", "csv", "json"], default="parquet")
    ingest = sub.add_parser("ingest", help="reads revision directories into tables partitioned by revision")
    ingest.add_argument("root")
    ingest.add_argument("--out", required=True)
    rule = sub.add_parser("rules", help="applies rules to the code snippets of a folder of tables")
    rule.add_argument("file", help="a YAML file, or `default`")
    rule.add_argument("--only", help="names, separated by commas")
    rule.add_argument("--data", required=True)
    rule.add_argument("--out", required=True)
    rule.add_argument("--format", choices=["parquet", "csv", "json"], default="parquet")
    git = sub.add_parser("deleted-files", help="files deleted in a git repository")
    git.add_argument("repository")
    git.add_argument("--out", required=True)
    a = parser.parse_args(args)
    if a.command == "list":
        print("\n".join(sorted(all_queries())))
        return 0
    spark = SparkSession.builder.appName("strata").getOrCreate()
    if a.command == "run":
        name = COMMANDS.get(a.query, a.query)
        if name not in all_queries():
            parser.error(f"no query {a.query!r}")
        reference.configure(Config.load(a.config))
        with released(spark):
            df = all_queries()[name](spark, a.data)
            if a.out:
                revisions.write_stage(df, a.out, a.format)
            else:
                df.show(50, truncate=60)
    elif a.command == "ingest":
        with released(spark):
            blocks, rejects = revisions.load_code_blocks(spark, a.root)
            blocks = stored(blocks)
            pairs = stored(revisions.read_clone_pairs(spark, a.root))
            revisions.write_stage(blocks, f"{a.out}/code_blocks", by=["revision_dir"])
            revisions.write_stage(pairs, f"{a.out}/clone_pairs", by=["revision_dir"])
            revisions.write_stage(rejects, f"{a.out}/rejects")
            # Warnings, not errors: a row per rule.
            report = audits.validate_blocks(blocks).unionByName(audits.validate_pairs(pairs, "token_hash_1", "token_hash_2"))
            revisions.write_stage(report, f"{a.out}/violations", "csv")
    elif a.command == "rules":
        chosen = rules.select_rules(rules.make_rules() if a.file == "default" else rules.load_rules(a.file), a.only)
        revisions.write_stage(rules.apply_rules(spark.read.parquet(f"{a.data}/code_snippets.parquet"), chosen).drop("code"), a.out, a.format)
    else:
        revisions.write_stage(import_module("strata.sources.repository").read_deleted_files(spark, a.repository), a.out, "csv")
    return 0
