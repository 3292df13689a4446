"""Queries of the analysis: matching, lineage, clones, rates, survival, significance, rules, audits."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.code import strip
from strata.functions.text import stamp
from strata.operators import audits, clones, lineage, matching, patterns, rates, rules, significance, survival
from strata.plans import matching_sql, reference_sql
from strata.plans.core import p1_rows
from strata.plans.inputs import blocks, pairs, table, tracked
from strata.session import shared_folder, stored
from strata.sources import pivot, reports, revisions
from strata.sources.config import Config

ORACLES: dict[str, str] = reference_sql.ORACLES | matching_sql.ORACLES
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


#: What the matching queries go by; the command line replaces it by a file's.
SETTINGS = Config()


def configure(settings: Config) -> None:
    global SETTINGS
    SETTINGS = settings


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# Revisions, blocks, validation


@query
def revision_steps(spark, d):
    usable = table(spark, d, "revisions").where("has_files and revision_id is not null")
    return matching.revision_steps(usable)


@query
def renamed_duplicates(spark, d):
    rows = p1_rows(spark, d)
    return matching.rename_duplicates(rows, "revision_dir", ["line_no", "raw_id"]).select("raw_id", "method_name")


@query
def validate_blocks(spark, d):
    return audits.validate_blocks(table(spark, d, "code_blocks"))


@query
def validate_pairs(spark, d):
    return audits.validate_pairs(table(spark, d, "clone_pairs"), "block_id_1", "block_id_2")


# Matching


@query
def signature_match(spark, d):
    return matching.signature_match(blocks(spark, d)).drop("next_revision_id")


@query
def signature_counts(spark, d):
    return matching.signature_counts(matching.signature_match(blocks(spark, d)))


@query
def signature_check(spark, d):
    b = blocks(spark, d)
    return matching.signature_check(matching.signature_match(b), b)


@query
def similarity_candidates(spark, d):
    return matching.similarity_candidates(stored(matching.sequence_steps(blocks(spark, d, tokens=True))))


@query
def similar_sequences(spark, d):
    return _similar(blocks(spark, d, tokens=True))


@query
def similar_sequences_by_lsh(spark, d):
    return _similar(blocks(spark, d, tokens=True), approximate=True)


def _similar(b, approximate=False):
    m = SETTINGS.matching
    return matching.similar_sequences(b, m.ngram_size, m.overlap, m.similarity, approximate, m.top_k)


def _matches(spark, d, prefer=None):
    prefer = SETTINGS.matching.prefer_signature_target if prefer is None else prefer
    b = stored(blocks(spark, d, tokens=True))
    similar = stored(_similar(b))
    return b, similar, matching.combined_match(matching.signature_match(b), matching.similarity_match(b, similar), similar, prefer)


@query
def similarity_match(spark, d):
    b = stored(blocks(spark, d, tokens=True))
    return matching.similarity_match(b, stored(_similar(b)))


@query
def combined_match(spark, d):
    return _matches(spark, d)[2]


@query
def combined_match_most_similar(spark, d):
    return _matches(spark, d, prefer=False)[2]


@query
def added_methods(spark, d):
    b, _, m = _matches(spark, d)
    return matching.added_methods(b, stored(m))


@query
def progressive_match(spark, d):
    return matching.progressive_match(stored(blocks(spark, d, tokens=True)), [0.9, 0.8, 0.7])


# Lineage


@query
def method_ids(spark, d):
    return lineage.assign_ids(_matches(spark, d)[2])


@query
def method_ids_in_order(spark, d):
    return lineage.assign_ids_in_order(_matches(spark, d, prefer=False)[2])


@query
def lineage_summary(spark, d):
    """Chains of the tracked steps: how many have each number of rows, first and last revision and absorptions."""
    rows = tracked(spark, d).drop("method_id", "is_absorbed", "is_absorber")
    ids = lineage.assign_ids(rows)
    chains = ids.groupBy("method_id").agg(F.count("*").alias("n_rows"), F.min("prev_revision_id").alias("first_revision"), F.max("prev_revision_id").alias("last_revision"), F.count_if("is_absorbed").alias("n_absorbed"), F.count_if("is_absorber").alias("n_absorber"))
    return chains.groupBy("n_rows", "first_revision", "last_revision", "n_absorbed", "n_absorber").agg(F.count("*").alias("n_chains"))


@query
def id_statistics(spark, d):
    return lineage.id_statistics(tracked(spark, d))


@query
def lifetimes(spark, d):
    return lineage.lifetimes(tracked(spark, d), "method_id", "prev_revision_id")


@query
def global_blocks(spark, d):
    """Blocks of a revision named by the first block of their chain of signature matches."""
    b = blocks(spark, d)
    m = matching.signature_match(b).where("is_sig_matched")
    sides = [b.select(*[F.col(c).alias(f"_{c}") for c in ("revision_id", *matching.SIGNATURE)], F.col("block_id").alias(name)) for name in ("block_id", "matched_block_id")]
    for s, side in zip(sides, ("prev", "curr")):
        on = (F.col(f"{side}_revision_id") == F.col("_revision_id")) & matching.null_safe({c: F.col(f"{side}_{c}") for c in matching.SIGNATURE}, {c: F.col(f"_{c}") for c in matching.SIGNATURE})
        m = m.join(s, on).drop(*[f"_{c}" for c in ("revision_id", *matching.SIGNATURE)])
    links = b.select("block_id", "revision_id").join(m.select("block_id", "matched_block_id"), "block_id", "left")
    return lineage.relabel_chains(links).select("revision_id", "block_id", "global_block_id")


# Clones and rates


def enriched(spark, d):
    return clones.with_pairs(tracked(spark, d), clones.pair_summary(pairs(spark, d)))


@query
def median_similarity(spark, d):
    return clones.median_similarity(pairs(spark, d))


@query
def tracked_with_clones(spark, d):
    return enriched(spark, d).select("method_id", "prev_revision_id", "median_similarity", "has_clone")


@query
def clone_crosstab(spark, d):
    return rates.clone_crosstab(enriched(spark, d))


@query
def rates_by_clone(spark, d):
    return rates.rates_by_clone(enriched(spark, d))


@query
def rates_by_similarity(spark, d):
    return rates.rates_by_similarity(enriched(spark, d), SETTINGS.levels.high, SETTINGS.levels.low)


@query
def similarity_counts(spark, d):
    return rates.similarity_counts(enriched(spark, d), SETTINGS.levels.high, SETTINGS.levels.low)


@query
def clone_groups(spark, d):
    return clones.cumulative_groups(stored(pairs(spark, d)))


@query
def clone_groups_per_revision(spark, d):
    return clones.cumulative_groups(stored(pairs(spark, d)), per_revision=True)


def _with_status(spark, d):
    p = stored(pairs(spark, d))
    return clones.with_deletion_status(clones.with_groups(enriched(spark, d), stored(clones.cumulative_groups(p))))


@query
def deletion_status(spark, d):
    return _with_status(spark, d).select("method_id", "prev_revision_id", "group_id", "is_all_deleted", "is_partial_deleted")


@query
def deletion_crosstab(spark, d):
    return rates.deletion_crosstab(_with_status(spark, d))


@query
def revision_labels(spark, d):
    return clones.revision_labels(_with_status(spark, d).where("prev_revision_id is not null"))


@query
def groups_deleted(spark, d):
    return clones.filter_labels(revision_labels(spark, d), ["all_deleted", "partial_deleted"])


@query
def group_snapshot(spark, d):
    p = stored(pairs(spark, d))
    return clones.group_snapshot(stored(clones.cumulative_groups(p, per_revision=True)), p)


@query
def clone_group_report(spark, d):
    return clones.clone_group_report(group_snapshot(spark, d), 3)


@query
def clone_group_report_all(spark, d):
    """Groups of two and more, the operator's default."""
    return clones.clone_group_report(group_snapshot(spark, d))


@query
def group_tracking(spark, d):
    p = stored(pairs(spark, d))
    return clones.track_groups(stored(clones.cumulative_groups(p, per_revision=True)), matching.revision_steps(p))


# Survival and significance


def _survival(spark, d):
    return survival.deletion_survival(enriched(spark, d), {"Matched": "survived", "Absorber": "took in others", "Absorbed": "taken in", "Deleted": "deleted"})


@query
def deletion_survival(spark, d):
    return _survival(spark, d).select("method_id", "prev_revision_id", "survival_group", "group_label", "relative_time", "median_similarity")


@query
def survival_counts(spark, d):
    return survival.survival_counts(_survival(spark, d))


@query
def survival_boxes(spark, d):
    return survival.survival_boxes(_survival(spark, d))


@query
def survival_areas(spark, d):
    return survival.survival_areas(_survival(spark, d))


@query
def absorbed_cohorts(spark, d):
    return survival.absorbed_cohorts(_survival(spark, d))


@query
def signed_rank_by_clone(spark, d):
    return significance.signed_rank_sums(significance.paired_metrics(rates_by_clone(spark, d), significance.CLONE_METRICS)).drop("ties")


@query
def wilcoxon_by_clone(spark, d):
    return significance.wilcoxon(significance.paired_metrics(rates_by_clone(spark, d), significance.CLONE_METRICS))


@query
def wilcoxon_by_similarity(spark, d):
    return significance.wilcoxon(significance.paired_metrics(rates_by_similarity(spark, d), significance.SIMILARITY_METRICS))


@query
def rate_series(spark, d):
    return rates.rate_series(rates_by_clone(spark, d))


@query
def similarity_rate_series(spark, d):
    return rates.rate_series(rates_by_similarity(spark, d))


@query
def column_statistics(spark, d):
    return rates.column_statistics(blocks(spark, d), ["start_line", "end_line"])


@query
def similarity_histogram(spark, d):
    return rates.histogram(clones.median_similarity(pairs(spark, d)), "median_similarity", 5)


@query
def score_correlation(spark, d):
    p = pairs(spark, d).where("not isnan(ngram_overlap) and not isnan(verify_similarity) and ngram_overlap between 0 and 100 and verify_similarity between 0 and 100")
    return rates.correlations(p, ["ngram_overlap", "verify_similarity"])


# Audits


def method_states_of(spark, d):
    t = enriched(spark, d)
    after = blocks(spark, d).select(F.col("revision_id").alias("_r"), F.col("file_path").alias("_f"), F.col("method_name").alias("_m"), F.col("token_hash").alias("curr_token_hash"))
    t = t.join(after, (F.col("curr_revision_id") == F.col("_r")) & F.col("curr_file_path").eqNullSafe(F.col("_f")) & F.col("curr_method_name").eqNullSafe(F.col("_m")), "left")
    return audits.method_states(t).select("method_id", "prev_revision_id", "state")


@query
def method_states(spark, d):
    return method_states_of(spark, d)


def _with_lines(spark, d):
    t = enriched(spark, d)
    b = blocks(spark, d)
    for side in ("prev", "curr"):
        lines = b.select(F.col("revision_id").alias("_r"), F.col("file_path").alias("_f"), F.col("method_name").alias("_m"), F.col("start_line").alias(f"{side}_start_line"), F.col("end_line").alias(f"{side}_end_line"))
        t = t.join(lines, (F.col(f"{side}_revision_id") == F.col("_r")) & F.col(f"{side}_file_path").eqNullSafe(F.col("_f")) & F.col(f"{side}_method_name").eqNullSafe(F.col("_m")), "left").drop("_r", "_f", "_m")
    return audits.merge_splits(t)


@query
def state_counts(spark, d):
    """Methods by state and revision, their clone rate and changes."""
    return method_states_of(spark, d).groupBy("prev_revision_id", "state").agg(F.count("*").alias("n"))


@query
def method_overview(spark, d):
    """One row: rows, methods, share of rows with clones, mean and longest life in revisions."""
    t = enriched(spark, d).where("prev_revision_id is not null")
    methods = t.groupBy("method_id").agg(F.count("*").alias("n"), F.count_if("has_clone").alias("c"), F.count_distinct("prev_revision_id").alias("life"))
    return methods.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_methods"), (F.sum("c") / F.sum("n")).alias("clone_rate"), F.avg("life").alias("mean_lifetime"), F.max("life").alias("longest_lifetime"))


@query
def merge_splits(spark, d):
    return _with_lines(spark, d).select("method_id", "prev_revision_id", "prev_loc", "curr_loc", "is_split", "is_merged", "is_modified")


@query
def count_classified(spark, d):
    return audits.count_classified(_with_lines(spark, d))


def _audit(spark, d):
    t = tracked(spark, d)
    return audits.audit_triples(t, matching.revision_steps(t, "prev_revision_id"), "method_id")


@query
def audit_triples(spark, d):
    return _audit(spark, d)


@query
def audit_documents(spark, d):
    return audits.audit_json(_audit(spark, d))


def _vanished_files(spark, d):
    """Files of a revision that the next one hasn't got: what version control would report as deleted."""
    b = blocks(spark, d)
    files = b.select("revision_id", "file_path").distinct().join(matching.revision_steps(b).where("next_revision_id is not null").select("revision_id", "next_revision_id"), "revision_id")
    there = b.select(F.col("revision_id").alias("next_revision_id"), "file_path").distinct()
    return files.join(there, ["next_revision_id", "file_path"], "left_anti").select("file_path").distinct()


@query
def file_deletions(spark, d):
    return audits.file_deletion_counts(audits.file_deletions(enriched(spark, d), _vanished_files(spark, d)))


@query
def deleted_file_ratio(spark, d):
    return audits.deleted_file_ratio(audits.file_deletions(_with_status(spark, d), _vanished_files(spark, d)), "is_all_deleted")


# Rules and patterns over source text

_RULES = rules.make_rules()
_BY_PATTERN = [r for r in _RULES if r.name not in ("short_method", "empty_method", "single_return")]


@query
def rules_by_pattern(spark, d):
    s = table(spark, d, "code_snippets").select("snippet_id", "code", "function_name")
    return rules.apply_rules(s, _BY_PATTERN).drop("code", "function_name")


@query
def rules_by_lines(spark, d):
    s = table(spark, d, "code_snippets").select("snippet_id", "code", "function_name")
    return rules.apply_rules(s, rules.select_rules(_RULES, "short_method,empty_method,single_return")).drop("code", "function_name")


def _samples(spark, d):
    """Snippets with whether their block is gone from the next revision."""
    b = blocks(spark, d)
    gone = matching.signature_match(b).where("is_sig_deleted").select(F.col("prev_revision_id").alias("_r"), *[F.col(f"prev_{c}").alias(f"_{c}") for c in matching.SIGNATURE])
    dead = b.join(gone, (F.col("revision_id") == F.col("_r")) & matching.null_safe({c: F.col(c) for c in matching.SIGNATURE}, {c: F.col(f"_{c}") for c in matching.SIGNATURE}), "left_semi").select(F.col("block_id").cast("string").alias("_b"))
    s = table(spark, d, "code_snippets").select("snippet_id", "code", "function_name", "loc", "revision", "global_block_id")
    size = pairs(spark, d).select(F.explode(F.array(F.col("block_id_1").cast("string"), F.col("block_id_2").cast("string"))).alias("_k")).groupBy("_k").agg(F.count("*").alias("clone_group_size"))
    return s.join(dead, F.col("global_block_id") == F.col("_b"), "left").withColumn("is_deleted", F.col("_b").isNotNull()).drop("_b").join(size, F.col("global_block_id") == F.col("_k"), "left").drop("_k")


@query
def rule_evaluation(spark, d):
    s = rules.apply_rules(_samples(spark, d), _BY_PATTERN)
    return rules.evaluate_rules(s, "is_deleted", [f"rule_{r.name}" for r in _BY_PATTERN])


@query
def rule_outcomes(spark, d):
    s = rules.apply_rules(_samples(spark, d).select("snippet_id", "code", "function_name", "is_deleted"), _BY_PATTERN).drop("code", "function_name")
    return rules.classified_rows(s, "is_deleted", [f"rule_{r.name}" for r in _BY_PATTERN])


@query
def rule_evaluation_all(spark, d):
    """All default rules; those over lines have no SQL."""
    return rules.evaluate_rules(rules.apply_rules(_samples(spark, d), _RULES), "is_deleted", [f"rule_{r.name}" for r in _RULES])


@query
def rule_outcomes_all(spark, d):
    s = rules.apply_rules(_samples(spark, d).select("snippet_id", "code", "function_name", "is_deleted"), _RULES).drop("code", "function_name")
    return rules.classified_rows(s, "is_deleted", [f"rule_{r.name}" for r in _RULES])


@query
def deleted_soon(spark, d):
    rows = tracked(spark, d).where("prev_revision_id is not null").select("method_id", "prev_revision_id", "is_deleted")
    return rules.deleted_soon(rows, "method_id", "prev_revision_id", "is_deleted")


@query
def code_patterns(spark, d):
    s = table(spark, d, "code_snippets").select("snippet_id", "code", "function_name", "loc")
    return patterns.with_patterns(s).select("snippet_id", "detected_patterns")


@query
def pattern_statistics(spark, d):
    return patterns.pattern_statistics(patterns.with_patterns(_samples(spark, d)), "snippet_id")


@query
def characteristics(spark, d):
    return patterns.characteristics(_samples(spark, d))


@query
def basic_statistics(spark, d):
    return patterns.basic_statistics(_samples(spark, d))


@query
def match_types(spark, d):
    return patterns.match_types(_samples(spark, d).withColumn("match_type", F.when(F.col("clone_group_size") > 1, "many").when(F.col("clone_group_size") == 1, "one").otherwise("none")))


@query
def stratified_sample(spark, d):
    """A feature in itself: 50 samples of each state, the first by their ids so that SQL can follow."""
    return patterns.stratified_sample(_samples(spark, d).select("snippet_id", "is_deleted"), "snippet_id", "is_deleted", 50, order=F.col("snippet_id"))


@query
def stratified_sample_seeded(spark, d):
    """50 samples of each state by the operator's own seeded hash of the id: random, so without SQL."""
    return patterns.stratified_sample(_samples(spark, d).select("snippet_id", "is_deleted"), "snippet_id", "is_deleted", 50)


@query
def top_patterns(spark, d):
    """A top-k report: the ten patterns that go with deletion most."""
    return patterns.top_patterns(pattern_statistics(spark, d).drop("examples"))


@query
def first_deleted_sample(spark, d):
    """The first sample, by id, whose method is deleted and that has code."""
    return patterns.first_sample(_samples(spark, d).select("snippet_id", "function_name", "code", "is_deleted"), F.col("is_deleted") & F.col("code").isNotNull(), ["snippet_id"]).select("snippet_id", "function_name")


@query
def ground_truth(spark, d):
    s = table(spark, d, "code_snippets").select("snippet_id", "revision", "global_block_id")
    return audits.ground_truth(s, table(spark, d, "revisions"), blocks(spark, d))


@query
def group_statistics(spark, d):
    return clones.group_statistics(group_snapshot(spark, d))


@query
def group_state_counts(spark, d):
    return clones.group_state_counts(group_tracking(spark, d))


@query
def formatted_means(spark, d):
    return rates.formatted_means(significance.paired_metrics(rates_by_clone(spark, d), significance.CLONE_METRICS))


@query
def classified_union(spark, d):
    """Deleted files' methods and methods without a file, in one frame: each side has columns that the other lacks."""
    t = tracked(spark, d).where("prev_revision_id is not null")
    gone = t.where("is_deleted").select("method_id", "prev_revision_id", F.col("prev_file_path").alias("deleted_from"))
    moved = t.where(F.col("is_matched") & ~F.col("prev_file_path").eqNullSafe(F.col("curr_file_path"))).select("method_id", "prev_revision_id", F.col("curr_file_path").alias("moved_to"))
    return rates.union_aligned(gone, moved)


# Files: tables written as the analysis' files and read again by its readers


@query
def revision_names(spark, d):
    """The times that names of revision directories stand for; null for a name of another form."""
    return table(spark, d, "revisions").select("revision_dir", revisions.revision_time(F.col("revision_dir")).alias("time"))


def _directories(spark, d):
    """Revision directories of the records that can be loaded (a damaged one would take others along in a file) and of the pairs."""
    raw = table(spark, d, "code_blocks_raw")
    good = raw.join(p1_rows(spark, d).select("raw_id"), "raw_id").withColumn("line", F.regexp_replace("line", r"(\r\n|\r|\n)\z", ""))
    named = table(spark, d, "revisions").where("revision_id is not null").select("revision_dir", "revision_id").distinct()
    held = pairs(spark, d).join(named, "revision_id")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    fields = [quoted("token_hash_1"), quoted("token_hash_2"), F.col("ngram_overlap").cast("string"), F.col("verify_similarity").cast("string")]
    lines = held.select("revision_dir", F.concat_ws(",", *[F.coalesce(f, F.lit("")) for f in fields]).alias("line"))  # concat_ws leaves out nulls
    root = f"{shared_folder(spark)}/revisions-{uuid.uuid4().hex}"
    revisions.write_revisions(good.select("revision_dir", F.struct("line_no", "raw_id").alias("n"), "line"), lines, root)
    return root


@query
def ingested_blocks(spark, d):
    """Records written to revision directories and loaded: found, parsed, repeated signatures numbered, rejects told apart (here none)."""
    return revisions.load_code_blocks(spark, _directories(spark, d))[0].drop("revision_dir")


@query
def ingested_pairs(spark, d):
    root = _directories(spark, d)
    usable = revisions.usable_revisions(revisions.list_revisions(spark, root)).select("revision_dir")
    return revisions.read_clone_pairs(spark, root, empty_texts=True).join(usable, "revision_dir", "left_semi").drop("revision_dir")


def _again(df, form):
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    revisions.write_stage(df, path, form)
    return revisions.read_stage(df.sparkSession, path, df.schema, form)


@query
def stage_as_csv(spark, d):
    """Tracked rows written as csv and read again with a few columns and their types."""
    return _again(tracked(spark, d).select("method_id", "prev_revision_id", "prev_file_path", "curr_method_name", "similarity", "is_matched"), "csv").select("method_id", "prev_revision_id", "prev_file_path", "similarity", "is_matched")


@query
def stage_as_json(spark, d):
    """Samples written as json and read again."""
    return _again(_samples(spark, d).select("snippet_id", "function_name", "code", "loc", "is_deleted"), "json")


@query
def rates_from_pivot(spark, d):
    """The rate table written with two header lines and an Average row, and read again without them."""
    made = rates_by_clone(spark, d)
    path = f"{shared_folder(spark)}/pivot-{uuid.uuid4().hex}"
    pivot.write_pivot(made, path)
    return pivot.read_pivot(spark, path, made.columns, names={"prev_revision_id": "revision"})


# Clone reports


def _reports(spark, d):
    return table(spark, d, "documents").where((F.lower(strip(F.col("source"))) == "clone_report") & F.col("text").isNotNull()).select("doc_id", "text")


@query
def report_overview(spark, d):
    return reports.report_overview(_reports(spark, d), "doc_id")


@query
def report_members(spark, d):
    return reports.report_members(_reports(spark, d), "doc_id")


@query
def report_methods(spark, d):
    return reports.report_methods(_reports(spark, d), "doc_id")


@query
def report_match_types(spark, d):
    return report_overview(spark, d).groupBy("match_type").agg(F.count("*").alias("n"))


@query
def snapshot_stamps(spark, d):
    return matching.revision_steps(blocks(spark, d)).select(stamp("revision_id").alias("revision"), stamp("next_revision_id").alias("next_revision"))
