"""Matching methods of consecutive revisions: by signature and by similarity of their token sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.sequences import compare_sequences, gram_digests, minhash_band_rows
from strata.schemas import SIDE, SIGNATURE
from strata.session import stored

#: A gram that more sequences than this have is looked at only where a source can't do without it.
OFTEN = 1000

def revision_steps(revisions: DataFrame, revision: str = "revision_id") -> DataFrame:
    """(revision_id, next_revision_id, after_next_revision_id) of the revisions in order; null past the last.

    One row per revision, so the window without a partition is over a table as long as there are revisions.
    """
    order = Window.orderBy("revision_id")
    return revisions.where(F.col(revision).isNotNull()).select(F.col(revision).alias("revision_id")).distinct().select("revision_id", F.lead("revision_id", 1).over(order).alias("next_revision_id"), F.lead("revision_id", 2).over(order).alias("after_next_revision_id"))


def null_safe(left: dict[str, Column], right: dict[str, Column]) -> Column:
    on = F.lit(True)
    for k in left:
        on = on & left[k].eqNullSafe(right[k])
    return on


def rename_duplicates(blocks: DataFrame, revision: str, order: list[str]) -> DataFrame:
    """Methods with the same signature in a revision get _1, _2, ... behind their names, in `order`; nulls equal each other."""
    same = Window.partitionBy(revision, *SIGNATURE)
    n = F.count("*").over(same)
    return blocks.withColumn("_k", F.row_number().over(same.orderBy(*order))).withColumn("method_name", F.when(n > 1, F.concat_ws("_", "method_name", F.col("_k").cast("string"))).otherwise(F.col("method_name"))).drop("_k")


def signature_match(blocks: DataFrame) -> DataFrame:
    """Every method of a revision that has a next one, with the method of the same signature there (nulls equal each other).

    prev_* and curr_* of SIDE, is_sig_matched, is_sig_deleted, is_sig_added (never true: the join starts from the earlier
    revision). All steps are one join on (next revision, signature), a hash equi-join although null-safe.
    """
    steps = revision_steps(blocks).where("next_revision_id is not null")
    prev = blocks.select(*[F.col(c).alias(f"prev_{c}") for c in SIDE]).join(steps.select(F.col("revision_id").alias("prev_revision_id"), "next_revision_id"), "prev_revision_id")
    curr = blocks.select(*[F.col(c).alias(f"curr_{c}") for c in SIDE])
    on = (F.col("next_revision_id") == F.col("curr_revision_id")) & null_safe({c: F.col(f"prev_{c}") for c in SIGNATURE}, {c: F.col(f"curr_{c}") for c in SIGNATURE})
    matched = prev.join(curr, on, "left")
    found = F.col("curr_revision_id").isNotNull()
    return matched.select(*[f"prev_{c}" for c in SIDE], *[f"curr_{c}" for c in SIDE], found.alias("is_sig_matched"), (~found).alias("is_sig_deleted"), F.lit(False).alias("is_sig_added"), "next_revision_id")


def signature_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("is_sig_matched", "is_sig_deleted", "is_sig_added").agg(F.count("*").alias("n"))


def signature_check(matches: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per step: methods before, matched and deleted, and whether they add up."""
    sums = matches.groupBy("prev_revision_id").agg(F.count_if("is_sig_matched").alias("n_matched"), F.count_if("is_sig_deleted").alias("n_deleted"))
    before = blocks.groupBy(F.col("revision_id").alias("prev_revision_id")).agg(F.count("*").alias("n_before"))
    return sums.join(before, "prev_revision_id").select("prev_revision_id", "n_before", "n_matched", "n_deleted", (F.col("n_before") == F.col("n_matched") + F.col("n_deleted")).alias("adds_up"))


def sequence_steps(blocks: DataFrame) -> DataFrame:
    """(token_hash, seq, is_source, is_target steps): the different sequences and the steps they take part in, as arrays of revisions."""
    steps = revision_steps(blocks)
    return (
        blocks.where(F.col("token_sequence").isNotNull() & F.col("token_hash").isNotNull())
        .join(steps, "revision_id")
        .groupBy("token_hash")
        .agg(
            F.first("token_sequence").alias("seq"),
            # Revisions are few; a sequence has each at most once in a set.
            F.array_sort(F.collect_set("next_revision_id")).alias("as_source"),
            F.array_sort(F.collect_set("revision_id")).alias("as_target"),
        )
    )


def _meet(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """The pairs of which, in some step, src is in the earlier revision and tgt in the later one."""
    both = pairs.join(sequences.select(F.col("token_hash").alias("src"), "as_source"), "src").join(sequences.select(F.col("token_hash").alias("tgt"), "as_target"), "tgt")
    return both.where(F.arrays_overlap("as_source", "as_target")).select(*pairs.columns)


def similarity_candidates(sequences: DataFrame, n: int = 5, overlap: float = 0.1, least_length: float = 0.0, often: int = OFTEN) -> DataFrame:
    """(src, tgt, n_shared, n_grams): pairs of different sequences that meet in some step and share at least `overlap` of the source's n-grams.

    The inverted index is an equi-join of the exploded grams. It is over different sequences, not methods, so copies
    cost nothing; a sequence is exploded once for all steps. Grams that occur once take part in no join, and postings
    carry the time a sequence lives, so that most pairs that never meet end in the join.

    A join on a gram is as large as the square of its frequency, so of the grams that more than `often` sequences have, each source
    leaves out the most frequent ones, as long as fewer than it needs: a source that needs k shared grams may leave out k - 1,
    as any target must share another. Pairs are kept if the shared grams found and those left out may reach k, and are
    then counted by their whole sets. What still meets on a frequent gram is a source most of whose needed grams are frequent: pairs
    that are candidates by definition. No pair is lost. `least_length` leaves out targets that are too short
    to reach a similarity (LCS <= length of the target): exact if it is the similarity's threshold.
    """
    long = stored(
        sequences.where(F.size("seq") >= n).select(
            "token_hash", F.size("seq").alias("len"), gram_digests("seq", n).alias("g"), F.array_min("as_source").alias("s0"), F.array_max("as_source").alias("s1"), F.array_min("as_target").alias("t0"), F.array_max("as_target").alias("t1")
        )
    )
    postings = long.select("token_hash", F.size("g").cast("long").alias("n_grams"), "len", "s0", "s1", "t0", "t1", F.explode("g").alias("gram"))
    common = postings.groupBy("gram").agg(F.count("*").alias("f")).where("f > 1")
    useful = stored(postings.join(common, "gram"))
    need = F.ceil(F.col("n_grams") * overlap - 1e-9)
    src = useful.where("s0 is not null").select("gram", F.col("token_hash").alias("src"), "n_grams", F.col("len").alias("src_len"), "s0", "s1", F.lit(0).alias("n_out"))
    frequent = useful.where((F.col("f") > often) & (need > 1))
    some_out = not frequent.isEmpty()
    if some_out:
        # A window over one sequence's own grams.
        place = F.row_number().over(Window.partitionBy("token_hash").orderBy(F.desc("f"), "gram"))
        out = stored(frequent.withColumn("_k", place).where(F.col("_k") < need).select(F.col("token_hash").alias("src"), "gram"))
        n_out = out.groupBy("src").agg(F.count("*").cast("int").alias("n_out"))
        src = src.drop("n_out").join(out, ["src", "gram"], "left_anti").join(n_out, "src", "left").withColumn("n_out", F.coalesce("n_out", F.lit(0)))
    tgt = useful.select("gram", F.col("token_hash").alias("tgt"), F.col("len").alias("tgt_len"), "t0", "t1")
    meets = (F.col("src") != F.col("tgt")) & (F.col("tgt_len") >= F.col("src_len") * least_length) & (F.col("s0") <= F.col("t1")) & (F.col("s1") >= F.col("t0"))
    pairs = src.join(tgt, "gram").where(meets).groupBy("src", "tgt").agg(F.count("*").alias("n_shared"), F.first("n_grams").alias("n_grams"), F.first("n_out").alias("n_out"))
    enough = F.col("n_shared") >= F.col("n_grams") * overlap
    if some_out:
        pairs = stored(pairs.where((F.col("n_out") > 0) | enough))
        sets = [long.select(F.col("token_hash").alias(x), F.col("g").alias(f"g_{x}")) for x in ("src", "tgt")]
        counted = pairs.where("n_out > 0").drop("n_shared").join(sets[0], "src").join(sets[1], "tgt").withColumn("n_shared", F.size(F.array_intersect("g_src", "g_tgt")).cast("long"))
        pairs = pairs.where("n_out = 0").unionByName(counted.select(*pairs.columns))
    return _meet(pairs.where(enough).select("src", "tgt", "n_shared", "n_grams"), sequences)


def lsh_candidates(sequences: DataFrame, n: int = 5, bands: int = 32, rows: int = 2, top_k: int | None = None) -> DataFrame:
    """(src, tgt): pairs that agree in a band of minhashes and meet in some step, both ways. Approximate: with 32 bands of 2, 0.95 of the
    pairs of Jaccard similarity 0.3 are expected and 0.73 of those of 0.2 (a short source in a long target has no more); with bands of 4
    it would be 0.23 and 0.05. `top_k` keeps only the targets that agree with a source in the most bands, as the original analysis
    offers; nothing is cut by default. similarity_candidates is the exact form and the default."""
    sets = sequences.where(F.size("seq") >= n).select("token_hash", gram_digests("seq", n).alias("g"))
    banded = stored(minhash_band_rows(sets, "token_hash", "g", bands, rows))
    pairs = banded.withColumnRenamed("token_hash", "src").join(banded.withColumnRenamed("token_hash", "tgt"), ["band", "value"]).where("src <> tgt").groupBy("src", "tgt").agg(F.count("*").alias("_n"))
    meet = _meet(pairs, sequences)
    if top_k is not None:
        meet = meet.withColumn("_k", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("_n"), "tgt"))).where(F.col("_k") <= top_k)
    return meet.select("src", "tgt")


def similar_sequences(blocks: DataFrame, n: int = 5, overlap: float = 0.1, similarity: float = 0.7, approximate: bool = False, top_k: int | None = None) -> DataFrame:
    """(src, tgt, raw_similarity, similarity): sequence pairs whose LCS covers at least `similarity` of the source.

    The threshold is on the unrounded ratio; `similarity` has two decimals. A sequence is similar to itself if it has n
    tokens. The LCS runs once per pair of sequences, in Arrow batches, after the written candidates. `approximate` takes candidates
    from lsh_candidates instead, without the overlap filter.
    """
    sequences = stored(sequence_steps(blocks))
    pairs = stored(lsh_candidates(sequences, n, top_k=top_k) if approximate else similarity_candidates(sequences, n, overlap, similarity))
    seqs = sequences.select("token_hash", "seq")
    both = pairs.select("src", "tgt").join(seqs.select(F.col("token_hash").alias("src"), F.col("seq").alias("s")), "src").join(seqs.select(F.col("token_hash").alias("tgt"), F.col("seq").alias("t")), "tgt")
    measured = compare_sequences(both, ["src", "tgt"], "s", "t", similarity)
    itself = sequences.where((F.size("seq") >= n) & F.arrays_overlap("as_source", "as_target")).select(F.col("token_hash").alias("src"), F.col("token_hash").alias("tgt"), F.lit(1.0).alias("raw_similarity"), F.lit(1.0).alias("similarity"))
    return measured.unionByName(itself)


def similarity_match(blocks: DataFrame, similar: DataFrame) -> DataFrame:
    """One row per method of a revision that has a next one: the best similar method there, or none.

    Best is the greatest rounded similarity, then the target first in the order of its signature. Of the methods that
    share a sequence in a revision only the first can be best, so targets are reduced to one per (revision, sequence)
    before the join and the m:n matches are never spelled out. prev_*, curr_*, similarity, is_sim_matched, is_sim_deleted,
    is_sim_added (never true, see emit_added).
    """
    steps = revision_steps(blocks).where("next_revision_id is not null").select(F.col("revision_id").alias("prev_revision_id"), "next_revision_id")
    first = blocks.groupBy("revision_id", "token_hash").agg(F.min(F.struct(*[F.struct(F.col(c).isNull().alias("z"), F.col(c).alias("v")).alias(c) for c in SIGNATURE])).alias("_s"))
    targets = first.select(F.col("revision_id").alias("next_revision_id"), F.col("token_hash").alias("tgt"), *[F.col(f"_s.{c}.v").alias(f"curr_{c}") for c in SIGNATURE])
    sources = blocks.select("revision_id", "token_hash").distinct().withColumnRenamed("revision_id", "prev_revision_id").join(steps, "prev_revision_id")
    rank = F.struct((-F.col("similarity")).alias("_n"), *[F.struct(F.col(f"curr_{c}").isNull().alias("z"), F.col(f"curr_{c}").alias("v")).alias(c) for c in SIGNATURE], F.col("tgt"))
    best = (
        sources.join(similar, sources["token_hash"] == similar["src"])
        .join(targets, ["next_revision_id", "tgt"])
        .groupBy("prev_revision_id", "next_revision_id", "token_hash")
        .agg(F.min(rank).alias("_b"))
        .select(F.col("prev_revision_id").alias("_r"), F.col("token_hash").alias("_h"), F.col("next_revision_id").alias("_to"), (-F.col("_b._n")).alias("similarity"), F.col("_b.tgt").alias("curr_token_hash"), *[F.col(f"_b.{c}.v").alias(f"curr_{c}") for c in SIGNATURE])
    )
    prev = blocks.select(*[F.col(c).alias(f"prev_{c}") for c in SIDE]).join(steps.select("prev_revision_id"), "prev_revision_id")
    found = F.col("similarity").isNotNull()
    return (
        prev.join(best, (F.col("prev_revision_id") == F.col("_r")) & (F.col("prev_token_hash") == F.col("_h")), "left")
        .withColumnRenamed("_to", "curr_revision_id")
        .select(*[f"prev_{c}" for c in SIDE], *[f"curr_{c}" for c in SIDE], "similarity", found.alias("is_sim_matched"), (~found).alias("is_sim_deleted"), F.lit(False).alias("is_sim_added"))
    )


def combined_match(sig: DataFrame, sim: DataFrame, similar: DataFrame, prefer_signature_target: bool = True) -> DataFrame:
    """One row per method and step, from both matches, with is_matched = either, is_deleted = both deleted, is_added = neither.

    With `prefer_signature_target` a method that its signature finds keeps that target (with its similarity if it is
    similar, else null); without, the most similar target wins wherever there is one, as the original analysis does.
    """
    keys = ["revision_id", *SIGNATURE]
    left = sig.select(*[F.col(f"prev_{c}").alias(f"_p_{c}") for c in keys], *[F.col(f"curr_{c}").alias(f"_g_{c}") for c in SIDE], "is_sig_matched", "is_sig_deleted", "is_sig_added")
    on = null_safe({c: F.col(f"prev_{c}") for c in keys}, {c: F.col(f"_p_{c}") for c in keys})
    both = sim.join(left, on, "left").join(similar.select(F.col("src").alias("_src"), F.col("tgt").alias("_tgt"), F.col("similarity").alias("_sig_similarity")), (F.col("prev_token_hash") == F.col("_src")) & (F.col("_g_token_hash") == F.col("_tgt")), "left")
    sig_matched = F.coalesce("is_sig_matched", F.lit(False))
    take = sig_matched if prefer_signature_target else sig_matched & ~F.col("is_sim_matched")
    matched, deleted = sig_matched | F.col("is_sim_matched"), F.coalesce("is_sig_deleted", F.lit(True)) & F.col("is_sim_deleted")
    return both.select(
        *[f"prev_{c}" for c in SIDE],
        *[F.when(take, F.col(f"_g_{c}")).otherwise(F.col(f"curr_{c}")).alias(f"curr_{c}") for c in SIDE],
        F.when(take, F.col("_sig_similarity")).otherwise(F.col("similarity")).alias("similarity"),
        "is_sim_matched",
        "is_sim_deleted",
        "is_sim_added",
        sig_matched.alias("is_sig_matched"),
        F.coalesce("is_sig_deleted", F.lit(True)).alias("is_sig_deleted"),
        F.lit(False).alias("is_sig_added"),
        matched.alias("is_matched"),
        deleted.alias("is_deleted"),
        (~matched & ~deleted).alias("is_added"),
    )


def added_methods(blocks: DataFrame, matches: DataFrame) -> DataFrame:
    """Methods of a revision with a previous one that no match leads to (the original leaves these out unless a side is empty)."""
    steps = revision_steps(blocks).where("next_revision_id is not null").select(F.col("next_revision_id").alias("revision_id"))
    keys = ["revision_id", *SIGNATURE]
    reached = matches.where(F.col("curr_revision_id").isNotNull()).select(*[F.col(f"curr_{c}").alias(f"_{c}") for c in keys])
    return blocks.join(steps, "revision_id").join(reached, null_safe({c: F.col(c) for c in keys}, {c: F.col(f"_{c}") for c in keys}), "left_anti").select(*[F.col(c).alias(f"curr_{c}") for c in SIDE])


def progressive_match(blocks: DataFrame, thresholds: list[float], n: int = 5, overlap: float = 0.1) -> DataFrame:
    """Similarity matches by falling thresholds: what a higher one matches isn't looked at again. Adds `threshold`."""
    similar = stored(similar_sequences(blocks, n, overlap, min(thresholds)))
    best = similarity_match(blocks, similar).where("is_sim_matched")
    level = F.lit(None).cast("double")
    for t in sorted(thresholds):
        level = F.when(F.col("similarity") >= t, F.lit(float(t))).otherwise(level)
    return best.withColumn("threshold", level)
