"""Long exact spans shared between records: content-defined chunks by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.session import stored

#: Tokens that the gear hash sees: 64 bits, shifted by 4 for each token.
GEAR_WINDOW, GEAR_SHIFT = 16, 4
#: Odd multipliers of the two prefix digests.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_U = np.uint64


def scramble(x: np.ndarray, seed: int) -> np.ndarray:
    """A random 64-bit number for each token (the splitmix64 finaliser)."""
    z = x.astype(np.int64).view(np.uint64) + _U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


class PrefixDigests:
    """128-bit digests of any stretches of a run of tokens: two polynomials modulo 2**64 over scrambled tokens."""

    def __init__(self, tokens: np.ndarray):
        self.parts = []
        for seed, base in enumerate(_BASES, 1):
            n = len(tokens) + 1
            power, inverse = np.ones(n, np.uint64), np.ones(n, np.uint64)
            power[1:], inverse[1:] = _U(base), _U(pow(base, -1, 1 << 64))
            power, inverse = np.cumprod(power), np.cumprod(inverse)
            prefix = np.zeros(n, np.uint64)
            np.cumsum(scramble(tokens, seed) * power[:-1], out=prefix[1:])
            self.parts.append((prefix, inverse))

    def of(self, first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = ((p[past] - p[first]) * inv[first] for p, inv in self.parts)
        return a.view(np.int64), b.view(np.int64)


def chunks_of(tokens: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Content-defined chunks of records laid end to end: record number, first token, past token (both within the run), anchor.

    Every run of `length` tokens (a window) is given an anchor that depends on its tokens alone: the place within it where the
    gear hash, over the last 16 tokens, is least (the first such place). A chunk covers a maximal series of windows
    with the same anchor place; so chunks overlap, are cut by content, and an insertion changes only the chunks it
    touches. Equal windows in different records always lie in chunks with equal anchors.
    """
    n, grams = len(tokens), length - GEAR_WINDOW + 1
    starts, ends = offsets[:-1], offsets[1:]
    fits = np.maximum(0, ends - starts - length + 1)
    owner = np.repeat(np.arange(len(starts)), fits)
    if not len(owner):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    at = np.arange(len(owner)) - np.repeat(np.cumsum(fits) - fits, fits) + starts[owner]
    gear = scramble(tokens, 0)
    h = np.zeros(n - GEAR_WINDOW + 1, np.uint64)
    for j in range(GEAR_WINDOW):
        h += gear[GEAR_WINDOW - 1 - j : n - j] << _U(GEAR_SHIFT * j)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    least = np.arange(len(h))
    width = 1

    def first_least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(h[b] < h[a], b, a)

    while width * 2 <= grams:
        least = first_least(least[:-width], least[width:])
        width *= 2
    if width < grams:
        k = grams - width
        least = first_least(least[:-k], least[k:])
    anchor = least[at]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return owner[first], at[first], at[last] + length, h[anchor[first]].view(np.int64)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_list(pa.int64()))
    values, offsets = column.flatten(), np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    return values.fill_null(-1).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(offsets)])


def distinct_sequences(df: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, seq): one row per key with a sequence."""
    return df.where(F.col(key).isNotNull() & F.col(seq).isNotNull()).groupBy(key).agg(F.first(seq).alias(seq))


def numbered(records: DataFrame) -> DataFrame:
    """The records, written, with `rec`: a number of each that no other has. It stays what it is because it is written."""
    return stored(records.withColumn("rec", F.monotonically_increasing_id()))


def islands(df: DataFrame, by: str, first: Column, last: Column) -> DataFrame:
    """Joins stretches (first to last, both included) of each `by` that overlap or touch. A `by` has as many rows as its own stretches."""
    order = Window.partitionBy(by).orderBy("_f", "_l")
    reach = F.max("_l").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.select(by, first.cast("long").alias("_f"), last.cast("long").alias("_l")).withColumn("_new", F.coalesce(F.col("_f") > reach + 1, F.lit(True)).cast("int"))
    return marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(by, "_island").agg(F.min("_f").alias("span_start"), F.max("_l").alias("span_end")).drop("_island")


def shared_spans(records: DataFrame, key: str, seq: str, length: int = 40) -> DataFrame:
    """(key, span_start, span_end): the maximal stretches of tokens that lie in a run of `length` that some other record holds too.

    `records` has one row per key, `numbered` (see distinct_sequences). Chunks are counted by
    anchor: chunks under an anchor that only one record has share nothing. Chunks with equal digests in two
    records are shared whole. Only for the distinct chunks that are left, under anchors that several records have, are the
    windows' digests compared. All three counts keep just the least and greatest record of a group and are
    aggregated before the shuffle, so a chunk that a third of all records hold is no hot spot, and no pairs of records are
    made. Digests have 128 bits. The result is exact: nothing is sampled and no group is capped.

    Records shorter than `length`, empty ones and null keys or sequences have no rows; null tokens equal each other; a run
    repeated within one record only is not shared; keys with equal sequences share them whole.
    """
    if length < GEAR_WINDOW:
        raise ValueError(f"spans must have at least {GEAR_WINDOW} tokens")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, offsets = _flat(b.column(1))
            owner, first, past, anchor = chunks_of(tokens, offsets, length)
            d1, d2 = PrefixDigests(tokens).of(first, past)
            rec = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rec[owner], (first - offsets[owner]).astype(np.int32), (past - first).astype(np.int32), anchor, d1, d2)], names=["rec", "first", "len", "anchor", "d1", "d2"])

    long_enough = records.where(F.size(seq) >= length).select("rec", seq)
    chunks = stored(long_enough.mapInArrow(cut, "rec long, first int, len int, anchor long, d1 long, d2 long"))
    content = stored(chunks.groupBy("anchor", "d1", "d2", "len").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi"), F.min(F.struct("rec", "first")).alias("at")))
    open_anchors = content.groupBy("anchor").agg(F.min("lo").alias("l"), F.max("hi").alias("h"), F.bool_or(F.col("lo") == F.col("hi")).alias("open")).where("l <> h and open").select("anchor")
    compared = content.join(open_anchors, "anchor", "left_semi").select(F.col("at.rec").alias("rec"), F.struct(F.col("at.first").alias("first"), "len", "lo", "hi", "d1", "d2").alias("c"))
    # The chunks of one record that are looked into: no more than the record has.
    wanted = compared.groupBy("rec").agg(F.collect_list("c").alias("c"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, offsets = _flat(b.column(0))
            cs = b.column(1)
            of, flat = np.repeat(np.arange(b.num_rows), cs.value_lengths().to_numpy(zero_copy_only=False)), cs.flatten()
            first, size, lo, hi, d1, d2 = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(6))
            count = size - length + 1
            of_chunk = np.repeat(np.arange(len(flat)), count)
            shift = np.arange(len(of_chunk)) - np.repeat(np.cumsum(count) - count, count)
            at = offsets[of[of_chunk]] + first[of_chunk] + shift
            w1, w2 = PrefixDigests(tokens).of(at, at + length)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w1, w2, lo[of_chunk], hi[of_chunk], d1[of_chunk], d2[of_chunk], shift.astype(np.int32))], names=["w1", "w2", "lo", "hi", "d1", "d2", "shift"])

    seen = stored(long_enough.join(wanted, "rec").select(seq, "c").mapInArrow(windows, "w1 long, w2 long, lo long, hi long, d1 long, d2 long, shift int"))
    shared = seen.groupBy("w1", "w2").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h").select("w1", "w2")
    # Shared places within each chunk that is not shared whole; a chunk has at most as many windows as a window has tokens.
    partly = seen.where("lo = hi").join(shared, ["w1", "w2"], "left_semi").groupBy("d1", "d2").agg(F.collect_set("shift").alias("shifts"))
    whole = content.where("lo <> hi").select("d1", "d2", F.array(F.lit(-1)).alias("shifts"))
    found = chunks.join(whole.unionByName(partly), ["d1", "d2"]).select("rec", "first", "len", F.explode("shifts").alias("shift"))
    is_whole = F.col("shift") < 0
    begin = F.when(is_whole, F.col("first")).otherwise(F.col("first") + F.col("shift"))
    end = F.when(is_whole, F.col("first") + F.col("len") - 1).otherwise(F.col("first") + F.col("shift") + length - 1)
    return islands(found, "rec", begin, end).join(records.select("rec", key), "rec").select(key, "span_start", "span_end")


def shared_share(records: DataFrame, spans: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, n_tokens, n_shared, share) of every record, from shared_spans; an empty record has share 0."""
    sums = spans.groupBy(key).agg(F.sum(F.col("span_end") - F.col("span_start") + 1).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return records.select(key, F.size(seq).cast("long").alias("n_tokens")).join(sums, key, "left").select(key, "n_tokens", n.alias("n_shared"), F.coalesce(F.try_divide(n.cast("double"), F.col("n_tokens").cast("double")), F.lit(0.0)).alias("share"))
