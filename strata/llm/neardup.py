"""Near-duplicate records with small edits: an exact similarity join through signature trees.

Records are sets of runs of tokens (grams). Two sets with a Jaccard similarity of at least t share a gram among the first
n - ceil(t n) + 1 grams of each, in any order of all grams that is the same for both. In the order used here, rare
grams come first, so few records meet by chance and a gram that only one record has brings nobody together. Records that
do meet are entered into signature trees, one per range of grams: a leaf is a record's bitmap and size, a node the OR of
its children's bitmaps and the range of their sizes. A tree is traversed against itself from the root; a pair of
nodes is left as soon as the greatest overlap its bitmaps allow is below the least that its sizes demand. What is left is
compared by its sets.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.bpe import small
from strata.llm.components import connected_components
from strata.llm.spans import _flat, scramble
from strata.session import Stored, stored

#: 64-bit words of a record's bitmap, and of the bitmap of the grams that records were entered for.
WORDS, OWN_WORDS = 8, 16
#: Children of a node.
FAN_OUT = 8
#: Grams counted by the finder of frequent grams go to so many counters; a counter is frequent from 1/HOT_SHARE of all grams.
COUNTERS, HOT_SHARE = 1 << 20, 20_000
#: Grams per task when they are counted, entries per tree.
GRAMS_PER_TASK, ENTRIES_PER_TREE = 2_000_000, 8192
_TOKEN = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")
_U = np.uint64


class _TokenNumbers(dict):
    """A 64-bit number for each token text."""

    def __missing__(self, token: str) -> int:
        n = int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        if len(self) < 500_000:
            self[token] = n
        return n


_NUMBERS = _TokenNumbers()


def code_tokens(text: str) -> list[str]:
    """Maximal runs of ASCII letters, digits and _, and each other character that isn't white space."""
    return _TOKEN.findall(text)


def gram_sets(tokens: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per record its different grams, sorted, as digests, laid end to end with their offsets."""
    fits = np.maximum(0, offsets[1:] - offsets[:-1] - width + 1)
    owner = np.repeat(np.arange(len(fits)), fits)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(fits) - fits, fits) + offsets[:-1][owner]
    h = np.zeros(len(at), np.uint64)
    base = scramble(tokens, 21)
    for j in range(width):
        h = h * _U(0x9E3779B97F4A7C15) + (base[at + j] if len(at) else _U(0))
    h = scramble(h.view(np.int64), 22)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(fits)))]).astype(np.int64)


def _segment_or(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.bitwise_or.reduceat(words, starts, axis=0) if len(starts) else words[:0]


def bitmaps(grams: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of each record: bit (gram mod its length) for each gram. Records must have grams."""
    out = np.zeros((len(offsets) - 1, words), np.uint64)
    bit = grams % _U(words * 64)
    owner = np.repeat(np.arange(len(offsets) - 1), offsets[1:] - offsets[:-1])
    np.bitwise_or.at(out, (owner, (bit >> _U(6)).astype(np.int64)), _U(1) << (bit & _U(63)))
    return out


def set_classes(df: DataFrame, key: str, source: str, is_code: bool, width: int) -> DataFrame:
    """(id, d1, d2, n, grams): each record's set, its size and 128 bits of digest. Records without a gram are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in small(whole)):
            if is_code:
                lists = [code_tokens(t) if t else [] for t in b.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
                tokens = np.fromiter((_NUMBERS[t] for x in lists for t in x), np.int64, offsets[-1])
            else:
                tokens, offsets = _flat(b.column(1))
            grams, at = gram_sets(tokens, offsets, width)
            n = np.diff(at)
            some = np.flatnonzero(n)
            d1, d2 = (np.add.reduceat(scramble(grams.view(np.int64), seed), at[some]) if len(some) else np.zeros(0, np.uint64) for seed in (23, 24))
            lists_ = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[some])]), pa.int32()), pa.array(grams.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(n[some], pa.int32()), lists_], names=["id", "d1", "d2", "n", "grams"])

    return df.select(F.col(key).cast("string").alias("id"), source).mapInArrow(run, "id string, d1 long, d2 long, n int, grams array<long>")


def _prefix(n: np.ndarray, t: float) -> np.ndarray:
    return (n - np.ceil(t * n - 1e-9) + 1).astype(np.int64)


def frequent_counters(sets: DataFrame) -> tuple[np.ndarray, int]:
    """The counters that hold at least about 1/HOT_SHARE of all grams (so at most HOT_SHARE of them), and the number of grams.

    Each task adds up its grams in a fixed number of counters and passes on those with at least half that share of its
    own; every gram is counted. The result only sets the order of grams, in which any error costs time and no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for b in batches:
            counts += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False) & (COUNTERS - 1), minlength=COUNTERS)
        total = int(counts.sum())
        at = np.flatnonzero(counts >= max(1, total / HOT_SHARE / 2))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at])), pa.array(np.concatenate([[total], counts[at]]))], names=["c", "n"])

    sums = stored(sets.select("grams").mapInArrow(run, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")))
    total = sums.where("c = -1").agg(F.sum("n")).first()[0] or 0
    hot = sums.where((F.col("c") >= 0) & (F.col("n") >= max(64, total / HOT_SHARE))).select("c").toPandas()["c"].to_numpy(np.int64)
    return np.sort(hot), total


def _joined(pdf: pd.DataFrame, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(pdf[column]), kind)


def _cut(order: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each part, given places sorted by part."""
    if len(order):
        edge = np.flatnonzero(np.diff(part[order])) + 1
        for piece in np.split(order, edge):
            yield int(part[piece[0]]), piece


def rare_first_entries(sets: DataFrame, threshold: float) -> tuple[DataFrame, int]:
    """(bucket, cls, n, sig, grams, rest): each record entered in the buckets of those of its first grams that other records have as
    well, with these grams and, for each, how many of the record's grams come from there on.

    Grams are counted exactly: packed arrays of (gram, record) go to the gram's task, and those that more than one
    record has return, with their frequency, to the record's task, where the first of them are chosen. Grams that only one
    record has come first of all, so they use up a record's prefix without being sent back. Grams of frequent
    counters come last, in the order of their digests, and are neither sent nor counted: a record whose prefix reaches
    them is entered for them at once. So no task receives a gram that a large share of all records has.
    """
    hot, total = frequent_counters(sets)
    spark = sets.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / GRAMS_PER_TASK))
    buckets = max(16, math.ceil(total / 12 / ENTRIES_PER_TREE))

    def split(b: pa.RecordBatch):
        grams = b.column("grams").flatten().to_numpy(zero_copy_only=False)
        n = b.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
        cls = b.column("cls").to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(n)), n)
        frequent = np.isin(grams & (COUNTERS - 1), hot)
        common = np.bincount(owner[~frequent], minlength=len(n))
        return grams.view(np.uint64), n, cls, owner, frequent, _prefix(n, threshold) - common

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            grams, n, cls, owner, frequent, spare = split(b)
            at = np.flatnonzero(~frequent)
            short = (grams[at] >> _U(32)).astype(np.uint32)
            part = (short % np.uint32(tasks)).astype(np.int64)
            rows = []
            for p, piece in _cut(np.argsort(part, kind="stable"), part):
                own, first, size = np.unique(owner[at[piece]], return_index=True, return_counts=True)
                rows.append((p, cls[own].tobytes(), spare[own].astype(np.int32).tobytes(), size.astype(np.int32).tobytes(), short[piece].tobytes()))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["part", "cls", "spare", "size", "grams"]).astype({"part": "int32"}), schema=sent)

    sent = pa.schema([("part", pa.int32()), ("cls", pa.binary()), ("spare", pa.binary()), ("size", pa.binary()), ("grams", pa.binary())])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        size = _joined(pdf, "size", np.int32)
        cls, spare = np.repeat(_joined(pdf, "cls", np.int64), size), np.repeat(_joined(pdf, "spare", np.int32), size)
        grams = _joined(pdf, "grams", np.uint32)
        order = np.argsort(grams, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], np.diff(grams[order]) != 0, [True]]))
        freq = np.repeat(np.diff(edge), np.diff(edge))
        order, freq = order[freq > 1], freq[freq > 1]
        cls, spare, grams = cls[order], spare[order], grams[order]
        part = cls.view(np.uint64) % _U(tasks)
        rows = []
        for p, piece in _cut(np.lexsort((cls, part)), part.astype(np.int64)):
            new = np.flatnonzero(np.concatenate([[True], np.diff(cls[piece]) != 0]))
            rows.append((p, cls[piece][new].tobytes(), spare[piece][new].tobytes(), np.diff(np.concatenate([new, [len(piece)]])).astype(np.int32).tobytes(), grams[piece].tobytes(), np.minimum(freq[piece], 65535).astype(np.uint16).tobytes()))
        return pd.DataFrame(rows, columns=["part", "cls", "spare", "size", "grams", "freq"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            grams, n, cls = b.column("grams").flatten().to_numpy(zero_copy_only=False).view(np.uint64), b.column("n").to_numpy(zero_copy_only=False), b.column("cls").to_numpy(zero_copy_only=False)
            sig = bitmaps(grams, np.concatenate([[0], np.cumsum(n)]), WORDS)
            yield pa.RecordBatch.from_arrays([pa.array((cls.view(np.uint64) % _U(tasks)).astype(np.int32)), pa.array(cls), pa.array(n, pa.int32()), pa.array([x.tobytes() for x in sig], pa.binary())], names=["part", "cls", "n", "sig"])

    def enter(pdf: pd.DataFrame, sketches: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({c: [] for c in ("bucket", "cls", "n", "sig", "grams", "rest")})
        size = _joined(pdf, "size", np.int32)
        cls, spare = np.repeat(_joined(pdf, "cls", np.int64), size), np.repeat(_joined(pdf, "spare", np.int32), size)
        grams, freq = _joined(pdf, "grams", np.uint32), _joined(pdf, "freq", np.uint16)
        order = np.lexsort((grams, freq, cls))
        cls, spare, grams = cls[order], spare[order], grams[order]
        new = np.flatnonzero(np.concatenate([[True], np.diff(cls) != 0]))
        have = np.diff(np.concatenate([new, [len(cls)]]))
        rank = np.arange(len(cls)) - np.repeat(new, have)
        use = rank < np.repeat(have, have) + spare
        # Grams that no other record has come first and frequent ones last: with `spare` more than all that aren't frequent, the prefix ends.
        before = rank[use] - np.repeat(have, have)[use] - spare[use]
        return _entries(cls[use], grams[use], (grams[use] % np.uint32(buckets)).astype(np.int64), before, sketches, threshold)

    def enter_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            grams, n, cls, owner, frequent, spare = split(b)
            at = np.flatnonzero(frequent & (spare > 0)[owner])
            if not len(at):
                continue
            own = owner[at]  # a record's grams are in the order of their digests
            new = np.flatnonzero(np.concatenate([[True], np.diff(own) != 0]))
            rank = np.arange(len(own)) - np.repeat(new, np.diff(np.concatenate([new, [len(own)]])))
            use = at[rank < spare[own]]
            some = np.unique(owner[use])
            flags = np.isin(owner, some)
            sig = bitmaps(grams[flags], np.concatenate([[0], np.cumsum(n[some])]), WORDS)
            sketches = pd.DataFrame({"cls": cls[some], "n": n[some], "sig": [x.tobytes() for x in sig]})
            short = (grams[use] >> _U(32)).astype(np.uint32)
            # Each frequent gram has a bucket of its own.
            before = (rank - spare[own])[rank < spare[own]]
            yield pa.RecordBatch.from_pandas(_entries(cls[owner[use]], short, -1 - short.astype(np.int64), before, sketches, threshold), schema=entered)

    entered = pa.schema([("bucket", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()), ("grams", pa.binary()), ("rest", pa.binary())])
    packed = "part int, cls binary, spare binary, size binary, grams binary"
    there = sets.select("cls", "n", "grams").mapInArrow(send, packed).groupBy("part").applyInPandas(count, packed + ", freq binary")
    sketches = sets.select("cls", "n", "grams").mapInArrow(sketch, "part int, cls long, n int, sig binary")
    out = "bucket long, cls long, n int, sig binary, grams binary, rest binary"
    common = there.groupBy("part").cogroup(sketches.groupBy("part")).applyInPandas(enter, out)
    if not len(hot):
        return common, buckets
    return common.unionByName(sets.select("cls", "n", "grams").mapInArrow(enter_hot, out)), buckets


def _entries(cls: np.ndarray, grams: np.ndarray, bucket: np.ndarray, before: np.ndarray, sketches: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One row per (bucket, record) with its grams there; `before` is a gram's place counted from the end of the prefix (below 0)."""
    order = np.lexsort((bucket, cls))
    cls, grams, bucket, before = cls[order], grams[order], bucket[order], before[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(cls) != 0) | (np.diff(bucket) != 0)])) if len(cls) else np.zeros(0, np.int64)
    past = np.concatenate([new[1:], [len(cls)]]).astype(np.int64)
    by = sketches.set_index("cls")
    at = by.index.get_indexer(cls[new])
    n = by["n"].to_numpy()[at].astype(np.int64)
    rest = (np.repeat(n - _prefix(n, threshold), past - new) - before).astype(np.int32)
    pieces = lambda x: [x[i:j].tobytes() for i, j in zip(new, past)]
    return pd.DataFrame({"bucket": bucket[new], "cls": cls[new], "n": n.astype(np.int32), "sig": by["sig"].to_numpy()[at], "grams": pieces(grams), "rest": pieces(rest)})


class SignatureTree:
    """Levels of nodes, the entries first, one for each record and gram: bitmaps of all grams and of those entered for, least and
    greatest size, the most grams of an entry that share a bit with another of its own, and the most that come from its gram on."""

    def __init__(self, sig: np.ndarray, gram: np.ndarray, n: np.ndarray, rest: np.ndarray, record: np.ndarray):
        self.gram, self.record = gram, record
        bit = scramble(gram.astype(np.int64), 27) % _U(OWN_WORDS * 64)
        own = np.zeros((len(n), OWN_WORDS), np.uint64)
        own[np.arange(len(n)), (bit >> _U(6)).astype(np.int64)] = _U(1) << (bit & _U(63))
        self.levels = [(sig, own, n, n, n - np.bitwise_count(sig).sum(1).astype(np.int64), rest)]
        while len(self.levels[-1][2]) > 1:
            s, o, low, high, folded, most = self.levels[-1]
            starts = np.arange(0, len(low), FAN_OUT)
            self.levels.append((_segment_or(s, starts), _segment_or(o, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(folded, starts), np.maximum.reduceat(most, starts)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
        """The places of the pairs below whose nodes some entries may have similarity t and their gram as the first in common."""
        sig, own, low, high, folded, rest = self.levels[level]
        if level:
            at = np.flatnonzero((own[a] & own[b]).any(1))
        else:
            at = np.flatnonzero((self.gram[a] == self.gram[b]) & (self.record[a] != self.record[b]))
        a, b = a[at], b[at]
        least = np.maximum(t / (1 + t) * (low[a] + low[b]), t * np.maximum(low[a], low[b])) - 1e-9
        ok = (high[a] >= t * low[b] - 1e-9) & (high[b] >= t * low[a] - 1e-9) & (np.minimum(rest[a], rest[b]) >= least)
        at, a, b, least = at[ok], a[ok], b[ok], least[ok]
        return at[np.bitwise_count(sig[a] & sig[b]).sum(1).astype(np.int64) + np.minimum(folded[a], folded[b]) >= least]

    def pairs(self, t: float, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of entries of different records that may have similarity t, by traversal of the tree against itself."""
        top = len(self.levels) - 1
        todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))] if len(self.levels[0][2]) else []
        step = np.arange(FAN_OUT)
        while todo:
            level, a, b = todo.pop()
            if len(a) > block:
                todo += [(level, a[block:], b[block:])]
                a, b = a[:block], b[:block]
            ok = self.possible(level, a, b, t)
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            if level == 0:
                yield a, b
                continue
            x = (a[:, None, None] * FAN_OUT + step[None, :, None] + 0 * step).reshape(-1)
            y = (b[:, None, None] * FAN_OUT + step[None, None, :] + 0 * step[:, None]).reshape(-1)
            count = len(self.levels[level - 1][2])
            keep = (x < count) & (y < count) & (x <= y)
            todo.append((level - 1, x[keep], y[keep]))


def size_blocks(entries: DataFrame, threshold: float) -> DataFrame:
    """(_b, _n, first, last, low, high) for each size in a bucket that has more entries than a tree: its entries are dealt into the blocks
    from `first` to `last`, and may be similar to those in blocks from `low` to `high`. Blocks are in the order of sizes."""
    counts = entries.groupBy("bucket", "n").agg(F.count("*").alias("c"))
    large = counts.groupBy(F.col("bucket").alias("_b")).agg(F.sum("c").alias("all")).where(F.col("all") > ENTRIES_PER_TREE)
    sizes = counts.join(large, F.col("bucket") == F.col("_b"))
    by_size = Window.partitionBy("_b").orderBy("n")
    upto = F.sum("c").over(by_size)
    dealt = sizes.select("_b", F.col("n").alias("_n"), F.floor((upto - F.col("c")) / ENTRIES_PER_TREE).cast("int").alias("first"), F.floor((upto - 1) / ENTRIES_PER_TREE).cast("int").alias("last"))
    # Sizes within the ratio are within a range of logarithms; in whole millionths, with something to spare.
    reach = math.ceil(-math.log(threshold) * 1e6) + 3
    near = Window.partitionBy("_b").orderBy("_log").rangeBetween(-reach, reach)
    return dealt.withColumn("_log", F.floor(F.log("_n") * 1e6)).select("_b", "_n", "first", "last", F.min("first").over(near).alias("low"), F.max("last").over(near).alias("high"))


def candidate_pairs(entries: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: pairs of records in one bucket that the signature trees do not rule out, unique.

    A bucket with more entries than a tree should have is dealt into blocks in the order of sizes, one size into several if
    need be, and each two blocks whose sizes allow the similarity share a task: no task holds an unbounded group, no pair
    is lost, and an entry is sent only to blocks it may have a partner in.
    """
    entries = stored(entries)
    large = stored(size_blocks(entries, threshold))
    mine = (F.col("first") + F.pmod(F.xxhash64(F.lit(31), "cls"), F.col("last") - F.col("first") + 1)).cast("int")
    others = F.explode(F.when(F.col("first").isNull(), F.array(F.lit(0))).otherwise(F.sequence("low", "high")))
    dealt = entries.join(large, (F.col("bucket") == F.col("_b")) & (F.col("n") == F.col("_n")), "left").withColumn("_i", F.coalesce(mine, F.lit(0))).withColumn("_j", others)
    dealt = dealt.select("bucket", F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), "cls", "n", "sig", "grams", "rest")

    def traverse(pdf: pd.DataFrame) -> pd.DataFrame:
        row = np.repeat(np.arange(len(pdf)), [len(x) // 4 for x in pdf["grams"]])
        gram, rest = _joined(pdf, "grams", np.uint32), _joined(pdf, "rest", np.int32).astype(np.int64)
        sig, n, cls = _joined(pdf, "sig", np.uint64).reshape(-1, WORDS), pdf["n"].to_numpy(np.int64), pdf["cls"].to_numpy(np.int64)
        order = np.lexsort((n[row], gram))
        row = row[order]
        found = [np.zeros((2, 0), np.int64)]
        for x, y in SignatureTree(sig[row], gram[order], n[row], rest[order], row).pairs(threshold):
            found.append(np.sort(cls[row[np.stack([x, y])]], axis=0))
        a, b = np.unique(np.concatenate(found, axis=1), axis=1)
        return pd.DataFrame({"a": a, "b": b})

    return dealt.groupBy("bucket", "i", "j").applyInPandas(traverse, "a long, b long").distinct()


def similar_classes(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs of different sets, by class, whose Jaccard similarity is at least `threshold`. `sets` is stored and has one row per class."""
    entries, _ = rare_first_entries(sets, threshold)
    pairs = candidate_pairs(entries, threshold)
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    shared = F.size(F.array_intersect("ga", "gb"))
    # Merged, not broadcast: numbers of classes take little room in a file, so a file's size says nothing of what it takes in memory.
    checked = stored(pairs).hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "na", "nb", shared.alias("k"))
    return checked.where(F.col("k") >= threshold * (F.col("na") + F.col("nb") - F.col("k")) - 1e-9).select("a", "b")


class NearDuplicates:
    """Similarity join of records of one or more kinds, each with its own ids.

    `members` has (kind, id, cls); `pairs` (a, b) between classes, records with equal sets being one class. Records with
    fewer tokens than a gram has, null and empty ones belong to no class and have no partners. Repeated ids must have been
    resolved. Kinds never mix. Every pair at or above the threshold is found, whatever the sizes of groups.
    """

    def __init__(self, kinds: list[tuple[str, DataFrame, str, str, bool]], threshold: float, width: int = 5):
        parts = [set_classes(df, key, source, is_code, width).withColumn("kind", F.lit(kind)) for kind, df, key, source, is_code in kinds]
        made = parts[0]
        for p in parts[1:]:
            made = made.unionByName(p)
        # A record's number, fixed by being written; a class goes by the number of one of its records, so two classes never share one.
        written = Stored(made.withColumn("row", F.monotonically_increasing_id()))
        made = written.df
        same = ["kind", "n", "d1", "d2"]
        # Classes of several records; the others stand for themselves.
        copies = stored(made.groupBy(*same).agg(F.count("*").alias("_m"), F.min("row").alias("_rep")).where("_m > 1").drop("_m"))
        named = made.join(copies, same, "left").withColumn("cls", F.coalesce("_rep", "row"))
        self.members = stored(named.select("kind", "id", "cls"))
        self.copies = copies.select(F.col("_rep").alias("_c"))
        sets = Stored(named.where("cls = row").select("cls", "n", "grams"))
        written.drop()
        self.pairs = stored(similar_classes(sets.df, threshold))
        sets.drop()

    def all_pairs(self) -> DataFrame:
        """(kind, id_1, id_2), id_1 < id_2: every pair of similar records, copies included."""
        m = self.members
        one, two = m.select("kind", F.col("id").alias("x"), F.col("cls").alias("a")), m.select(F.col("id").alias("y"), F.col("cls").alias("b"))
        # Merged for the same reason as in similar_classes.
        across = self.pairs.hint("merge").join(one, "a").hint("merge").join(two, "b").select("kind", F.least("x", "y").alias("id_1"), F.greatest("x", "y").alias("id_2"))
        many = m.join(self.copies.select(F.col("_c").alias("cls")).hint("merge"), "cls", "left_semi")
        within = many.select("kind", "cls", F.col("id").alias("id_1")).join(many.select("cls", F.col("id").alias("id_2")), "cls").where("id_1 < id_2").select("kind", "id_1", "id_2")
        return across.unionByName(within)

    def groups(self) -> DataFrame:
        """(kind, id, group_id, n_copies, n_links): every record that has a partner or copy, its group (the least id of all linked directly or indirectly), how many records have its set, and links to other sets."""
        linked = connected_components(self.pairs, "a", "b")
        links = self.pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
        sizes = self.members.groupBy("cls").agg(F.count("*").alias("n_copies"))
        named = self.members.join(linked.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        ids = named.groupBy("component").agg(F.min("id").alias("group_id"), F.count("*").alias("_size")).where("_size > 1").select("component", "group_id")
        return named.join(ids, "component").join(sizes, "cls").join(links, "cls", "left").select("kind", "id", "group_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
