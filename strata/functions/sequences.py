"""Token sequences: parsing, n-grams, longest common subsequence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_tokens(c: Column | str) -> Column:
    """`[1;2;3]` as an array of int; `[]` is an empty array, a null or empty text null; a part that is no int becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    inner = F.regexp_replace(F.trim(c), r"^\[|\]$", "")
    return F.when(c.isNull() | (F.trim(c) == ""), F.lit(None)).when(F.trim(inner) == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(inner, ";"), lambda x: F.trim(x).try_cast("int")))


def gram_digests(c: Column | str, n: int) -> Column:
    """The different runs of n tokens as 64-bit digests; empty for a null sequence or one shorter than n."""
    c = F.col(c) if isinstance(c, str) else c
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.xxhash64(*[F.get(c, (i + (k - 1)).cast("int")) for k in range(n)])))
    return F.when(F.size(c) >= n, grams).otherwise(F.array().cast("array<bigint>"))


#: Words of 64 places up to which sources are compared side by side; longer ones one by one.
MOST_WORDS = 8
_U = np.uint64


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit per place of `a` in whole numbers of any length (one step per token of b)."""
    places: dict = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | 1 << i
    everywhere = free = (1 << len(a)) - 1
    for token in b:
        hit = free & places.get(token, 0)
        free = (free + hit | free - hit) & everywhere
    return len(a) - free.bit_count()


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column laid end to end (a null is a value of its own) and the lists' lengths."""
    column = column.cast(pa.large_list(pa.int64()))
    return column.flatten().fill_null(1 << 32).to_numpy(zero_copy_only=False) + (1 << 31), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _side_by_side(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, words: int) -> np.ndarray:
    """LCS lengths of many pairs whose sources fit in `words`: all pairs take their step for the j-th token of b together."""
    pair_a, pair_b = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)
    place = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
    # Where each token of each source stands, as bits.
    key = pair_a << 34 | a
    order = np.argsort(key, kind="stable")
    key, word = key[order], place[order] >> 6
    token_starts = np.concatenate([[True], key[1:] != key[:-1]])
    row = np.cumsum(token_starts) - 1
    masks = np.zeros((int(row[-1]) + 2, words), np.uint64)
    cells = np.flatnonzero(token_starts | np.concatenate([[True], word[1:] != word[:-1]]))
    masks[row[cells], word[cells]] = np.bitwise_or.reduceat(_U(1) << (place[order] & 63).astype(np.uint64), cells)
    known, wanted = key[token_starts], pair_b << 34 | b
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    at = np.where(known[at] == wanted, at, len(masks) - 1)
    # Pairs with the longest b first, so that those still going are the first ones.
    by_length = np.argsort(-m, kind="stable")
    start, left = (np.cumsum(m) - m)[by_length], m[by_length]
    free = np.full((words, len(n)), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(int(m.max())):
        going = int(np.searchsorted(-left, -j, "left"))
        v = free[:, :going]
        hit = v & masks[at[start[:going] + j]].T
        total = v + hit
        over = total < v
        for w in range(1, words):
            carried = total[w] + over[w - 1]
            over[w] |= carried < total[w]
            total[w] = carried
        free[:, :going] = total | (v - hit)
    out = np.empty(len(n), np.int64)
    out[by_length] = np.bitwise_count(~free).sum(0)
    # Places beyond a source's end have no bits, so they stay free.
    return out


def lcs_lengths(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """LCS length of each pair; a and b are laid end to end, n and m are their lengths."""
    out = np.zeros(len(n), np.int64)
    words = (n + 63) // 64
    pair_a, pair_b = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)
    for w in np.unique(words[(n > 0) & (m > 0)]):
        some = np.flatnonzero((words == w) & (m > 0))
        if w > MOST_WORDS:
            first_a, first_b = np.cumsum(n) - n, np.cumsum(m) - m
            for i in some:
                out[i] = lcs_length(a[first_a[i] : first_a[i] + n[i]].tolist(), b[first_b[i] : first_b[i] + m[i]].tolist())
            continue
        chosen = np.zeros(len(n), bool)
        chosen[some] = True
        out[some] = _side_by_side(a[chosen[pair_a]], n[some], b[chosen[pair_b]], m[some], int(w))
    return out


def round_like_python(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounds the exact binary values half to even, each different value once; built-in roundings of the decimal text do not."""
    values, where = np.unique(x, return_inverse=True)
    return np.array([round(v, digits) for v in values.tolist()], np.float64)[where]


def compare_sequences(pairs: DataFrame, keys: list[str], source: str, target: str, least: float, digits: int = 2) -> DataFrame:
    """(keys, raw_similarity, similarity): pairs whose LCS covers at least `least` of the source, unrounded and rounded to `digits`.

    A null or empty source has no similarity. Numpy over Arrow batches, in slices of a bounded number of tokens.
    """
    types = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = sum(pc.fill_null(pc.list_value_length(whole.column(len(keys) + i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            part = (np.cumsum(sizes) - sizes) // 1_000_000
            edges = np.flatnonzero(np.diff(part)) + 1
            for low, high in zip([0, *edges], [*edges, whole.num_rows]):
                batch = whole.slice(low, high - low)
                (a, n), (b, m) = _flat(batch.column(len(keys))), _flat(batch.column(len(keys) + 1))
                raw = lcs_lengths(a, n, b, m) / np.maximum(n, 1)
                at = np.flatnonzero((raw >= least) & (n > 0))
                out = [batch.column(i).take(pa.array(at)) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*out, pa.array(raw[at]), pa.array(round_like_python(raw[at], digits))], names=[*keys, "raw_similarity", "similarity"])

    return pairs.select(*keys, source, target).mapInArrow(run, f"{types}, raw_similarity double, similarity double")


def minhash_band_rows(sequences: DataFrame, key: str, grams: str, bands: int, rows: int) -> DataFrame:
    """(key, band, value): a 64-bit digest per band of minhashes of each set of gram digests; none for an empty set.

    Numpy over Arrow batches: one multiplication and one segmented minimum per hash function.
    """
    odd = np.random.default_rng(7).integers(1, 1 << 63, (2, bands * rows), np.uint64) | _U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                values, n = _flat(batch.column(1))
                some = np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[some]
                g = values.view(np.uint64)
                value = np.zeros((bands, len(some)), np.uint64)
                for i in range(bands * rows if len(some) else 0):
                    h = (g ^ odd[1, i]) * odd[0, i]
                    h ^= h >> _U(29)
                    value[i // rows] = (value[i // rows] ^ np.minimum.reduceat(h, starts)) * _U(0x9E3779B97F4A7C15)
                names = batch.column(0).take(pa.array(np.tile(some, bands)))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.repeat(np.arange(bands, dtype=np.int32), len(some))), pa.array(value.reshape(-1).view(np.int64))], names=[key, "band", "value"])

    return sequences.select(key, grams).mapInArrow(run, f"`{key}` {sequences.schema[key].dataType.simpleString()}, band int, value long")


def lcs_native(a: Column, b: Column) -> Column:
    """LCS length in built-in functions; for short sequences and tests, since it copies arrays for every token."""
    zero = F.transform(F.sequence(F.lit(0), F.size(a)), lambda _: F.lit(0))

    def row(before: Column, token: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(a)),
            F.array(F.lit(0)),
            lambda r, i: F.concat(r, F.array(F.when(F.get(a, i - 1) == token, F.get(before, i - 1) + 1).otherwise(F.greatest(F.get(before, i), F.get(r, i - 1))))),
        )

    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.element_at(F.aggregate(b, zero, row), -1)).otherwise(0)
