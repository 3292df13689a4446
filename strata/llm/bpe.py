"""Encoding of a corpus by a byte-level BPE tokenizer: merges compiled into a lazily determinised transducer.

A vocabulary's merges define, for every byte string, one sequence of tokens. Two facts make this a transducer that
reads a byte at a time. A sequence of tokens is the encoding of its bytes if and only if each two neighbours are the
encoding of theirs; and the encoding of a prefix ending with token t is the encoding of that prefix without t's bytes,
followed by t. So from the last tokens of the prefixes within one token's length, the last token of the next prefix
follows. A position is *live* if the bytes behind it may still begin a longer token. Tokens before the last position that
all live positions' paths share are final and are emitted; the bytes behind it, fewer than two tokens' lengths in practice
and bounded by the lookahead the vocabulary needs, are pending. A state is (last final token, pending bytes). States and
transitions are made when first met and kept, so common text runs through a table.

Texts are cut first by the tokenizer's published pattern. A cut word's tokens are looked up if the word has been met;
else they come from the transducer.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Published with the vocabulary: how text is cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for ASCII texts, in classes that the faster engine has.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"""
VOCABULARY = os.environ.get("STRATA_BPE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: Bounds of a worker's memory: beyond them the tables start anew, which costs time only.
MAX_STATES, MAX_WORDS, LONG_WORD = 200_000, 300_000, 64
#: Bytes of a word after which the states are counted again.
STRETCH = 4096


class Transducer:
    """The transducer of a vocabulary {bytes: rank}, in which every single byte is a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: b for b, r in ranks.items()}
        self.begins = {t[:i] for t in ranks for i in range(1, len(t))}
        self.longest = max(map(len, ranks), default=1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[tuple[int, bytes], int] = {}
        self.keys: list[tuple[int, bytes]] = []
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.ends: list[tuple[int, ...] | None] = []
        self.start = self._state(-1, b"")

    def _state(self, last: int, pending: bytes) -> int:
        key = (last, pending)
        n = self.numbers.get(key)
        if n is None:
            n = self.numbers[key] = len(self.keys)
            self.keys.append(key)
            self.steps.append({})
            self.ends.append(None)
        return n

    def merge(self, word: bytes) -> list[int]:
        """The definition: merge the adjacent pair of least rank until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            least, at = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if least == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether tokens a, b are the encoding of their bytes."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > 4 * MAX_STATES:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return got

    def _paths(self, last: int, s: bytes) -> list[int]:
        """For each prefix of s that the encoding may end, the last token; -1 if none."""
        ends = [last] + [-1] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - self.longest), j):
                if i and ends[i] < 0:
                    continue
                t = self.ranks.get(s[i:j])
                if t is not None and (ends[i] < 0 or self.neighbours(ends[i], t)) and (j - i == 1 or self.merge_is(t)):
                    ends[j] = t
                    break
        return ends

    def merge_is(self, t: int) -> bool:
        """Whether a token's bytes encode as that token (not so for a rank that no merges reach)."""
        got = self.pairs.get((t, -1))
        if got is None:
            got = self.pairs[t, -1] = self.merge(self.tokens[t]) == [t]
        return got

    def _back(self, ends: list[int], j: int) -> list[int]:
        path = [j]
        while j:
            j -= len(self.tokens[ends[j]])
            path.append(j)
        return path[::-1]

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, pending = self.keys[state]
        s = pending + bytes([byte])
        ends = self._paths(last, s)
        shared: list[int] | None = None
        for j in range(len(s) + 1):
            if j == len(s) or (s[j:] in self.begins and (j == 0 or ends[j] >= 0)):
                path = self._back(ends, j)
                if shared is None:
                    shared = path
                else:
                    k = 0
                    while k < min(len(shared), len(path)) and shared[k] == path[k]:
                        k += 1
                    shared = shared[:k]
        assert shared
        cut = shared[-1]
        out = tuple(ends[j] for j in shared[1:])
        got = (self._state(ends[cut] if cut else last, s[cut:]), out)
        self.steps[state][byte] = got
        return got

    def _end(self, state: int) -> tuple[int, ...]:
        last, pending = self.keys[state]
        ends = self._paths(last, pending)
        got = self.ends[state] = tuple(ends[j] for j in self._back(ends, len(pending))[1:])
        return got

    def encode(self, word: bytes) -> list[int]:
        if len(self.keys) > MAX_STATES:
            self._reset()
        out: list[int] = []
        at, steps = self.start, self.steps
        for byte in word if len(word) <= STRETCH else word[:STRETCH]:
            at, emitted = steps[at].get(byte) or self._step(at, byte)
            if emitted:
                out += emitted
        for first in range(STRETCH, len(word), STRETCH):
            if len(self.keys) > MAX_STATES:  # a long word goes on from the same state in an empty table
                here = self.keys[at]
                self._reset()
                at, steps = self._state(*here), self.steps
            for byte in word[first : first + STRETCH]:
                at, emitted = steps[at].get(byte) or self._step(at, byte)
                if emitted:
                    out += emitted
        end = self.ends[at]
        out += self._end(at) if end is None else end
        return out


class _Words(dict):
    """Words met, numbered; their tokens lie one behind another in `flat`."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.used = self.count = 0
        self.flat, self.first, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def __missing__(self, word: str) -> int:
        ids = self.transducer.encode(word.encode())
        n, used = self.count, self.used
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        if n == len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        self.flat[used : used + len(ids)] = ids
        self.first[n], self.size[n] = used, len(ids)
        self.used, self.count = used + len(ids), n + 1
        if len(word) <= LONG_WORD:
            self[word] = n
        return n


class Encoder:
    """Encodes batches of texts by a vocabulary file of ranks."""

    _made: dict[str, Encoder] = {}

    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.transducer = Transducer(ranks)
        self.words = _Words(self.transducer)
        self.cut_ascii, self.cut = re.compile(ASCII_PATTERN).findall, regex.compile(PATTERN).findall
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int32)
        for b, r in ranks.items():
            self.lengths[r] = len(b)

    @classmethod
    def of(cls, vocabulary: str) -> Encoder:
        """One per worker and vocabulary, so that its tables last from task to task."""
        if vocabulary not in cls._made:
            cls._made[vocabulary] = cls(vocabulary)
        return cls._made[vocabulary]

    def pieces(self, text: str) -> list[str]:
        return self.cut_ascii(text) if text.isascii() else self.cut(text)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, pieces), np.int64, len(pieces))

    def _tidy(self) -> None:
        if self.words.count > MAX_WORDS:
            self.words.forget()

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; null and empty texts have none."""
        out = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                n = self.numbers(self.pieces(t))
                out[i] = self.words.size[n].sum()
                self._tidy()
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and the ids of all texts in a row."""
        sizes, parts = np.zeros(len(texts) + 1, np.int64), []
        for i, t in enumerate(texts):
            if t:
                n = self.numbers(self.pieces(t))
                parts.append(self.tokens_of(n))
                sizes[i + 1] = len(parts[-1])
                self._tidy()
        return np.cumsum(sizes), np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def tokens_of(self, numbers: np.ndarray) -> np.ndarray:
        size = self.words.size[numbers].astype(np.int64)
        past = np.cumsum(size)
        return self.words.flat[np.repeat(self.words.first[numbers] - (past - size), size) + np.arange(past[-1] if len(past) else 0)]


class Utf8Stream:
    """An incremental UTF-8 decoder: fed bytes, it gives the characters that are complete, U+FFFD for each maximal broken part."""

    def __init__(self) -> None:
        self.need, self.code, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.low, self.high = 0x80, 0xBF
                    self.code = self.code << 6 | b & 0x3F
                    self.need -= 1
                    if not self.need:
                        out.append(chr(self.code))
                    continue
                self.need, self.low, self.high = 0, 0x80, 0xBF
                out.append("�")
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.code = 2, b & 0x0F
                self.low, self.high = 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                self.need, self.code = 3, b & 0x07
                self.low, self.high = 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        broken, self.need = self.need > 0, 0
        return "�" if broken else ""


class Decoder:
    """Streaming decoder. Tokens that are whole characters pass straight through when no character is open."""

    _made: dict[str, Decoder] = {}

    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as f:
            self.tokens = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
        self.whole: dict[int, str] = {}
        for i, b in self.tokens.items():
            s = Utf8Stream()
            t = s.feed(b)
            if not s.need and "�" not in t:
                self.whole[i] = t

    @classmethod
    def of(cls, vocabulary: str) -> Decoder:
        if vocabulary not in cls._made:
            cls._made[vocabulary] = cls(vocabulary)
        return cls._made[vocabulary]

    def decode(self, ids) -> str:
        stream, out, whole = Utf8Stream(), [], self.whole
        for i in ids:
            t = whole.get(i) if not stream.need else None
            out.append(stream.feed(self.tokens[i]) if t is None else t)
        out.append(stream.end())
        return "".join(out)


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of every text, without special tokens. Null and empty texts have an empty list.

    One pass without a shuffle; whole texts of any length. Repeated keys give repeated rows, other columns are not read.
    """
    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for b in batches:
            for part in small(b):
                offsets, ids = encoder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, schema)


def small(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes, a row at least, so that long texts don't meet in memory."""
    rows = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def count_column(df: DataFrame, keep: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The `keep` columns and `n_tokens` of every text; null and empty texts have 0."""
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for b in batches:
            for part in small(b):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(encoder.count(part.column(len(keep)).to_pylist()))], names=[*keep, "n_tokens"])

    return df.select(*keep, text).mapInArrow(run, schema)


def decode_column(df: DataFrame, key: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text): texts from token ids; null ids give null."""
    schema = T.StructType([df.schema[key], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder.of(vocabulary)
        for b in batches:
            for part in small(b):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else decoder.decode(x) for x in part.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, schema)
