"""Splitting oversized texts at natural boundaries: agglomerative merging of atomic segments."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strata.llm.bpe import VOCABULARY, Encoder, small

LIMIT, OVERLAP = 2048, 64

#: Strength of a boundary by what begins there or ends before it; the stronger, the later it is merged away.
SECTION, UNIT, PARAGRAPH, LINE, SENTENCE, WORD, NONE = 6, 5, 4, 3, 2, 1, 0
_SECTION = re.compile(r"#{1,6} |-{3,}|={3,}|```")
_UNIT = re.compile(r"(?:async def|def|class|function|func|public|private|static|fn|impl|@)\b|@|diff |commit |\* |- |\d+\. |\|")
_SENTENCE = re.compile(r"""[.!?]["')\]]*$|[。！？]["'」』）]*$""")

#: Last characters of pieces that may bear on a boundary: white space, ends of sentences, closing marks.
_TELLING = frozenset(" \t\n\r\x0b\x0c\x85\xa0\u2028\u2029\u3000.!?。！？\"')]」』）" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x1C, 0x1D, 0x1E, 0x1F))))


def boundary_strengths(pieces: list[str]) -> np.ndarray:
    """For each cut piece of a text, the strength of the boundary before it.

    White space that holds a line end and the indentation of the next line belongs to the next line, a line end alone to
    the line before: a boundary lies before the former and behind the latter.
    """
    out = np.full(len(pieces), WORD, np.int8)
    out[:1] = NONE
    # Only pieces that end so can hold a line end or end a sentence; the others have boundaries between words.
    for i in [i for i, p in enumerate(pieces) if p[-1] in _TELLING or p[0] in "。！？"]:
        p = pieces[i]
        if i and p.isspace() and ("\n" in p or "\r" in p):
            if out[i] == WORD:
                out[i] = NONE
            ends = p[-1] in "\r\n"
            at = i + 1 if ends else i
            if at >= len(pieces):
                continue
            lines = len(re.findall(r"\r\n|\r|\n", p))
            # The next piece's first words, past white space.
            ahead = "".join(pieces[i + 1 : i + 6]).lstrip()
            after_line_end = ends and i + 1 < len(pieces) and not pieces[i + 1][:1].isspace()
            if _SECTION.match(ahead) and (lines > 1 or after_line_end):
                kind = SECTION
            elif _UNIT.match(ahead) and after_line_end:
                kind = UNIT
            elif lines > 1:
                kind = PARAGRAPH
            else:
                kind = LINE
            out[at] = max(out[at], kind)
        elif i and p[0] in "。！？" and i + 1 < len(pieces):
            if out[i] == WORD:
                out[i] = NONE
            out[i + 1] = max(out[i + 1], SENTENCE)
        if i + 1 < len(pieces) and pieces[i + 1][0] == " " and out[i + 1] == WORD and _SENTENCE.search(p):
            follows = pieces[i + 1]
            if not (follows.isspace() and ("\n" in follows or "\r" in follows)):
                out[i + 1] = SENTENCE
    return out


def _hard_cuts(lengths: np.ndarray, ids: np.ndarray, starts_char: np.ndarray, most: int) -> list[int]:
    """Sizes into which one unbroken piece's tokens are cut, at characters where that is possible."""
    sizes, at = [], 0
    n = len(lengths)
    while n - at > most:
        cut = at + most
        while cut > at + most // 2 and not starts_char[cut]:
            cut -= 1
        sizes.append(cut - at)
        at = cut
    sizes.append(n - at)
    return sizes


def merge_segments(sizes: list[int], strengths: list[int], most: int) -> list[int]:
    """Merges neighbouring segments, those at the weakest boundary first (of equal ones the pair that is smallest together,
    then the first), while their sizes sum to at most `most`. strengths[i] is that of the boundary before segment i.
    Returns the numbers of the segments that begin a piece.

    Adjacent pairs wait in a heap; a pair whose parts have since grown is put back with its new size, one that no
    longer fits is dropped for good, since sizes only grow.
    """
    n = len(sizes)
    size, left, right, alive = list(sizes), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(strengths[i], size[i - 1] + size[i], i) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        strength, together, i = heapq.heappop(heap)
        j = left[i]
        now = size[j] + size[i]
        if now > most:
            continue
        if now != together:
            heapq.heappush(heap, (strength, now, i))
            continue
        size[j] = now
        alive[i] = False
        right[j] = right[i]
        if right[i] < n:
            left[right[i]] = j
    return [i for i in range(n) if alive[i]]


def split_tokens(pieces: list[str], numbers: np.ndarray, encoder: Encoder, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """The pieces of a text as (first token, past token, first byte, past byte), of at most `limit` tokens with `overlap` repeated.

    The first of the atomic segments are joined until they hold `overlap` tokens, so every later piece can repeat as many.
    """
    ids = encoder.tokens_of(numbers)
    lengths = encoder.lengths[ids]
    bytes_at = np.concatenate([[0], np.cumsum(lengths)])
    counts = encoder.words.size[numbers]
    data = "".join(pieces).encode()
    raw = np.frombuffer(data, np.uint8)
    starts_char = np.concatenate([(raw[bytes_at[:-1]] & 0xC0) != 0x80, [True]])
    most = limit - overlap
    atom = max(1, most - overlap)
    kinds = boundary_strengths(pieces)
    sizes: list[int] = []
    strengths: list[int] = []
    at = 0
    # Atoms: pieces between boundaries of at least a sentence; longer ones are cut at words, words at characters.
    bounds = [0, *[i for i in range(1, len(pieces)) if kinds[i] >= SENTENCE], len(pieces)]
    for a, b in zip(bounds, bounds[1:]):
        whole = int(counts[a:b].sum())
        kind = int(kinds[a]) if a else NONE
        if whole <= atom:
            sizes.append(whole)
            strengths.append(kind)
            at += whole
            continue
        for i in range(a, b):
            for k, s in enumerate(_hard_cuts(lengths[at : at + counts[i]], ids, starts_char[at : at + counts[i] + 1], atom)):
                sizes.append(s)
                strengths.append(NONE if k else kind if i == a else int(kinds[i]))
                at += s
    head = 0
    while len(sizes) > 1 and sizes[0] < overlap:
        sizes[0] += sizes.pop(1)
        strengths.pop(1)
        head += 1
    starts = merge_segments(sizes, strengths, most)
    past = np.concatenate([[0], np.cumsum(sizes)])
    cuts = [int(past[i]) for i in starts] + [len(ids)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        first = max(0, a - overlap) if a else 0
        begin = int(bytes_at[first])
        while begin < len(raw) and raw[begin] & 0xC0 == 0x80:  # a character cut by the overlap stays whole in the piece before
            begin += 1
        out.append((first, b, begin, int(bytes_at[b])))
    return out


def split_documents(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, piece, first_token, past_token, n_tokens, boundary text) of every text of more than `limit` tokens.

    Tokens are those of the whole text. Piece k > 0 begins with the last `overlap` tokens of piece k - 1; no piece has more
    than `limit`; without the overlaps the pieces are the text. Where a text has no natural boundary, words are cut
    apart, and within a word characters. `text` of a piece leaves out a character that the overlap cuts. Texts of at
    most `limit` tokens, null and empty ones give no rows. No shuffle: each text is split where it is read.
    """
    if not 0 <= overlap * 3 < limit:
        raise ValueError("the overlap must be less than a third of the limit")
    names = [key, "piece", "first_token", "past_token", "n_tokens", "text"]
    kinds = [df.schema[key].dataType, T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), T.StringType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for b in batches:
            for part in small(b):
                rows: list[tuple] = []
                for i, t in enumerate(part.column(1).to_pylist()):
                    # A token has at least a byte; a text of fewer bytes than the limit can't exceed it.
                    if not t or len(t) * 4 <= limit:
                        continue
                    pieces = encoder.pieces(t)
                    numbers = encoder.numbers(pieces)
                    if int(encoder.words.size[numbers].sum()) > limit:
                        data = t.encode()
                        rows += [(i, k, a, z, z - a, data[p:q].decode()) for k, (a, z, p, q) in enumerate(split_tokens(pieces, numbers, encoder, limit, overlap))]
                    encoder._tidy()
                cols = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:5]], pa.array(cols[5], pa.string())], names=names)

    return df.select(key, text).mapInArrow(run, schema)
