"""Splitting of long texts at natural boundaries by lexical cohesion (problem 9).

The words before and after a place are compared as blocks; where their similarity has a valley, the topic changes. Each piece
ends at the deepest valley of its size window, measured at the natural boundaries there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tokens import TOKENIZERS, encoder, vocabulary
from pagemill.runtime import map_arrow

CHARACTER, WORD, SENTENCE, LINE, PARAGRAPH = range(5)
KINDS = ("character", "word", "sentence", "line", "paragraph")
_WORD = re.compile(r"\w+")
_PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*")
_LINE = re.compile(r"\r\n|\r|\n")
_SENTENCE = re.compile(r"(?:[.!?…][\"'”’»)\]]*(?=\s)|[。！？][」』”’）]*)")
#: Width of the hashed word counts that blocks are compared by, and words in a block on either side of a boundary.
WIDTH, BLOCK = 257, 60


@cache
def _blank() -> np.ndarray:
    return np.array([chr(p).isspace() for p in range(0x10000)])


def boundary_levels(text: str) -> np.ndarray:
    """For each character offset 0..len(text), the strength of a cut just before that character."""
    level = np.full(len(text) + 1, CHARACTER, np.int8)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    blank = _blank()[np.where(points < 0x10000, points, 0)]
    level[:-1][blank] = WORD  # a blank goes with the word after it, as the tokenizer has it, or stays behind
    level[1:][blank] = WORD
    for m in _SENTENCE.finditer(text):
        level[m.end()] = SENTENCE
    for m in _LINE.finditer(text):
        level[m.start()] = level[m.end()] = LINE
    for m in _PARAGRAPH.finditer(text):
        level[m.start()] = level[m.end()] = PARAGRAPH
    return level


def valley_depths(text: str, offsets: np.ndarray) -> np.ndarray:
    """Depth of the cohesion valley at each of the ascending character offsets: how far the similarity of the word blocks
    before and after it lies below the next peaks on both sides."""
    depth = np.zeros(len(offsets))
    if not len(offsets):
        return depth
    begin = max(0, int(offsets[0]) - 12 * BLOCK)
    part = text[begin : int(offsets[-1]) + 12 * BLOCK].lower()
    if len(part) != min(len(text), int(offsets[-1]) + 12 * BLOCK) - begin:  # a letter whose small form is longer
        part = text[begin : int(offsets[-1]) + 12 * BLOCK]
    found = [(m.start(), crc32(m.group().encode("utf-8", "replace")) % WIDTH) for m in _WORD.finditer(part)]
    if not found:
        return depth
    at, codes = np.array(found).T
    sums = np.zeros((len(found) + 1, WIDTH), np.float32)
    sums[np.arange(1, len(found) + 1), codes] = 1
    sums = sums.cumsum(0)
    mid = np.searchsorted(at, offsets - begin)
    left = sums[mid] - sums[np.maximum(mid - BLOCK, 0)]
    right = sums[np.minimum(mid + BLOCK, len(found))] - sums[mid]
    norm = np.sqrt(np.einsum("ij,ij->i", left, left) * np.einsum("ij,ij->i", right, right))
    likeness = (np.einsum("ij,ij->i", left, right) / np.maximum(norm, 1e-9)).tolist()
    return np.array([2 * -own + _peak(likeness, i, -1) + _peak(likeness, i, 1) for i, own in enumerate(likeness)])


def _peak(values: list[float], i: int, step: int) -> float:
    """The value where a climb from place i to one side ends."""
    while 0 <= i + step < len(values) and values[i + step] >= values[i]:
        i += step
    return values[i]


def cut(text: str, lengths: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int, float]]:
    """Pieces of a text whose tokens have these byte lengths: token span (begin, end), kind and valley depth of its end.

    Each end is the deepest cohesion valley in the second half of what the limit allows, measured at the ends of paragraphs,
    lines and sentences there, or else at word ends; where that half has none, in the whole window; where that has none
    either, it is the last character end. Of equally deep valleys the stronger kind counts, of these the later. A
    token end inside a character is no boundary; only where no token ends between characters is the text cut at the
    limit. The last piece has the kind -1.
    """
    n = len(lengths)
    if n <= limit:
        return [(0, n, -1, 0.0)]
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    opens = (raw & 0xC0) != 0x80
    to_char = np.concatenate([[0], np.cumsum(opens)])
    ends = np.concatenate([[0], np.cumsum(lengths)])
    whole = np.concatenate([opens, [True]])[ends]
    chars = to_char[ends]
    strength = np.where(whole, boundary_levels(text)[chars], -1)
    spans, begin, end = [], 0, 0
    while True:
        most = min(begin + limit, n)
        if most == n:
            spans.append((begin, n, -1, 0.0))
            return spans
        for least in (begin + limit // 2, begin + overlap + 1):
            window = np.arange(max(end + 1, least), most + 1)
            strongest = strength[window].max()
            at = window[strength[window] >= min(strongest, SENTENCE)] if strongest >= WORD else window[:0]
            if len(at):
                break
        if len(at):
            depth = valley_depths(text, chars[at])
            best = np.lexsort((at, strength[at], depth.round(3)))[-1]
            end, kind, deep = int(at[best]), int(strength[at[best]]), float(depth[best])
        else:
            at = window[strength[window] == CHARACTER]
            end, kind, deep = int(at[-1]) if len(at) else most, CHARACTER, 0.0
        spans.append((begin, end, kind, deep))
        begin = end - overlap


def split_texts(
    df: DataFrame, key: str, text: str, limit: int = 1024, overlap: int = 64, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS
) -> DataFrame:
    """Pieces of the texts of more than `limit` tokens: (`key`, piece INT from 1, first_token INT, ids ARRAY<INT>, boundary
    STRING, depth DOUBLE).

    `boundary` is the kind of place where the piece ends ('paragraph', 'line', 'sentence', 'word', 'character', or 'end' for
    the last one), `depth` the depth of the cohesion valley there.

    A piece has at most `limit` ids and each after the first begins with the last `overlap` ids of the one before. Texts
    within the limit, null and empty ones give no rows: they stay whole. Repeated rows are each split. A text of at most
    `limit` bytes cannot have more tokens and is left out in the scan; the others are encoded where they are read,
    without a shuffle.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    ranks = vocabulary(df, tokenizer, folder)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            ids, counts = e.encode(texts)
            to = counts.cumsum()
            rows, pieces, firsts, parts, sizes, kinds, depths = [], [], [], [], [], [], []
            for i in np.flatnonzero(counts > limit).tolist():
                own = ids[to[i] - counts[i] : to[i]]
                for k, (a, b, kind, depth) in enumerate(cut(texts[i], e.lengths_of[own], limit, overlap), 1):
                    rows.append(i)
                    pieces.append(k)
                    firsts.append(a)
                    parts.append(own[a:b])
                    sizes.append(b - a)
                    kinds.append(KINDS[kind] if kind >= 0 else "end")
                    depths.append(depth)
            if rows:
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))
                columns = [keys.take(pa.array(rows)), pa.array(pieces, pa.int32()), pa.array(firsts, pa.int32()), lists, pa.array(kinds), pa.array(depths, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "piece", "first_token", "ids", "boundary", "depth"])

    long = df.select(df[key].alias("key"), df[text].alias("text")).filter(F.octet_length("text") > limit)
    return map_arrow(long, run, f"key {kind}, piece int, first_token int, ids array<int>, boundary string, depth double").withColumnRenamed("key", key)
