"""Passages of held-out test items inside a training corpus, by suffix arrays over shards (problem 8).

Test items are few at any corpus size and travel to the shards; the corpus is read once and never shuffled. In each shard all
texts become one stream of folded letters, and its suffixes are put in order: those whose first letters begin some test
suffix, as no other can be met by a search. Every test suffix is then searched by bisection: for its next 24 words (a verbatim
leak, followed letter by letter to its end), and for its next few words (seeds of an edited leak, which an alignment of the
words then confirms or not).

Letters are compared eight at a time, as one number (four where the test items have over 254 different letters), so that
ordering and bisection run in numpy for all suffixes at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.folding import fold_word, streams
from pagemill.runtime import map_arrow

_SPLIT = re.compile(r"[-‐‑¬­][^\S\r\n]*(?:\r\n|\r|\n)\s*")
#: Letters of scripts that write no blanks: each counts as a word.
_UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-鿿"
_PARTS = re.compile(f"[{_UNSPACED}]|[^{_UNSPACED}]+")
#: Letters of texts that make a shard, and letters of test items that are searched for together.
CHUNK, PART = 4_000_000, 16_000_000
#: Words of a seed of an edited leak.
SEED = 6
_HASH_BITS = 22


def words_of(text: str) -> list[str]:
    """Folded words of a text, those split at a line end put together; letters of scripts without blanks one by one."""
    folded = (f for w in _SPLIT.sub("", text).split() if (f := fold_word(w)))
    return [p for f in folded for p in ([f] if f.isascii() else _PARTS.findall(f))]


class Letters:
    """Streams of letters as numbers of `per` letters each, the first one highest; 0 stands for the end of a text."""

    def __init__(self, points: np.ndarray):
        known = np.unique(points)
        self.bits, self.per = (8, 8) if len(known) < 255 else (16, 4) if len(known) < 65535 else (32, 2)
        self.code = np.zeros(0x110000, np.uint32)  # letters that no test item has are ends, too: no match can pass them
        self.code[known] = np.arange(1, len(known) + 1)

    def joined(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all texts with a 0 after each, and where each text begins; the last entry is the end."""
        points, ends = streams(texts)
        sizes = np.diff(ends, prepend=0)
        out = np.zeros(len(points) + len(texts), np.uint32)
        out[np.arange(len(points)) + np.repeat(np.arange(len(texts)), sizes)] = self.code[points]
        return out, np.concatenate([[0], (sizes + 1).cumsum()])

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """For each position the number of its next `per` letters; zeros follow the last."""
        out = np.zeros(len(codes) + self.per, np.uint64)
        wide = codes.astype(np.uint64)
        for i in range(min(self.per, len(codes))):
            out[: len(codes) - i] |= wide[i:] << np.uint64(self.bits * (self.per - 1 - i))
        return out

    def mask(self, letters: np.ndarray) -> np.ndarray:
        """Numbers whose highest `letters` letters are all ones, 0 to `per` of them."""
        table = np.array([((1 << self.bits * n) - 1) << self.bits * (self.per - n) for n in range(self.per + 1)], np.uint64)
        return table[np.clip(letters, 0, self.per)]

    def whole(self, keys: np.ndarray) -> np.ndarray:
        """Which numbers hold no end of a text."""
        good = np.ones(len(keys), bool)
        for i in range(self.per):
            good &= (keys >> np.uint64(self.bits * i)) & np.uint64((1 << self.bits) - 1) > 0
        return good

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many first letters two numbers share before one of them ends."""
        out, going = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for i in range(self.per - 1, -1, -1):
            x = (a >> np.uint64(self.bits * i)) & np.uint64((1 << self.bits) - 1)
            going &= (x == (b >> np.uint64(self.bits * i)) & np.uint64((1 << self.bits) - 1)) & (x > 0)
            out += going
        return out


class Members:
    """A set of numbers, asked through a bitmap of hashes first."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.seen = np.zeros(1 << _HASH_BITS, bool)
        self.seen[self._hash(self.keys)] = True

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _HASH_BITS)).astype(np.int64)

    def within(self, keys: np.ndarray) -> np.ndarray:
        """Places of the given numbers that are in the set."""
        at = np.flatnonzero(self.seen[self._hash(keys)])
        found = np.minimum(np.searchsorted(self.keys, keys[at]), max(0, len(self.keys) - 1))
        return at[self.keys[found] == keys[at]] if len(self.keys) else at[:0]


class Items:
    """The test passages and their suffixes that begin with a word."""

    def __init__(self, rows: list[tuple[int, str | None]], verbatim: int, per_edit: int):
        kept = [(item, w) for item, passage in rows if item is not None and (w := words_of(passage or ""))]
        self.ids = [item for item, _ in kept]
        self.words = [w for _, w in kept]
        passages = [" ".join(w) for w in self.words]
        self.letters = Letters(streams(passages)[0])
        codes, begins = self.letters.joined(passages)
        self.keys = self.letters.keys(codes)
        self.edits = [len(w) // per_edit for w in self.words]
        #: Words of a seed: SEED, those of a verbatim run, or as many as e edits must leave in a row somewhere in a passage of n words.
        self.seeds = [min(SEED, verbatim, -(-(len(w) - e) // (e + 1))) for w, e in zip(self.words, self.edits, strict=True)]
        #: Seeds that e scattered edits cannot all destroy.
        self.need = [max(1, len(w) - k + 1 - e * k) for w, k, e in zip(self.words, self.seeds, self.edits, strict=True)]
        #: Where each word of each passage begins and the last one ends, in letters.
        self.starts = [np.concatenate([[0], np.cumsum([len(x) for x in w])]) for w in self.words]
        item, word, seed, long = [], [], [], []
        for i, (starts, k) in enumerate(zip(self.starts, self.seeds, strict=True)):
            n = len(starts) - 1
            last = np.arange(n - k + 1)
            item.append(np.full(len(last), i))
            word.append(last)
            seed.append(starts[last + k] - starts[last])
            long.append(np.where(last + verbatim <= n, starts[np.minimum(last + verbatim, n)] - starts[last], 0))
        join = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)])
        #: For each suffix: its item, its first word, the letters of its seed and of its verbatim run (0 if too short for one).
        self.item, self.word, self.seed, self.long = join(item), join(word), join(seed), join(long)
        self.begin = begins[self.item] + join([s[: len(s) - k] for s, k in zip(self.starts, self.seeds, strict=True)]) if len(self.item) else self.item
        self.all = Members(self.keys[:-1])

    @cached_property
    def firsts(self) -> list[tuple[np.uint64, Members]]:
        """For each number of first letters that seeds have, at most `per`: its mask and the suffixes' first letters."""
        sizes = np.minimum(self.seed, self.letters.per)
        masks = self.letters.mask(sizes)
        return [(m, Members(self.keys[self.begin[masks == m]] & m)) for m in np.unique(masks)]


class SuffixArray:
    """The suffixes of a shard that begin like a test suffix, in order as far as a test suffix can reach."""

    def __init__(self, keys: np.ndarray, items: Items):
        self.keys, self.items = keys, items
        per = items.letters.per
        found = [members.within(keys[:-per] & mask) for mask, members in items.firsts]
        at = found[0] if len(found) == 1 else np.unique(np.concatenate([*found, np.zeros(0, np.int64)]))
        order = np.argsort(keys[at])
        self.at = at[order]
        first = keys[self.at]
        group = np.concatenate([[0], (first[1:] != first[:-1]).cumsum()]) if len(first) else np.zeros(0, np.int64)
        self._refine(np.arange(len(first)), group, first, per)

    def _refine(self, rows: np.ndarray, group: np.ndarray, key: np.ndarray, depth: int) -> None:
        """Orders suffixes that are equal so far by their next letters, again and again. Those that have left every test suffix
        behind, or ended, need no more order: a search cannot tell them apart."""
        per = self.items.letters.per
        while len(rows):
            tied = np.zeros(len(rows), bool)
            same = group[1:] == group[:-1]
            tied[1:] |= same
            tied[:-1] |= same
            known = np.zeros(len(rows), bool)
            known[self.items.all.within(key)] = True
            tied &= known & self.items.letters.whole(key)
            rows, group = rows[tied], group[tied]
            key = self.keys[self.at[rows] + depth]
            order = np.lexsort((key, group))
            self.at[rows] = self.at[rows[order]]  # a group's rows lie in a row: they keep their places
            key, old = key[order], group[order]
            group = np.concatenate([[0], ((key[1:] != key[:-1]) | (old[1:] != old[:-1])).cumsum()]) if len(rows) else old
            depth += per

    def span(self, begin: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each test suffix the part of the array whose suffixes begin with so many of its letters, by bisection."""
        per = self.items.letters.per
        low, high = np.zeros(len(begin), np.int64), np.full(len(begin), len(self.at))
        depth = 0
        while True:
            going = np.flatnonzero((letters > depth) & (low < high))
            if not len(going):
                return low, high
            mask = self.items.letters.mask(letters[going] - depth)
            wanted = self.items.keys[begin[going] + depth] & mask
            a = self._bisect(low[going], high[going], wanted, depth, False)
            b = self._bisect(a, high[going], wanted | ~mask, depth, True)
            low[going], high[going] = a, b
            depth += per

    def _bisect(self, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, depth: int, beyond: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) >> 1
            own = self.keys[self.at[middle] + depth]
            right = own <= wanted[open_] if beyond else own < wanted[open_]
            low[open_] = np.where(right, middle + 1, low[open_])
            high[open_] = np.where(right, high[open_], middle)
        return low

    def met(self, suffixes: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffix, position) of all places where a test suffix stands with so many of its letters."""
        low, high = self.span(self.items.begin[suffixes], letters)
        each = high - low
        to = each.cumsum()
        rows = np.arange(int(to[-1]) if len(to) else 0) + np.repeat(low - (to - each), each)
        return np.repeat(suffixes, each), self.at[rows]

    def follow(self, suffixes: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """How many letters each test suffix goes on to match at its position."""
        letters = self.items.letters
        size = np.zeros(len(suffixes), np.int64)
        going = np.arange(len(suffixes))
        while len(going):
            step = letters.shared(self.items.keys[self.items.begin[suffixes[going]] + size[going]], self.keys[positions[going] + size[going]])
            size[going] += step
            going = going[step == letters.per]
        return size


def fits(words: list[str], passage: list[str], most: int) -> bool:
    """Whether the passage stands somewhere in the words with at most so many words replaced, dropped or added."""
    names: dict[str, int] = {}
    a = np.array([names.setdefault(w, len(names)) for w in passage])
    b = np.array([names.get(w, -1) for w in words])
    n = len(b)
    row = np.zeros(n + 1, np.int64)
    steps = np.arange(n + 1)
    for i, w in enumerate(a.tolist(), 1):
        new = np.empty(n + 1, np.int64)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (b != w), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > most:
            return False
    return bool(row.min() <= most)


def place_of(text: str, letters: int) -> int:
    """The character of a text at which its folded letter of this number stands."""
    for at, c in enumerate(text):
        letters -= len(fold_word(c))
        if letters < 0:
            return at
    return len(text)


def search(texts: list[str], items: Items) -> Iterator[tuple[int, int, str, int, int, int]]:
    """Leaks in a shard: (text number, item number, kind, words, character of the text, word of the passage)."""
    if not texts or not items.ids:
        return
    codes, bounds = items.letters.joined(texts)
    array = SuffixArray(items.letters.keys(codes), items)
    suffix, place = array.met(np.flatnonzero(items.long > 0), items.long[items.long > 0])
    words = np.zeros(len(suffix), np.int64)
    size = array.follow(suffix, place)
    for i in range(len(suffix)):
        starts, first = items.starts[items.item[suffix[i]]], int(items.word[suffix[i]])
        words[i] = np.searchsorted(starts, starts[first] + size[i], "right") - 1 - first
    text = np.searchsorted(bounds, place, "right") - 1
    item = items.item[suffix]
    seen: set[tuple[int, int]] = set()
    for i in np.lexsort((place, -words, item, text)).tolist():  # the longest match of each pair, the first of equal ones
        pair = int(text[i]), int(item[i])
        if pair not in seen:
            seen.add(pair)
            yield *pair, "verbatim", int(words[i]), place_of(texts[pair[0]], int(place[i] - bounds[pair[0]])), int(items.word[suffix[i]])
    suffix, place = array.met(np.arange(len(items.item)), items.seed)
    text = np.searchsorted(bounds, place, "right") - 1
    pair = text * len(items.ids) + items.item[suffix]
    each, first, which = np.unique(pair, return_index=True, return_inverse=True)
    _, once = np.unique(np.stack([which, items.word[suffix]]), axis=1, return_index=True) if len(which) else (None, np.zeros(0, np.int64))
    different = np.bincount(which[once], minlength=len(each))  # seeds of the item that stand in the text, wherever
    order = np.lexsort((place, which))
    least = order[np.searchsorted(which[order], np.arange(len(each)))] if len(each) else first
    split: dict[int, list[str]] = {}
    for i in np.flatnonzero(different >= np.array(items.need)[each % len(items.ids)]).tolist():
        d, k = divmod(int(each[i]), len(items.ids))
        if (d, k) in seen:
            continue
        if d not in split:
            split = {d: words_of(texts[d])}
        if fits(split[d], items.words[k], items.edits[k]):
            j = least[i]
            yield d, k, "edited", len(items.words[k]), place_of(texts[d], int(place[j] - bounds[d])), int(items.word[suffix[j]])


_items: dict[tuple, Items] = {}


def items_of(sent, verbatim: int, per_edit: int) -> Items:
    """The test items of a broadcast, prepared once in each Python worker."""
    key = (sent.value[0], verbatim, per_edit)
    if key not in _items:
        if len(_items) > 1:
            _items.clear()
        _items[key] = Items(sent.value[1], verbatim, per_edit)
    return _items[key]


def _parts(passages: DataFrame, item: str, passage: str) -> Iterator[list[tuple]]:
    """The test items in parts of at most PART letters (or one longer item); one part is on the driver at a time."""
    rows, size = [], 0
    for r in passages.select(item, passage).distinct().toLocalIterator():
        rows.append(tuple(r))
        size += len(r[1] or "")
        if size >= PART:
            yield rows
            rows, size = [], 0
    yield rows


def find_leaks(corpus: DataFrame, key: str, text: str, passages: DataFrame, item: str, passage: str, verbatim: int = 24, per_edit: int = 10) -> DataFrame:
    """Leaks (`key`, `item`, kind 'verbatim' | 'edited', words INT, text_at INT, word_at INT): `verbatim` words of a passage in
    a row, or a whole passage with at most one word in `per_edit` replaced, dropped or added.

    `words` is the longest verbatim match of the pair in words (the passage's number of words for an edited one), `text_at`
    the character of the text where it begins, `word_at` the word of the passage, both from 0; for an edited leak those of
    the first seed. Case, punctuation, accents, spacing, line breaks, words split at line ends and look-alike letters make no
    difference. In scripts without blanks each letter is a word. Null, empty and letterless texts and passages have no
    leaks. A passage shorter than `verbatim` words leaks only as a whole. Each pair comes once, however often rows repeat.
    A suite of any size is searched for: over PART letters in several passes over the corpus.
    """
    kinds = dict(corpus.dtypes)[key], dict(passages.dtypes)[item]
    source = corpus.select(corpus[key].alias("key"), corpus[text].alias("text"))
    names = ["key", "item", "kind", "words", "text_at", "word_at"]

    def passes() -> Iterator[DataFrame]:
        for n, rows in enumerate(_parts(passages, item, passage)):
            rows.sort(key=lambda r: (r[0] is None, r[0], r[1] or ""))
            sent = corpus.sparkSession.sparkContext.broadcast(((n, len(rows), hash(tuple(rows))), rows))
            yield map_arrow(source, lambda batches, sent=sent: _run(batches, sent, verbatim, per_edit), f"key {kinds[0]}, item {kinds[1]}, kind string, words int, text_at int, word_at int")

    found = reduce(DataFrame.unionAll, passes())
    once = found.groupBy("key", "item").agg(F.max(F.struct("kind", "words", (-F.col("text_at")).alias("before"), "word_at")).alias("m"))
    return once.select(once["key"].alias(key), once["item"].alias(item), "m.kind", "m.words", (-F.col("m.before")).alias("text_at"), "m.word_at").toDF(key, item, *names[2:])


def _run(batches: Iterator[pa.RecordBatch], sent, verbatim: int, per_edit: int) -> Iterator[pa.RecordBatch]:
    items = items_of(sent, verbatim, per_edit)
    types: list[pa.DataType] = []

    def out(keys: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        found = [(keys[d], items.ids[k], *rest) for d, k, *rest in search(texts, items)]
        if found:
            columns = list(zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], types[0]), pa.array(columns[1]), pa.array(columns[2]), *(pa.array(c, pa.int32()) for c in columns[3:])], ["key", "item", "kind", "words", "text_at", "word_at"]
            )

    keys, texts, size = [], [], 0
    for batch in batches:
        types = [c.type for c in batch.columns]
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if t:
                keys.append(k)
                texts.append(t)
                size += len(t)
            if size >= CHUNK:
                yield from out(keys, texts)
                keys, texts, size = [], [], 0
    yield from out(keys, texts)


def remove_leaks(corpus: DataFrame, key: str, leaks: DataFrame) -> DataFrame:
    """The corpus rows without a leak; rows with a null key stay."""
    return corpus.join(leaks.select(key).distinct(), key, "left_anti")
