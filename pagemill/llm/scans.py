"""Noise in the text of scanned pages, and its repair to continuous paragraphs (problem 4).

The corpus gives a frequency lexicon. Candidates for a doubtful word come from a symmetric-delete index over the lexicon's
shapes, in which characters that scanners confuse are one; a weighted edit distance with confusion pairs measures them, and
the counts of neighbouring words decide where both readings are words. Running titles repeat over a document's pages.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.folding import LOOKALIKES
from pagemill.llm.lookalikes import UNTOUCHED
from pagemill.runtime import map_arrow, written

#: What is printed, what scanners read instead, and the cost of that confusion.
CONFUSIONS = {
    ("e", "c"): 1.0, ("c", "e"): 1.0, ("a", "o"): 1.0, ("o", "a"): 1.2, ("i", "l"): 0.9, ("l", "i"): 0.9, ("n", "ri"): 0.9,
    ("t", "f"): 1.0, ("f", "t"): 1.2, ("i", "!"): 0.5, ("l", "!"): 0.6, ("s", "5"): 0.5, ("o", "0"): 0.5, ("u", "ii"): 0.9,
    ("l", "|"): 0.5, ("i", "|"): 0.6, ("l", "1"): 0.5, ("i", "1"): 0.5, ("d", "cl"): 0.9, ("g", "9"): 0.5, ("m", "rn"): 0.9,
    ("h", "li"): 0.9, ("b", "6"): 0.5, ("v", "y"): 1.0, ("y", "v"): 1.2, ("é", "6"): 0.5, ("w", "vv"): 0.8, ("ü", "ii"): 0.9,
    ("B", "8"): 0.5, ("S", "5"): 0.5, ("O", "0"): 0.5, ("I", "l"): 0.8, ("I", "1"): 0.5, ("I", "|"): 0.5, ("l", "I"): 0.9,
    ("Z", "2"): 0.5, ("z", "2"): 0.5, ("q", "9"): 0.6, ("in", "m"): 0.9, ("m", "in"): 1.1, ("rn", "m"): 1.0, ("cl", "d"): 1.1, ("ri", "n"): 1.1, ("h", "b"): 1.3, ("b", "h"): 1.3,
}
#: Cost of any other edit, and of an accent lost or gained.
OTHER, ACCENT = 4.0, 1.0
#: Shares of all words from which a word is in the lexicon, and how many times as frequent a repair must be.
SHARE, TIMES = 1e-6, 30
#: The same for a form that one confusion explains, and for one that stands where no neighbours tell.
NEAR, NEAR_ALONE = 4, 10
#: Letters of a word in small letters that repairs a form which no other word explains, though it is itself rare.
RARE = 6

_HYPHEN = re.compile(r"[^\W\d_][-‐‑¬­]\s*$")
_HYPHENS = "-‐‑¬­"
_IGNORABLE = re.compile("[​-‏‪-‮⁠-⁯﻿]|­(?!\\s*$)")
_TOUCHED = re.compile(f"[^{UNTOUCHED}]")
_BLANKS = re.compile(r"\s+")
_EDGES = ".,;:?()“”„\"«»[]‘…'"
_WORDLIKE = re.compile(r"^[^\W\d_]+(?:[-’'][^\W\d_]+)*$")
_LETTERS = re.compile(r"[^\W\d_]")
_ORDINAL = re.compile(r"^\d+[^\W\d_]{1,4}$")
_SENTENCE_END = re.compile(r"(?<![^\W\d_]\.[^\W\d_])[.,;:!?]$")
_SEPARATORS = re.compile(r"\s*[—–·•|]\s*|\s+-\s+")
_NUMBER = re.compile(
    r"^[\W_]*(?:(?:page|pág(?:ina)?|pag(?:ina)?|seite|p|s|pg|f|fol|folio|str(?:ona|ana)?|no|nr|n[o°º])\b[.:]?\s*)?(\d{1,5}|[ivxlc]{1,7})(?:\s*(?:of|de|von|sur|di|z|/|\|)\s*(\d{1,5}))?[\W_]*$",
    re.IGNORECASE,
)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def plain(text: str) -> str:
    """A line without what looks alike: composed, ordinary width, no ignorable characters, plain blanks and letters."""
    if text.isascii() or not _TOUCHED.search(text):
        return text
    text = _IGNORABLE.sub("", text)
    text = "".join(unicodedata.normalize("NFKC", c) if "！" <= c <= "￦" or "ﬀ" <= c <= "ﬆ" else c for c in text)
    text = unicodedata.normalize("NFC", text)
    text = _BLANKS.sub(" ", text)
    return " ".join("".join(LOOKALIKES.get(c, c) for c in w) if re.search("[A-Za-z]", w) or all(c in LOOKALIKES for c in w) else w for w in text.split(" "))


def words_in(line: str) -> list[str]:
    return [w for p in line.split() if (w := p.strip(_EDGES))]


@lru_cache(maxsize=200_000)
def shapes(word: str) -> tuple[str, ...]:
    """The word with all that scanners confuse made one, the joined letters taken in either order."""
    s = unicodedata.normalize("NFD", word.lower())
    s = "".join(c for c in s if not unicodedata.combining(c)).translate(_CLASSES)
    out = []
    for order in (("rn", "ln", "rl", "cl", "vv", "ll"), ("ll", "vv", "rn", "ln", "rl", "cl")):
        t = s
        for joined in order:
            t = t.replace(joined, _JOINED[joined])
        out.append(t.replace("h", "u"))
    return tuple(dict.fromkeys(out))


def shape(word: str) -> str:
    return shapes(word)[-1]


_JOINED = {"rn": "m", "ln": "m", "rl": "n", "cl": "d", "vv": "w", "ll": "u"}
_CLASSES = str.maketrans({"0": "o", "a": "o", "e": "c", "6": "c", "b": "c", "i": "l", "!": "l", "1": "l", "|": "l", "f": "t", "5": "s", "9": "g", "q": "g", "y": "v", "8": "c", "2": "z"})


def deletes(s: str) -> set[str]:
    return {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))} if len(s) > 4 else {s}


def base_letter(c: str) -> str:
    return unicodedata.normalize("NFD", c)[0]


def distance(printed: str, read: str, most: float) -> float:
    """Weighted edit distance from what is printed to what was read; more than `most` if it exceeds that."""
    previous: list[list[float]] = []
    for i in range(len(printed) + 1):
        row = []
        for j in range(len(read) + 1):
            if i == j == 0:
                row.append(0.0)
                continue
            best = OTHER * 99
            if i and j:
                a, b = printed[i - 1], read[j - 1]
                cost = 0.0 if a == b else CONFUSIONS.get((a, b), ACCENT if base_letter(a) == base_letter(b) else OTHER)
                best = previous[i - 1][j - 1] + cost
                if j > 1 and (two := CONFUSIONS.get((a, read[j - 2 : j]))) is not None:
                    best = min(best, previous[i - 1][j - 2] + two)
                if i > 1 and (two := CONFUSIONS.get((printed[i - 2 : i], b))) is not None:
                    best = min(best, previous[i - 2][j - 1] + two)
            if i:
                best = min(best, previous[i - 1][j] + OTHER)
            if j:
                best = min(best, row[j - 1] + OTHER)
            row.append(best)
        previous.append(row)
        if min(row) > most + OTHER:
            return most + 1
    return previous[-1][-1]


def confused_once(printed: str, read: str) -> bool:
    """Whether one confusion alone makes what was read of what is printed."""
    if abs(len(printed) - len(read)) > 1:
        return False
    a = 0
    while a < min(len(printed), len(read)) and printed[a] == read[a]:
        a += 1
    return any((p := printed[i : i + m], r := read[i : i + n]) in CONFUSIONS and printed[i + m :] == read[i + n :] for i in (a - 1, a) if i >= 0 for m, n in ((1, 1), (1, 2), (2, 1)))


def _common_noun(word: str) -> bool:
    """Whether a word is no name: it begins with a small letter, or with what scanners read instead of one."""
    return not word[:1].isupper()


class Lexicon:
    """Words of at least SHARE of all, at most 1 / SHARE; which of them repair doubtful words; and neighbour counts."""

    def __init__(self, words: Sequence[str], counts: Sequence[int], total: int, pairs: dict[tuple[str, str], int] | None = None):
        self.counts = dict(zip(words, counts, strict=True))
        self.least = max(3, int(SHARE * total))
        self.pairs = pairs or {}
        self.index: dict[str, list[str]] = defaultdict(list)
        for w, n in self.counts.items():
            if n >= (NEAR if _common_noun(w) else TIMES) * self.least and _WORDLIKE.match(w):
                for d in {d for s in shapes(w) for d in deletes(s)}:
                    self.index[d].append(w)
        self.known: dict[str, tuple[str, float] | None] = {}
        self.hyphenated = {a + "-" for w in self.counts if "-" in w for a in (w.rpartition("-")[0], w.partition("-")[0])}
        self.tails = {b for w in self.counts if "-" in w for b in (w.partition("-")[2], w.rpartition("-")[2])}

    def candidates(self, word: str) -> list[tuple[float, str]]:
        """Repairs of a word, the cheapest and most frequent first."""
        own = self.counts.get(word, 0)
        most = 0.9 * max(2.0, len(word) / 2.6)
        found = {c for s in shapes(word) for d in deletes(s) for c in self.index.get(d, ()) if c != word}
        out = []
        for c in found:
            far = self.counts[c] < TIMES * max(own, self.least)
            rare = own < self.least and _common_noun(c) and _common_noun(word) and len(c) >= RARE  # names are in capitals
            if far and not rare and (own < self.least or self.counts[c] < NEAR * own) or abs(len(c) - len(word)) > 0.5 * len(c) or len(c) < 2:
                continue
            if far and not confused_once(c, word):
                continue
            if (cost := distance(c, word, most)) <= most:
                out.append((cost - 0.15 * float(np.log2(self.counts[c] / self.least)), c))
        return sorted(out)

    def repair(self, word: str) -> str | None:
        """What a doubtful word was, or None for a sound one; '' if it is misread beyond repair. Blind to context."""
        if word in self.known:
            return self.known[word]
        if len(self.known) > 300_000:
            self.known.clear()
        self.known[word] = found = self._repair(word)
        return found

    def _repair(self, word: str) -> str | None:
        if not _LETTERS.search(word) or len(word) < 2:
            return None
        own = self.counts.get(word, 0)
        digits = any(c.isdigit() for c in word)
        if digits and (_ORDINAL.match(word) or not any(c.islower() for c in word) or re.search(r"\d{3}", word)):
            return None
        options = self.candidates(word)
        if not options and own >= self.least and _WORDLIKE.match(word):
            return None
        if not options:  # a capitalised word may be known in small letters, and the other way round
            for other in (word[:1].lower() + word[1:], word[:1].upper() + word[1:]):
                if other != word:
                    if self.counts.get(other, 0) >= self.least:
                        return None
                    options = options or [(s, c[:1].upper() + c[1:] if word[:1].isupper() else c) for s, c in self.candidates(other)]
            if word.isupper() and len(word) > 3 and not options:
                lower = word.lower()
                if self.counts.get(lower, 0) >= self.least or self.counts.get(word.title(), 0) >= self.least:
                    return None
        if options:
            return options[0][1] if not (own >= self.least and _WORDLIKE.match(word)) or not self.pairs else f"?{options[0][1]}"
        if re.search(r"[^\W\d_][|!][^\W\d_]|^[|!][^\W\d_]{2}|[^\W\d_]{2}[|]$", word) or digits and re.search(r"[a-zà-ÿ][0-9][a-zà-ÿ]|[a-zà-ÿ]{2}[01569]$|^[0156][a-zà-ÿ]{2}", word) and word.count("-") == 0:
            return ""
        return None

    def judge(self, before: str, word: str, after: str) -> str | None:
        """Repair of a word in its context: None if it is sound there."""
        found = self.repair(word)
        if found is None or not found.startswith("?"):
            return found
        better = found[1:]
        own, other = self.counts[word], self.counts[better]
        score = 0.0
        for a, b in ((before, None), (None, after)):
            n = self.pairs.get((a, word) if a is not None else (word, b), 0)
            m = self.pairs.get((a, better) if a is not None else (better, b), 0)
            score += np.log2((m + 0.5) / (n + 0.5)) if a is None or a else 0.0
        # a slip turns up where the other reading is at home; a word of its own has places of its own
        alone = NEAR_ALONE if confused_once(better, word) else 3 * TIMES
        return better if score > 0 or score == 0 and other >= alone * own else None


def number_of(line: str) -> tuple[int, bool] | None:
    """The number of a line that holds nothing else, and whether it is dressed as a page number."""
    m = _NUMBER.match(line)
    if not m or len(line) > 30:
        return None
    digits = m[1].lower()
    if digits.isdigit():
        value = int(digits)
    else:
        value = 0
        for a, b in zip(digits, digits[1:] + " ", strict=True):
            value += -_ROMAN[a] if _ROMAN.get(b, 0) > _ROMAN[a] else _ROMAN[a]
    return value, line.strip().lower() != digits


def title_key(line: str) -> str:
    """What stays the same in a running title: shapes of its letters, without numbers, blanks and signs."""
    return "".join(shape(w) for w in re.findall(r"[^\W_]+", re.sub(r"(?<!\w)[\d/.\-]+(?!\w)", " ", line)) if not w.isdigit())


def title_parts(line: str) -> list[str]:
    return [k for p in _SEPARATORS.split(line) if len(k := title_key(p)) >= 3]


def band(texts: Sequence[str], page: int) -> list[int]:
    """Places of a page's lines where a running title can stand: the outer two at the top and the bottom, page numbers not counted."""
    rest = [i for i, t in enumerate(texts) if t.strip() and not _numbered(t, page)]
    at = [i for i, t in enumerate(texts) if t.strip()]
    return sorted({*rest[:1], *rest[-1:]} & {*at[:2], *at[-2:]})


def _numbered(line: str, page: int) -> bool:
    found = number_of(line)
    return found is not None and (found[1] or found[0] == page)


class Reader:
    """Examines the lines of one page."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def splits(self, line: str, follows: str) -> bool:
        """Whether a line's last hyphen only splits a word at the line's end."""
        if not _HYPHEN.search(line):
            return False
        left = words_in(line)[-1] if words_in(line) else ""
        left = left.rstrip(_HYPHENS + " ")
        right = (words_in(follows) or [""])[0].rstrip(_HYPHENS)
        counts = self.lexicon.counts
        if not left:
            return False
        if not right:
            return left + "-" not in self.lexicon.hyphenated or counts.get(left, 0) == 0
        whole = self._count(left + right)
        kept = self._count(f"{left}-{right}") + self._count(f"{left}-{right.partition('-')[0]}")
        if whole or kept:
            return whole >= kept
        if (fixed := self.lexicon.repair(left + right)) and not fixed.startswith("?"):
            return True
        if left + "-" in self.lexicon.hyphenated and right in self.lexicon.tails:
            return False
        if (fixed := self.lexicon.repair(f"{left}-{right}")) and not fixed.startswith("?"):
            return False
        return True

    def _count(self, word: str) -> int:
        c = self.lexicon.counts
        return max(c.get(word, 0), c.get(word[:1].lower() + word[1:], 0), c.get(word.lower(), 0))

    def page(self, texts: Sequence[str], page: int, titles: frozenset[str], parts: frozenset[str]) -> tuple[list[set[str]], list[list[str]]]:
        """Kinds of each line, and each line's words as they should be."""
        lines = [plain(t) for t in texts]
        kinds: list[set[str]] = [set() for _ in lines]
        filled = [i for i, t in enumerate(lines) if t.strip()]
        for i in {*filled[:2], *filled[-2:]}:
            if _numbered(lines[i], page):
                kinds[i].add("page_number")
        for i in band(lines, page):
            key = title_key(lines[i])
            own = title_parts(lines[i])
            if len(key) < 3 or _SENTENCE_END.search(lines[i]) or lines[i].lstrip()[:1].islower():
                continue
            if key in titles or any(p in titles for p in own) or own and (len(own) > 1 or any(c.isdigit() for c in lines[i])) and all(p in parts for p in own):
                kinds[i].add("header")
        body = [i for i in filled if not kinds[i] & {"page_number", "header"}]
        after = dict(zip(body, body[1:], strict=False))
        fixed: list[list[str]] = []
        carried = ""  # the first part of a word split at the end of the line before
        for i, line in enumerate(lines):
            tokens = line.split()
            out = list(tokens)
            cores = [p.strip(_EDGES) for p in tokens]
            split = i in after and self.splits(line, lines[after[i]]) or i in filled and i not in after and i in body and self.splits(line, "")
            if split:
                kinds[i].add("hyphen")
            tail = i in after and bool(_HYPHEN.search(line))
            for k, core in enumerate(cores):
                if len(core) < 2 or i not in filled:
                    continue
                if k == len(cores) - 1 and tail:
                    right = (words_in(lines[after[i]]) or [""])[0]
                    left = core.rstrip(_HYPHENS)
                    joint = left + right if split else f"{left}-{right}"
                    if self._wrong(joint, left, right, first=True):
                        kinds[i].add("misread")
                    continue
                if k == 0 and carried and i in body:
                    left, glue = carried[:-1], carried[-1]
                    joint = left + core if glue == "+" else f"{left}-{core}"
                    if self._wrong(joint, left, core, first=False):
                        kinds[i].add("misread")
                    continue
                repair = self.lexicon.judge(cores[k - 1] if k else "", core, cores[k + 1] if k + 1 < len(cores) else "")
                if repair is not None:
                    kinds[i].add("misread")
                    if repair:
                        out[k] = tokens[k].replace(core, repair, 1)
            if i in body:
                carried = (cores[-1].rstrip(_HYPHENS) + ("+" if split else "-")) if tail and cores else ""
            fixed.append(out)
        return kinds, fixed

    def _wrong(self, joint: str, left: str, right: str, first: bool) -> bool:
        """Whether the given part of a word split at a line end is misread."""
        repair = self.lexicon.repair(joint)
        if repair is None or repair.startswith("?"):
            return False
        if not repair:
            part = left if first else right
            return self.lexicon.repair(part) is not None
        cut = len(left)
        for k in range(max(0, len(left) - 2), min(len(repair), len(left) + 2) + 1):  # where the repaired word was split
            a, b = distance(repair[:k], left, 9.0), distance(repair[k:].lstrip("-"), right.lstrip("-"), 9.0)
            if k == max(0, len(left) - 2) or a + b < best[0]:
                best = (a + b, a, b)
                cut = k
        return (best[1] if first else best[2]) > 0 if cut >= 0 else False


def _collect_words(pages: DataFrame) -> tuple[list[str], list[int], int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for line in batch.column(0).flatten().to_pylist():
                words = words_in(plain(line or ""))
                counts.update(words[:-1] if words and words[-1][-1] in _HYPHENS else words)
            if counts:
                words, numbers = zip(*counts.items(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(numbers, pa.int64())], ["word", "n"])

    counts = map_arrow(pages.select("texts"), run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    rows = counts.crossJoin(F.broadcast(total)).filter(F.col("n") >= F.greatest(F.lit(3), SHARE * F.col("total"))).collect()
    rows.sort(key=lambda r: r.word)
    return [r.word for r in rows], [r.n for r in rows], int(rows[0].total) if rows else 0


def _collect_pairs(pages: DataFrame, wanted: set[str]) -> dict[tuple[str, str], int]:
    """Counts of the neighbours that the wanted words have at least three times."""
    if not wanted:
        return {}
    sent = pages.sparkSession.sparkContext.broadcast(frozenset(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            counts: Counter[tuple[str, str]] = Counter()
            for line in batch.column(0).flatten().to_pylist():
                words = words_in(plain(line or ""))
                counts.update(p for p in zip(words, words[1:], strict=False) if p[0] in own or p[1] in own)
            if counts:
                firsts, seconds = zip(*counts, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(firsts), pa.array(seconds), pa.array(list(counts.values()), pa.int64())], ["a", "b", "n"])

    counts = map_arrow(pages.select("texts"), run, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    total = counts.agg((F.sum("n") * 1e-6).alias("least"))  # at most a million pairs
    kept = counts.crossJoin(F.broadcast(total)).filter(F.col("n") >= F.greatest(F.lit(3.0), F.col("least")))
    return {(r.a, r.b): r.n for r in kept.collect()}


class ScanModel:
    """What the corpus tells: lexicon, neighbour counts and parts of running titles. Every table has a fixed bound."""

    def __init__(self, pages: DataFrame):
        words, counts, total = _collect_words(pages)
        spark = pages.sparkSession
        bare = spark.sparkContext.broadcast((words, counts, total, {}))

        def doubted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon = _lexicon(bare)
            for batch in batches:
                wanted = []
                for w in batch.column(0).to_pylist():
                    if _WORDLIKE.match(w) and (found := lexicon.candidates(w)):
                        wanted += [w, *(c for _, c in found[:3])]
                if wanted:
                    yield pa.RecordBatch.from_arrays([pa.array(wanted)], ["word"])

        # lexicon words that could be misreadings of far more frequent ones, and these: only their neighbours can tell
        listed = spark.createDataFrame(pa.table({"word": pa.array(words, pa.string())})).repartition(max(1, min(256, len(words) // 2000)))
        wanted = {r.word for r in map_arrow(listed, doubted, "word string").distinct().collect()} if words else set()
        self.sent = spark.sparkContext.broadcast((words, counts, total, _collect_pairs(pages, wanted)))


_lexicons: dict[int, Lexicon] = {}


def _lexicon(sent) -> Lexicon:
    words, counts, total, pairs = sent.value
    key = hash((len(words), total, len(pairs), tuple(counts[:100]), tuple(words[:100])))
    if key not in _lexicons:
        _lexicons.clear()
        _lexicons[key] = Lexicon(words, counts, total, pairs)
    return _lexicons[key]


def _bands(pages: DataFrame) -> DataFrame:
    """Keys of the lines and parts of lines where running titles can stand: (doc, page, title)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, numbers, titles = [], [], []
            for doc, page, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = [t for t in texts or [] if t and t.strip()]
                lines = [plain(t) for t in (lines if len(lines) <= 6 else [*lines[:3], *lines[-3:]])]
                for i in band(lines, -1 if page is None else page):
                    if _SENTENCE_END.search(lines[i]):
                        continue
                    for key in {title_key(lines[i]), *title_parts(lines[i])}:
                        if len(key) >= 3:
                            docs.append(doc)
                            numbers.append(page)
                            titles.append(key)
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(numbers, pa.int32()), pa.array(titles)], ["doc", "page", "title"])

    return map_arrow(pages.select("doc", "page", "texts"), run, "doc string, page int, title string").distinct()


def running_titles(pages: DataFrame) -> DataFrame:
    """(doc, titles): what stands at the edge of at least two pages and a sixth of the pages of a document."""
    bands = _bands(pages)
    counts = bands.groupBy("doc", "title").agg(F.count("page").alias("n"))
    sizes = pages.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    kept = counts.join(sizes, "doc").filter((F.col("n") >= 2) & (F.col("n") * 6 >= F.col("pages")))
    return kept.groupBy("doc").agg(F.collect_list("title").alias("titles"))  # at most 12 keys for each line of a band


def title_vocabulary(titles: DataFrame, share: float = 2e-5) -> list[str]:
    """Parts of running titles that at least three documents and a share of all have: bounded by 1 / share."""
    each = titles.select(F.explode("titles").alias("title")).groupBy("title").agg(F.count("*").alias("n"))
    total = each.agg(F.sum("n").alias("total"))
    kept = each.crossJoin(F.broadcast(total)).filter(F.col("n") >= F.greatest(F.lit(3.0), share * F.col("total")))
    return [r.title for r in kept.select("title").collect()]


def examine(pages: DataFrame) -> DataFrame:
    """Noise in pages (doc, bases ARRAY<STRING>, page INT, nos ARRAY<INT>, texts ARRAY<STRING>): (bases, nos, kinds,
    repaired).

    `nos` and `kinds` run side by side, one entry for each kind of a line; `repaired` are the page's paragraphs. `bases`
    names every place where this very page occurs: it is examined once. Null and empty texts are lines without words.
    `pages` is read four times and should be a written table.
    """
    model = ScanModel(pages)
    titles = written(running_titles(pages))
    parts = pages.sparkSession.sparkContext.broadcast(frozenset(title_vocabulary(titles)))
    known = pages.join(titles, "doc", "left").select("bases", "page", "nos", "texts", "titles")
    sent = model.sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(_lexicon(sent))
        for batch in batches:
            bases, nos, kinds, repaired = [], [], [], []
            for base, page, numbers, texts, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                given = [t or "" for t in texts or []]
                found, fixed = reader.page(given, -1 if page is None else page, frozenset(own or ()), parts.value)
                rows = [(n, k) for n, s in zip(numbers or [], found, strict=True) for k in sorted(s)]
                bases.append(base)
                nos.append([n for n, _ in rows])
                kinds.append([k for _, k in rows])
                repaired.append(paragraphs(found, fixed))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bases, pa.list_(pa.string())), pa.array(nos, pa.list_(pa.int32())), pa.array(kinds, pa.list_(pa.string())), pa.array(repaired, pa.list_(pa.string()))], ["bases", "nos", "kinds", "repaired"]
            )

    return map_arrow(known, run, "bases array<string>, nos array<int>, kinds array<string>, repaired array<string>")


def paragraphs(kinds: Sequence[set[str]], lines: Sequence[Sequence[str]]) -> list[str]:
    """Paragraphs of the repaired lines, without running titles and page numbers.

    A paragraph goes on over a line end unless the line is short and ends a sentence, or is a short line of its own.
    """
    body = [(k, " ".join(w)) for k, w in zip(kinds, lines, strict=True) if w and not k & {"header", "page_number"}]
    widest = max((len(t) for _, t in body), default=0)
    out: list[str] = []
    joined = False  # whether the next line continues the last paragraph
    glue = " "
    for k, t in body:
        if joined:
            out[-1] += glue + t
        else:
            out.append(t)
        if "hyphen" in k:
            out[-1] = out[-1].rstrip().rstrip(_HYPHENS)
            joined, glue = True, ""
        elif _HYPHEN.search(t):
            joined, glue = True, ""
        else:
            joined, glue = len(t) >= 0.75 * widest or t[-1:] not in ".!?:" and len(t) >= 0.5 * widest, " "
    return out
