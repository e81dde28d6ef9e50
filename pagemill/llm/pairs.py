"""Defective answers of question-answer pairs (problem 1).

A suffix automaton of the question measures how much of an answer is copied from it; an Aho-Corasick automaton of word
classes finds an answerer that declines; words vote for languages with the weights that the corpus gives them; a stack of
delimiters and the corpus counts of how word sequences go on or end tell a broken-off answer from a complete one.

Answers are read a batch at a time: each blank-free token is looked up once in a worker's table of votes, marks and steps,
and what a row needs of them is summed in numpy. Only rows that such sums cannot decide are looked at one by one.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.folding import fold_word, streams
from pagemill.llm.refusals import declines, outside_quotations, triggers
from pagemill.runtime import map_arrow

#: What stands for a missing answer, folded to letters and digits.
PLACEHOLDERS = frozenset(
    "na nan null nil tbd tba tbc blank empty noanswer noanswerprovided noanswerfound missing missinganswer notavailable notapplicable unanswered "
    "keineantwort sansreponse sinrespuesta semresposta answer antwort reponse respuesta todo xxx undefined nodata".split()
)
#: Words of which a placeholder in brackets is made, and those of them that one must have.
PLACEHOLDER_WORDS = frozenset("no not answer response text content data value entry available provided given found missing none empty blank null pending here your the insert keine antwort vorhanden sans aucune reponse sin respuesta sem resposta".split())
#: Words that a language's questions and answers are made of; shared words stand in every language that has them.
STOPWORDS = {
    "en": "the of and was is what which who where how many did do does on in to were that this by a",
    "de": "der die das des und wie wer wo was welche welchem wird wurde ist den dem ein eine für von über im in hat",
    "fr": "le la les de des du et est quel quelle qui où combien que au dans en pour un une sur été dit à a quelle pourquoi se",
    "es": "el la los las de del y es qué que quién cuál dónde cuántas cuántos se en por un una fue fecha con para dice a",
    "pt": "o a os as de do da e é qual que quem onde quantas quantos em por um uma foi não com para diz se",
    "it": "il la lo gli della e è quale chi dove quanti quante in per un una è stato che con dice a se",
    "pl": "a i w na z jest kto gdzie ile co który do nie się od po",
    "cs": "a v na je kdo kde kolik co který do se od po byl byla",
}
#: Marks that one of these languages alone writes.
MARKS = {"es": "¿¡ñ", "de": "ß", "pt": "ãõ", "pl": "łżź", "cs": "řěů"}

_WORD = re.compile(r"(?:[^\W\d_]\.){2,}|[^\W_]+(?:[’'\-‐][^\W_]+)*")
_STEP = re.compile(r"(?:[^\W\d_]\.){2,}|[^\W_]+(?:[’'\-‐.,/][^\W_]+)*|[.!?。…]+|[,;:()“”„«»\"]")
_QUOTES = re.compile("[“„«‘(\"]")
_LABEL = re.compile(r"^\s*(?:question|answer|q|a|frage|antwort|réponse|pregunta|respuesta|f|r|p)\s*[:：]\s*|\s*(?:answer|a|antwort|réponse|respuesta|r)\s*[:：]\s*$", re.IGNORECASE)
_ENDS = re.compile(r"[.!?。…][”\"»’')\]]*$|[.!?。…]?[”\"»’')\]]+$")
_ABBREVIATED = re.compile(r"(?:^|[^\W_.]|\s)(?:[^\W\d_]\.){2,}$")
_ELLIPSIS = re.compile(r"(?:\.{3}|…)$")
_BRACKETED = re.compile(r"^\s*[\[<({]+([^\[\]<>(){}]*)[\]>)}]+\s*$")
_OPENS, _CLOSES = "(“«„[", {")": "(", "”": "“„", "»": "«", "]": "[", "“": "„"}

#: Orders of word sequences whose continuation is counted, longest first, and the occurrences that make a count speak.
ORDERS, LEAST = (5, 3, 2, 1), 20
#: Share of the occurrences of a word sequence, and of a single word, that must go on for its end to be a break.
GOES_ON, WORD_GOES_ON = 0.8, 0.97
#: Difference of the learned votes that decides a question whose stopwords do not, and an answer's language.
CLEAR, FOREIGN = 1.0, 5.0
#: Words that a language's answers must have in all, and how much more often its own stopwords must stand in them.
LANGUAGE_WORDS, OWN_TIMES = 500, 2.0
#: Letters of the question in a row that count as copied, and the share of an answer's letters that makes it a copy.
STRETCH, COPIED = 6, 0.87
#: Parts that a hash of a word sequence is spread over where open ends meet its counts: many answers end alike.
SALTS = 8
HASHES = [f"h{i}" for i in range(len(ORDERS))]
DEFECTS = ("empty", "copy", "refusal", "language", "truncated")


class SuffixAutomaton:
    """All substrings of a text; reads another text and measures what of it occurs in the first."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for c in text:
            now = len(self.next)
            self.next.append({})
            self.size.append(self.size[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.size[p] + 1 == self.size[q]:
                    self.link[now] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.size.append(self.size[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[now] = twin
            last = now

    def coverage(self, text: str, least: int) -> int:
        """Characters of the text inside stretches of at least `least` that occur in the automaton's text."""
        state = size = covered = upto = 0
        for i, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if c in self.next[state]:
                state = self.next[state][c]
                size += 1
            else:
                size = 0
            if size >= least:
                covered += i + 1 - max(upto, i + 1 - size)
                upto = i + 1
        return covered


@lru_cache(maxsize=20_000)
def _automaton(question: str) -> SuffixAutomaton:
    return SuffixAutomaton(question)


def is_empty(text: str | None) -> bool:
    if text and len(text) >= 40 and text[:40].isprintable() and any(c.isalpha() for c in text[:8]):
        return False
    folded = fold_word(text or "")
    if not folded:
        return True
    if len(text) >= 60:
        return False
    if folded in PLACEHOLDERS and not (folded in ("missing", "empty", "answer") and text.strip().isalpha()):
        return len(text) < 40
    inside = _BRACKETED.match(text)  # "[no answer given]", "<your answer here>"
    return bool(inside) and all(fold_word(w) in PLACEHOLDER_WORDS for w in inside[1].replace("_", " ").replace("-", " ").split())


def copies(question: str, answer: str, share: float = COPIED) -> bool:
    """Whether the answer is the question again: nearly all of it in long stretches of the question, and most of that."""
    q = fold_word(question)
    a = fold_word(_unlabelled(answer))
    if len(a) < STRETCH or len(a) < 0.6 * len(q):
        return False
    return _automaton(q).coverage(a, min(STRETCH, len(q))) >= share * len(a)


def _unlabelled(answer: str) -> str:
    return _LABEL.sub("", _LABEL.sub("", answer)) if ":" in answer or "：" in answer else answer


def may_copy(questions: Sequence[str], answers: Sequence[str], share: float = COPIED) -> np.ndarray:
    """Which answers can be copies: an exact upper bound of the automaton's coverage for a whole batch at once.

    What the automaton covers are the letters inside stretches of STRETCH that occur in the question. Here such stretches are
    looked up in a bitmap of hashes, which holds all of the questions' stretches and at worst some more; so no answer that
    `copies` accepts is refused. Questions of fewer letters than a stretch pass.
    """
    if not len(questions):
        return np.zeros(0, bool)
    names: dict[str, int] = {}
    which = np.fromiter((names.setdefault(q, len(names)) for q in questions), np.int64, len(questions))
    q, q_ends = streams(list(names))
    a, a_ends = streams([_unlabelled(t) for t in answers])
    q_sizes, a_sizes = np.diff(q_ends, prepend=0), np.diff(a_ends, prepend=0)
    long = (a_sizes >= STRETCH) & (a_sizes >= 0.6 * q_sizes[which])
    held = np.zeros(1 << 23, bool)
    held[_stretches(q, q_ends, np.arange(len(names)))[0]] = True
    keys, at = _stretches(a, a_ends, which)
    hits = np.zeros(len(a) + 1, np.int32)
    hits[at + 1] = held[keys]
    before = hits.cumsum()
    covered = before[1:] > before[np.maximum(np.arange(1, len(a) + 1) - STRETCH, 0)]
    upto = np.concatenate([[0], covered.cumsum()])
    sums = upto[a_ends] - upto[a_ends - a_sizes]
    return long & ((sums >= share * a_sizes) | (q_sizes[which] < STRETCH))


def _stretches(codes: np.ndarray, ends: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the bitmap of all stretches that lie in one text, hashed with the text's owner; and where they begin."""
    n = len(codes) - STRETCH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.diff(ends, prepend=0)
    owner = np.repeat(owners, sizes)[:n]
    good = np.repeat(ends, sizes)[:n] - np.arange(n) >= STRETCH
    with np.errstate(over="ignore"):
        h = owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(STRETCH):
            h = (h ^ codes[i : i + n]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    at = np.flatnonzero(good)
    return (h[at] >> np.uint64(41)).astype(np.int64), at


def broken_delimiters(text: str) -> bool:
    """Whether a bracket or quotation is open at the end."""
    stack: list[str] = []
    for c in text:
        if c in _CLOSES and stack and stack[-1] in _CLOSES[c]:
            stack.pop()
        elif c in _OPENS:
            stack.append(c)
    return bool(stack)


def question_language(text: str) -> str:
    """The language that the stopwords and marks of a question speak for most; '' for none or a tie."""
    return top[0] if len(top := _likeliest(text)) == 1 else ""


def _likeliest(text: str) -> list[str]:
    """The languages with the most votes: a word's one vote is shared by the languages that have it, a mark counts as one."""
    votes: dict[str, float] = {}
    for w in _WORD.findall(text.lower()):
        for lang in (own := _STOP.get(w, ())):
            votes[lang] = votes.get(lang, 0.0) + 1 / len(own)
    if not text.isascii():
        for lang, marks in MARKS.items():
            if not set(marks).isdisjoint(text):
                votes[lang] = votes.get(lang, 0.0) + 1
    most = max(votes.values(), default=0.0)
    return [k for k, n in votes.items() if n > most - 1e-6]


_STOP: dict[str, tuple[str, ...]] = {}
for _lang, _words in STOPWORDS.items():
    for _word in dict.fromkeys(_words.split()):
        _STOP[_word] = (*_STOP.get(_word, ()), _lang)


class Lexicon:
    """Words with at least a given share of all, with the languages of the questions that they answer: bounded by 1 / share."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        counts: dict[str, Counter] = defaultdict(Counter)
        for word, lang, n in rows:
            counts[word][lang] += n
        self.ordered = sorted(counts)
        self.ids = {w: i + 8 for i, w in enumerate(self.ordered)}
        totals = Counter()
        for c in counts.values():
            totals.update({k: n for k, n in c.items() if k})
        whole = sum(totals.values()) or 1
        self.weights: dict[str, dict[str, float]] = {}
        langs = self.langs = [k for k, n in totals.items() if n >= LANGUAGE_WORDS and self._speaks(k, counts)]
        for w, c in counts.items():
            n = sum(c[k] for k in langs)
            if n:
                # share of the word's occurrences against the language's own size, so that small languages count alike
                rates = {k: (c[k] + 0.02 * n * totals[k] / whole) / totals[k] for k in langs}
                mean = sum(rates.values())
                if max(rates.values()) > 0.7 * mean:
                    self.weights[w] = {k: math.log(r / mean + 0.01) for k, r in rates.items()}
        self.read = Tokens(self)

    @staticmethod
    def _speaks(lang: str, counts: dict[str, Counter]) -> bool:
        """Whether the answers to a language's questions are in that language: its own stopwords stand in them more often than
        those of any other. A few questions taken for a language that nobody writes would else teach it foreign words."""
        own = {k: sum(counts[w][lang] for w in STOPWORDS[k].split() if w in counts and len(_STOP[w]) == 1) for k in STOPWORDS}
        return own[lang] > 0 and all(own[lang] >= OWN_TIMES * n for k, n in own.items() if k != lang)

    def cut(self, word: str) -> bool:
        """Whether a last word is no known word but the beginning of one; of a capitalised one, of a word and not a name."""
        small = word.lower()
        if small in self.ids or len(small) < 2 and word.isupper() or not word.isalpha():
            return False
        at = bisect.bisect_left(self.ordered, small)
        while at < len(self.ordered) and self.ordered[at].startswith(small):
            if word.islower() or self.weights.get(self.ordered[at]):
                return True
            at += 1
        return False

    def language(self, text: str) -> dict[str, float]:
        """Votes of the words of a text outside quotations for each language."""
        votes: dict[str, float] = dict.fromkeys(self.langs, 0.0)
        for w in _WORD.findall(outside_quotations(text).lower()):
            for k, v in self.weights.get(w, {}).items():
                votes[k] += v
        return votes

    def question_language(self, text: str) -> str:
        """The language of a question; where its stopwords tie or there are none, all its words vote with the learned weights."""
        top = _likeliest(text)
        if len(top) == 1:
            return top[0]
        votes = self.language(text)
        tied = sorted((votes[k], k) for k in [k for k in top if k in votes] or votes)
        return tied[-1][1] if len(tied) > 1 and tied[-1][0] - tied[-2][0] > CLEAR else ""

    def steps(self, token: str) -> list[int]:
        """Ids of the words, numbers, names and sentence ends of a blank-free token: 2 end, 3 number, 4 name, 5 rare word."""
        return [c for w in _STEP.findall(token) if (c := self._code(w))]

    def _code(self, w: str) -> int:
        if not w[0].isalnum():
            return 2 if w[0] in ".!?。…" else 0
        if any(c.isdigit() for c in w):
            return 3
        return self.ids.get(w.lower()) or (4 if w[0].isupper() else 5)


class Tokens(dict):
    """Blank-free tokens of answers, each looked up once and kept: votes for languages, marks of refusals, steps."""

    def __init__(self, lexicon: Lexicon, keep: int = 400_000):
        self.lexicon, self.keep = lexicon, keep
        self._start()

    def _start(self) -> None:
        self.clear()
        self.votes = np.zeros((1024, max(1, len(self.lexicon.langs))), np.float32)
        self.marks = np.zeros(1024, np.uint8)
        self.sizes = np.zeros(1024, np.int64)
        self.begins = np.zeros(1024, np.int64)
        self.codes: list[int] = []

    def __missing__(self, token: str) -> int:
        n = len(self)
        if n == len(self.marks):
            self.votes, self.marks, self.sizes, self.begins = (np.concatenate([x, np.zeros_like(x)]) for x in (self.votes, self.marks, self.sizes, self.begins))
        for w in _WORD.findall(token.lower()):
            for i, k in enumerate(self.lexicon.langs):
                self.votes[n, i] += self.lexicon.weights.get(w, {}).get(k, 0.0)
        known = triggers()
        for w in re.findall(r"[^\W_]+", token):
            self.marks[n] |= known.get(fold_word(w), 0)
        steps = self.lexicon.steps(token)
        self.begins[n], self.sizes[n] = len(self.codes), len(steps)
        self.codes += steps
        self[token] = n
        return n

    def of(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all tokens of the texts, and where each text ends in them. Good until the next call."""
        if len(self) > self.keep:
            self._start()
        split = [t.split() for t in texts]
        ends = np.fromiter(map(len, split), np.int64, len(split)).cumsum()
        return np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(ends[-1]) if len(ends) else 0), ends

    def sums(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Votes of each text for each language, and its marks."""
        ids, ends = self.of(texts)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        votes = np.concatenate([np.zeros((1, self.votes.shape[1])), self.votes[ids].cumsum(0, dtype=np.float64)])
        marks = self.marks[ids]
        seen = [np.concatenate([[0], (marks & bit > 0).cumsum()]) for bit in (1, 2)]
        return votes[ends] - votes[begins], sum((s[ends] > s[begins]) * bit for s, bit in zip(seen, (1, 2), strict=True))

    def walk(self, texts: Sequence[str]) -> np.ndarray:
        """Steps of all texts: each begins with four 1, a sentence end is 2 and four 1, after each text comes 0."""
        if not len(texts):
            return np.zeros(0, np.int64)
        ids, ends = self.of(texts)
        each = self.sizes[ids]
        to = each.cumsum()
        codes = np.array(self.codes, np.int64)[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(self.begins[ids] - (to - each), each)]
        steps = np.concatenate([[0], to])[ends]  # of each text
        first = np.concatenate([[0], steps[:-1]]).astype(np.int64)
        flat = np.insert(codes, first, -1)  # -1 begins a text; an empty text has nothing else
        before = np.concatenate([[-1], flat[:-1]])
        flat = flat[~((flat == 2) & ((before == 2) | (before == -1)) | (flat == 4) & (before == 4))]
        sizes = np.where(flat == -1, 5, np.where(flat == 2, 5, 1))
        out = np.ones(int(sizes.sum()), np.int64)
        at = sizes.cumsum() - sizes
        out[at[flat == 2]] = 2
        out[at[flat > 2]] = flat[flat > 2]
        out[at[flat == -1]] = 0  # the end of the text before, then four 1
        return np.append(out[1:], 0)


_lexicons: dict[int, Lexicon] = {}


def lexicon_of(sent) -> Lexicon:
    """The lexicon of a broadcast, made once in each Python worker."""
    rows = sent.value
    key = hash((len(rows), *(tuple(r) for r in rows[:: max(1, len(rows) // 500)])))
    if key not in _lexicons:
        _lexicons.clear()
        _lexicons[key] = Lexicon(rows)
    return _lexicons[key]


def sequences(ids: np.ndarray) -> dict[int, np.ndarray]:
    """For each order, a hash of the last so many tokens at each place."""
    out = {}
    with np.errstate(over="ignore"):
        for order in ORDERS:
            h = np.full(len(ids), order, np.uint64)
            for back in range(order - 1, -1, -1):
                h = h * np.uint64(0x9E3779B97F4A7C15)
                h[back:] += ids[: len(ids) - back].astype(np.uint64)
                h ^= h >> np.uint64(31)
            out[order] = h.view(np.int64)
    return out


def open_ended(text: str) -> bool:
    """Whether a text ends without the end of a sentence."""
    tail = text[-16:]
    return bool(_ABBREVIATED.search(tail)) or not _ENDS.search(tail)


def _lexicon_rows(df: DataFrame, share: float) -> list[tuple[str, str, int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, str] = {}
        for batch in batches:
            texts: dict[str, list[str]] = defaultdict(list)
            for question, answer in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not answer:
                    continue
                if question not in langs:
                    if len(langs) > 100_000:
                        langs.clear()
                    langs[question] = question_language(question or "")
                texts[langs[question]].append(answer)
            rows = []
            for k, own in texts.items():
                tokens = Counter(" ".join(own).lower().split())
                counts: Counter[str] = Counter()
                for token, n in tokens.items():
                    if token.isalpha():
                        counts[token] += n
                    else:
                        for w in _WORD.findall(token):
                            counts[w] += n
                rows += [(w, k, n) for w, n in counts.items()]
            if rows:
                words, kinds, numbers = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(kinds), pa.array(numbers, pa.int64())], ["word", "lang", "n"])

    # the counts feed both the total and the words above its share; the driver gets at most 1 / share words
    counts = map_arrow(df.select("question", "answer"), run, "word string, lang string, n bigint").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    words = counts.groupBy("word").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("langs"))
    total = counts.agg(F.sum("n").alias("total"))
    kept = words.crossJoin(F.broadcast(total)).filter(F.col("all") >= share * F.col("total")).select("word", F.explode("langs").alias("l"))
    return [(r.word, r.lang, r.n) for r in kept.select("word", "l.lang", "l.n").collect()]


def _count(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """How often each word sequence ends a sentence, goes on, or ends a text without the end of a sentence."""
    for batch in batches:
        array = lexicon.read.walk([t for t in batch.column(0).to_pylist() if t])
        after = np.append(array[1:], 0)
        word = array > 2
        kind = np.where(after == 2, 0, np.where(after == 0, 2, 1))[word]
        found = [h[word] for h in sequences(array).values()]
        hashes, inverse = np.unique(np.concatenate(found), return_inverse=True)
        if not len(hashes):
            continue
        sums = np.bincount(inverse * 3 + np.tile(kind, len(found)), minlength=3 * len(hashes)).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(hashes), *(pa.array(np.ascontiguousarray(sums[:, k])) for k in range(3))], ["h", "ends", "goes_on", "bare"])


def _open_ends(texts: Sequence[str], lexicon: Lexicon) -> Iterator[bool | tuple[int, ...]]:
    """For each text that ends without the end of a sentence, or in an ellipsis: whether it breaks off; where only the counts
    of its last words can tell, their hashes."""
    steps = lexicon.read.walk(texts)
    ends = np.flatnonzero(steps == 0)
    words = np.diff((steps > 2).cumsum()[ends], prepend=0)
    last = np.stack([h[ends - 1] for h in sequences(steps).values()], 1).tolist()
    for text, size, code, hashes in zip(texts, words.tolist(), steps[ends - 1].tolist(), last, strict=True):
        if size < 2:
            yield False
        elif _ELLIPSIS.search(text[-4:]) or broken_delimiters(text) or text[-1] in ",;:(–—-“„«":
            yield True
        else:
            own = _WORD.findall(text)
            if all(not w[0].islower() for w in own):  # a name, a number
                yield False
            else:
                yield lexicon.cut(own[-1]) or (tuple(hashes) if code > 2 else False)


def _judge(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    langs: dict[str, int] = {}
    names = lexicon.langs
    nothing = (0,) * len(ORDERS)

    def language(question: str) -> int:
        if question not in langs:
            if len(langs) > 100_000:
                langs.clear()
            own = lexicon.question_language(question)
            langs[question] = names.index(own) if own in names else -1
        return langs[question]

    for batch in batches:
        questions = [q or "" for q in batch.column(2).to_pylist()]
        answers = [a or "" for a in batch.column(3).to_pylist()]
        plain = [outside_quotations(a) if _QUOTES.search(a) else a for a in answers]
        votes, marks = lexicon.read.sums(plain)
        copied = may_copy(questions, answers)
        own = np.fromiter(map(language, questions), np.int64, len(questions))
        rows = np.arange(len(own))
        best = votes.argmax(1) if votes.size else np.zeros(len(own), np.int64)
        foreign = (own >= 0) & (best != own) & (votes[rows, best] - votes[rows, np.maximum(own, 0)] > FOREIGN)
        out: list[tuple] = []
        unsure: list[int] = []
        for i, answer in enumerate(answers):
            if is_empty(answer):
                defect = "empty"
            elif copied[i] and copies(questions[i], answer):
                defect = "copy"
            elif marks[i] == 3 and declines(answer):
                defect = "refusal"
            elif foreign[i] or not answer.isascii() and _other_script(questions[i], plain[i]):
                defect = "language"
            else:
                tail = answer[-16:].rstrip() or answer.rstrip()[-16:]
                if open_ended(tail) or _ELLIPSIS.search(tail):
                    unsure.append(i)
                continue
            out.append((i, defect, *nothing))
        for i, found in zip(unsure, _open_ends([answers[i].rstrip() for i in unsure], lexicon), strict=True):
            if found is True:
                out.append((i, "truncated", *nothing))
            elif found:
                out.append((i, None, *found))
        if out:
            at, defects, *hs = zip(*out, strict=True)
            kept = [c.take(pa.array(at)) for c in batch.columns[:2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(defects, pa.string()), *(pa.array(h, pa.int64()) for h in hs)], ["origin", "row_id", "defect", *HASHES])


def find_defects(pairs: DataFrame, share: float = 3e-5) -> DataFrame:
    """Defective rows (origin, row_id, defect) of (origin, row_id, question, answer).

    defect, the first that holds: 'empty' (null, nothing but blanks, invisible characters and punctuation, or a
    placeholder), 'copy' (the question again), 'refusal' (the answerer declines), 'language' (not the question's),
    'truncated' (breaks off inside its last sentence). A null question has no copy and no language. Each row comes once;
    repeated rows count once. `share` is the least share of all words for a word to be told from others. A language is
    known if its questions are answered with LANGUAGE_WORDS words and more, in which its own stopwords prevail.
    """
    rows = pairs.select("origin", "row_id", "question", "answer").distinct()
    sent = pairs.sparkSession.sparkContext.broadcast(_lexicon_rows(pairs, share))
    counted = map_arrow(pairs.select("answer"), lambda batches: _count(batches, lexicon_of(sent)), "h bigint, ends bigint, goes_on bigint, bare bigint")
    sums = counted.groupBy("h").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"), F.sum("bare").alias("bare"))
    judged = map_arrow(rows, lambda batches: _judge(batches, lexicon_of(sent)), "origin string, row_id bigint, defect string, " + ", ".join(f"{h} bigint" for h in HASHES))
    # A decided row has nothing to ask: it gets a hash of its own key, meets no count and is spread like any other. The hashes
    # of open ends are salted, as many answers end alike.
    own = F.xxhash64("origin", "row_id")
    decided = F.when(F.col("defect").isNotNull(), F.array(F.struct(F.lit(-1).alias("n"), own.alias("h"))))
    asked = F.array(*[F.struct(F.lit(i).alias("n"), F.col(h).alias("h")) for i, h in enumerate(HASHES)])
    each = judged.select("origin", "row_id", "defect", F.pmod(own, F.lit(SALTS)).cast("int").alias("salt"), F.explode(F.coalesce(decided, asked)).alias("x"))
    each = each.select("origin", "row_id", "defect", "salt", "x.n", "x.h")
    speaking = sums.filter((F.col("bare") > 0) & (F.col("ends") + F.col("goes_on") + F.col("bare") >= LEAST))
    share_on = F.col("goes_on") / (F.col("ends") + F.col("goes_on") + F.col("bare"))
    verdict = speaking.select("h", share_on.alias("on"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    broken = F.col("on") > F.when(F.col("n") == len(ORDERS) - 1, WORD_GOES_ON).otherwise(GOES_ON)
    met = each.join(verdict, ["h", "salt"], "left").withColumn("broken", broken)
    best = met.groupBy("origin", "row_id").agg(F.max("defect").alias("defect"), F.min_by("broken", F.when(F.col("broken").isNotNull(), F.col("n"))).alias("broken"))
    named = best.select("origin", "row_id", F.coalesce("defect", F.when(F.col("broken"), "truncated")).alias("defect"))
    return named.filter(F.col("defect").isNotNull())


_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_NON_LATIN = re.compile("[Ͱ-ϿЀ-ԯ֐-ۿऀ-๿぀-ヿ㐀-鿿가-힣]")


def _other_script(question: str, plain: str) -> bool:
    """Whether an answer is written in another script and a question in Latin letters."""
    if not question or max(plain, default="") < "\u0370" or len(_NON_LATIN.findall(plain)) <= 2 * len(_LATIN.findall(plain)) + 2:
        return False
    return len(_LATIN.findall(question)) > len(_NON_LATIN.findall(question))
