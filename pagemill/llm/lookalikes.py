"""One form for text that looks the same (problem 6).

Full-width forms and ligatures become ordinary characters, ignorable characters go, accents join their letters and blanks
become spaces. Then each word with letters that could be another script's is read as a lattice: every letter with the
look-alikes it may stand for. A path stays in one script; the best path of each script under the corpus's character pairs
is found by the Viterbi algorithm, and the script of the best, with the text's other letters as context, wins.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.charstats import PairModel, class_table, model_of, pair_counts
from pagemill.llm.folding import LOOKALIKES
from pagemill.runtime import map_arrow

_WIDE = re.compile("[！-～￠-￦ﬀ-ﬆ]")
_EAST_ASIAN = re.compile("[、-ヿ㐀-鿿가-힣]")
_EAST_SIGNS = re.compile("[！-／：-＠［-｀｛-～]")
_IGNORABLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿￹-￻]")
_BLANK = re.compile("[\t   -   　]")
_WORD = re.compile(r"[^\W\d_]+")
_OTHER_SCRIPT = re.compile("[Ͱ-ϿЀ-ԯԱ-֏Ꭰ-ᏽ]")
#: Characters that none of the rules touches; a text of these alone needs no look (Java and Python syntax alike).
UNTOUCHED = (
    r"\x0a-\x7e¡-¬®-ʯ‐-‧‰-⁞₠-℥℧-℩ℬ-⌨⌫-⫛"
    r"⫝-⯿、-゘゛-ヿ㐀-鿿"
)
LATIN, CYRILLIC, GREEK, ARMENIAN, CHEROKEE = SCRIPTS = "LCGAK"
#: Code points that a script's letters begin and end with.
RANGES = {LATIN: (0x41, 0x250), CYRILLIC: (0x400, 0x530), GREEK: (0x370, 0x400), ARMENIAN: (0x530, 0x590), CHEROKEE: (0x13A0, 0x1400)}


def script(c: str) -> str:
    p = ord(c)
    for s in SCRIPTS[1:]:
        if RANGES[s][0] <= p < RANGES[s][1]:
            return s
    return LATIN if p < 0x250 or 0x1E00 <= p < 0x1F00 else ""


def _alternatives() -> dict[str, dict[str, tuple[str, ...]]]:
    """For each letter, the letters of each script that it can stand for."""
    groups: dict[str, set[str]] = {}
    for other, latin in LOOKALIKES.items():
        groups.setdefault(latin, {latin}).add(other)
    out: dict[str, dict[str, tuple[str, ...]]] = {}
    for group in groups.values():
        for c in group:
            for d in sorted(group):
                kept = out.setdefault(c, {})
                if script(d) != script(c):
                    kept[script(d)] = (*kept.get(script(d), ()), d)
    return out


ALTERNATIVES = _alternatives()


def viterbi(lattice: Sequence[Sequence[str]], model: PairModel, share: float = 0.0) -> tuple[float, str]:
    """The best path through the lattice, a blank before and after, and its log probability, with `share` bits taken off."""
    table = class_table()
    states: dict[str, tuple[float, str]] = {" ": (-share, "")}
    for options in [*lattice, (" ",)]:
        new = {}
        for c in options:
            column = model.given[:, table[ord(c)]]
            new[c] = max((s + float(column[table[ord(p)]]), path + c) for p, (s, path) in states.items())
        states = new
    score, path = states[" "]
    return score, path[:-1]


class Normalizer:
    """Brings single texts to the common form. `context` is the weight in bits of the text's other letters."""

    def __init__(self, model: PairModel, context: float = 12.0):
        self.model, self.context = model, context
        self.known: dict[tuple[str, str], str] = {}
        #: Bits of a word's being in a script at all; how common a script is must not decide about a word.
        starts = {s: np.unique([class_table()[p] for p in range(*RANGES[s]) if chr(p).isalpha()]) for s in SCRIPTS}
        self.shares = {s: float(np.log2((model.counts[0, own].sum() + 20) / (model.firsts[0] + 20))) for s, own in starts.items()}

    def word(self, word: str, around: str) -> str:
        """A word in the script that its letters and the script `around` it speak for."""
        key = (word, around)
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = self._word(word, around)
        return self.known[key]

    def _word(self, word: str, around: str) -> str:
        scripts = {script(c) for c in word} - {""}
        around = around or "".join(scripts)
        found = []
        for s in SCRIPTS:
            lattice = [(c,) if script(c) in (s, "") else ALTERNATIVES.get(c, {}).get(s, ()) for c in word]
            if all(lattice):
                score, path = viterbi(lattice, self.model, self.shares[s])
                found.append((score + self.context * (s == around), path))
        if not found or len(scripts) == 1 and len(found) == 1:
            return word
        return max(found)[1]

    def normalize(self, text: str) -> str:
        """The common form of a text; equal to the text if it has no case."""
        if _WIDE.search(text):
            east = _EAST_ASIAN.search(text) is not None
            text = _WIDE.sub(lambda m: m.group() if east and _EAST_SIGNS.match(m.group()) and self._beside(text, m) else unicodedata.normalize("NFKC", m.group()), text)
        text = _IGNORABLE.sub("", text)
        text = unicodedata.normalize("NFC", text)
        text = _BLANK.sub(" ", text)
        if _OTHER_SCRIPT.search(text):
            text = self._scripts(text)
        return text

    @staticmethod
    def _beside(text: str, m: re.Match[str]) -> bool:
        """Whether a full-width sign stands beside East Asian text, where it is the ordinary form."""
        return bool(_EAST_ASIAN.match(text[m.start() - 1 : m.start()] or " ") or _EAST_ASIAN.match(text[m.end() : m.end() + 1] or " "))

    def _scripts(self, text: str) -> str:
        sure = dict.fromkeys(SCRIPTS, 0)
        present = {script(c) for c in set(text)} - {""}
        for w in _WORD.finditer(text):
            for c in w.group():
                s = script(c)
                if s and present.isdisjoint(ALTERNATIVES.get(c, ())) and (s != LATIN or c.isascii()):  # letters beyond ASCII may be garbled
                    sure[s] += 1
        around = max(sure, key=lambda s: sure[s]) if any(sure.values()) else ""

        def one(m: re.Match[str]) -> str:
            word = m.group()
            if any(c in ALTERNATIVES for c in word) and (_OTHER_SCRIPT.search(word) or around not in ("", LATIN)):
                return self.word(word, around)
            return word

        return _WORD.sub(one, text)


def look_alike_statistics(frames: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Pair counts of all texts of several tables together."""
    counts = [pair_counts(df, text) for df, text in frames]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionAll(c)
    return out.groupBy("pair").agg(F.sum("n").alias("n"))


def normalize_texts(df: DataFrame, keys: Sequence[str], text: str, statistics: DataFrame | None = None) -> DataFrame:
    """Rows whose text only looks like a plainer spelling: (*`keys`, form STRING).

    Cases: full-width forms or ligatures for ordinary characters (full-width signs beside East Asian text are ordinary),
    accents apart from their letters and other canonically equal spellings, ignorable characters, blanks other than space
    and line end, and letters that stand for look-alikes of another script. Null and empty texts have no case; repeated
    rows are each reported. Only texts with a character that some rule could touch reach Python; nothing is shuffled but
    the bounded pair counts.
    """
    counts = statistics if statistics is not None else pair_counts(df, text)
    sent = df.sparkSession.sparkContext.broadcast(PairModel.of(counts).sparse())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", form string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normalizer = Normalizer(model_of(sent))
        for batch in batches:
            rows, forms = [], []
            for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                form = normalizer.normalize(t)
                if form != t:
                    rows.append(i)
                    forms.append(form)
            if rows:
                kept = [c.take(pa.array(rows)) for c in batch.columns[: len(keys)]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(forms)], [*keys, "form"])

    # printable ASCII holds no case; for it a comparison of lengths is enough and the pattern of many ranges is not asked
    plain = F.octet_length(df[text]) == F.char_length(df[text])
    touched = df.filter(F.when(plain, F.contains(df[text], F.lit("\t"))).otherwise(df[text].rlike(f"[^{UNTOUCHED}]"))).select(*keys, df[text].alias("_text"))
    return map_arrow(touched, run, schema)
