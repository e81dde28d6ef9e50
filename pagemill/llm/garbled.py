"""Text that was read with a wrong character encoding, and its repair (problem 2).

Adjacent characters are scored by their mutual information in the corpus; improbable runs are cut out as maximum-scoring
segments, and only inside them (taken to the ends of their stretches of foreign characters) are the inverse mappings tried:
the characters written in the encoding they were wrongly read with, and read in another. A reading is taken if the corpus
statistics prefer it clearly. Garbled words that are too common for that are told by word counts, and items whose character
codes spell such a reading by their codes. Text of two bytes a character that was read by single bytes, or with these
swapped, has a zero byte beside each plain letter and is told by that.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.charstats import DOUBTFUL, IMPROBABLE, PairModel, class_table, model_of, pair_counts
from pagemill.llm.folding import LOOKALIKES
from pagemill.runtime import map_arrow

#: Encodings that text is wrongly read with, and those that it may have been written in.
READ_WITH = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp1253")
WRITTEN_IN = ("mac_roman", "cp437", "cp850", "cp1252", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "cp1253", "cp932", "euc_jp")
LOST = "�"
#: Letters of a word whose readings are looked up, and how many times as frequent a reading must be; for a font known as buggy, less.
WORD, WORD_TIMES, BUGGY_TIMES = 4, 2.0, 1.2
#: Share of all words beyond ASCII from which a word is counted.
WORD_SHARE = 1e-6


def _byte_table(name: str) -> dict[int, int]:
    """Code point to byte; bytes that the encoding leaves undefined stand for themselves, as lenient readers have it."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        if len(c) == 1:
            out.setdefault(ord(c), b)
    if name != "latin-1":
        for b in range(0x80, 0xA0):  # control characters of Latin-1, mixed in by lenient readers
            out.setdefault(b, b)
    return out


_TABLES = {name: _byte_table(name) for name in READ_WITH}
_DECODERS = {name: codecs.getdecoder(name) for name in WRITTEN_IN}
#: Texts of other characters than these cannot be garbled: printable ASCII and ordinary blanks.
SUSPECT = r"[^\x09\x0a\x0d\x20-\x7e]"
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x84\x86-\x9f]")
_UNLIKELY = re.compile("[\x00-\x08\x0b-\x1f\x7f-\xa0\xad\u2000-\u200f\u2028-\u202f\u2060-\u206f\u2500-\u25ff\u3000\ue000-\uf8ff\uff00-\ufff0]")
_KANA = re.compile("[\u3041-\u30ff]")
_IDEOGRAPH = re.compile("[\u3400-\u9fff]")
_INVISIBLE = re.compile("\u00ac$|[\u00a0\u00ad\u0300-\u036f\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff\uff01-\uff5e\ufb00-\ufb06]+")
_LATIN = re.compile("[A-Za-z]")
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_TOKEN = re.compile(r"\S+")
_EDGES = ".,;:!?()“”„\"«»[]‘’…'–—-"


def as_bytes(text: str, read_with: str) -> bytes | None:
    table = _TABLES[read_with]
    try:
        return bytes([table[ord(c)] for c in text])
    except KeyError:
        return None


def read_again(text: str) -> list[str]:
    """Readings as UTF-8 of a run of characters, for each encoding it can have been wrongly read with; also repeatedly."""
    found = []
    for name in READ_WITH:
        now, steps = text, 0
        while steps < 3 and not now.isascii() and (raw := as_bytes(now, name)) is not None:
            try:
                now = raw.decode("utf-8")
            except UnicodeDecodeError:
                break
            steps += 1
        if steps and now not in found:
            found.append(now)
    return found


def other_readings(text: str) -> Iterator[str]:
    """Readings in the other encodings, each once."""
    seen = {text}
    for _, now in paired_readings(text):
        if now not in seen:
            seen.add(now)
            yield now


def paired_readings(text: str) -> Iterator[tuple[tuple[str, str], str]]:
    """Readings in the other encodings, with the pair of encodings that was read with and that had been written in."""
    for name in READ_WITH:
        raw = as_bytes(text, name)
        if raw is None:
            continue
        for other in WRITTEN_IN:
            if other == name:
                continue
            try:
                now = _DECODERS[other](raw)[0]
            except UnicodeDecodeError:
                continue
            if now == text or _UNLIKELY.search(now):
                continue
            wide = len(_IDEOGRAPH.findall(now)) + len(_KANA.findall(now))
            if wide and (wide < 3 or not _KANA.search(now)):
                continue
            yield (name, other), now


def of_two_bytes(text: str) -> str | None:
    """The text that was written with two bytes a character and read by single bytes, or with these swapped; None for another.

    Such a text has a zero byte in (nearly) every character: as characters of their own, or as their lower halves."""
    if "\x00" in text:
        if 3 * text.count("\x00") < len(text) or any(ord(c) > 255 for c in text):
            return None
        raw = text.encode("latin-1")
        order = "le" if raw[1::2].count(0) >= raw[::2].count(0) else "be"
        for skipped in (raw, raw[1:]) if len(raw) % 2 else (raw,):
            try:
                new = skipped[: len(skipped) // 2 * 2].decode(f"utf-16-{order}").lstrip("\ufeff")
            except UnicodeDecodeError:
                continue
            if new and not _CONTROL.search(new):
                return new
        return None
    if len(text) >= 3 and 4 * sum(c > "\xff" and not ord(c) & 0xFF for c in text) >= 3 * len(text):
        new = text.encode("utf-16-le", "replace").decode("utf-16-be", "replace").lstrip("\ufeff")
        return None if _CONTROL.search(new) or LOST in new else new
    return None


def improbable_runs(scores: np.ndarray) -> list[tuple[int, int]]:
    """All maximal scoring segments (begin, end) with a positive sum, in linear time.

    No segment can be made longer or shorter without losing sum, and they are disjoint: a later run isn't swallowed by a
    strong one before it."""
    held: list[tuple[int, int, float, float]] = []  # begin, end, the sum of all scores before it and up to its end
    total = 0.0
    for i, s in enumerate(scores.tolist()):
        before, total = total, total + s
        if s <= 0:
            continue
        new = (i, i + 1, before, total)
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j -= 1
            if j < 0 or held[j][3] >= new[3]:
                held.append(new)
                break
            new = (held[j][0], new[1], held[j][2], new[3])
            del held[j:]
    return [(a, b) for a, b, _, _ in held]


def _changed(old: str, new: str) -> int:
    return sum(a != b for a, b in zip(old, new, strict=False)) if len(old) == len(new) else len(old)


class Repairer:
    """Repairs single texts under a pair model. `least` bits in all and `each` bits a changed character must be gained."""

    def __init__(self, model: PairModel, least: float = 6.0, each: float = 3.0, words: dict[str, int] | None = None):
        self.model, self.least, self.each = model, least, each
        self.words = words or {}
        self.known: dict[tuple[str, str, str], str | None] = {}
        self.gains: dict[tuple[str, str, str], dict[tuple[str, str], tuple[str, float]]] = {}
        self.better: dict[str, tuple[str, float] | None] = {}

    def doubtful(self, texts: list[str]) -> np.ndarray:
        """Which of many texts have a rare pair with a character beyond ASCII, or a lost or control character."""
        joined = "\n" + "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        own = class_table()[points]
        foreign = points > 126
        at = np.flatnonzero(foreign[:-1] | foreign[1:])
        rare = np.zeros(len(points) - 1, bool)
        rare[at] = self.model.mutual(own[at], own[at + 1]) < IMPROBABLE
        rare |= (points[1:] == 0xFFFD) | (points[1:] < 32) & ~np.isin(points[1:], (9, 10, 13))
        ends = np.cumsum([len(t) + 1 for t in texts])
        upto = np.concatenate([[0], np.cumsum(rare)])
        return upto[ends] > upto[np.concatenate([[0], ends[:-1]])]

    def gain(self, before: str, old: str, new: str, after: str) -> float:
        """Mean bits of the pairs in and around the new reading, less those of the old, for the old one's length."""
        a, b = self.model.bits(before + old + after), self.model.bits(before + new + after)
        return float(b.mean() - a.mean()) * len(a) if len(old) != len(new) else float(b.sum() - a.sum())

    def best(self, before: str, old: str, after: str) -> str | None:
        """The reading of a run that the statistics prefer, or None for the run as it is."""
        key = (before, old, after)
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = self._best(before, old, after)
        return self.known[key]

    def _open(self, before: str, old: str, after: str) -> bool:
        """Whether a run can be garbled at all: it has foreign characters, and these aren't look-alikes in a Latin word."""
        foreign = _FOREIGN.findall(_INVISIBLE.sub("", old))
        if not foreign:
            return False
        latin = _LATIN.search(old) or before.isascii() and before.isalpha() or after.isascii() and after.isalpha()
        return not (latin and all(c in LOOKALIKES for part in foreign for c in part))

    def _best(self, before: str, old: str, after: str) -> str | None:
        if not self._open(before, old, after):
            return None
        again = self._again(before, old, after)
        if again is not None:
            return again
        foreign = _FOREIGN.findall(_INVISIBLE.sub("", old))
        capital = len(foreign) == 1 and len(foreign[0]) == 1 and foreign[0].isupper() and old[0] == foreign[0] and not before.strip()
        found, most = None, 0.0
        for new, gain in self.options(before, old, after).values():
            if capital and new[0].islower():  # a word that begins with a capital
                continue
            if gain > most and gain >= max(self.least, self.each * _changed(old, new)):
                found, most = new, gain
        return found

    def _again(self, before: str, old: str, after: str) -> str | None:
        """The reading as UTF-8 that the statistics prefer."""
        found, most = None, 1.0
        for new in read_again(old):
            if not _CONTROL.search(new) and (gain := self.gain(before, old, new, after)) > most:
                found, most = new, gain
        return found

    def options(self, before: str, old: str, after: str) -> dict[tuple[str, str], tuple[str, float]]:
        """For each pair of encodings the reading of a run and the bits that it gains."""
        key = (before, old, after)
        if key not in self.gains:
            if len(self.gains) > 50_000:
                self.gains.clear()
            known: dict[str, float] = {}
            found = {}
            for pair, new in paired_readings(old):
                if new not in known:
                    known[new] = self.gain(before, old, new, after)
                found[pair] = new, known[new]
            self.gains[key] = found
        return self.gains[key]

    def runs(self, text: str) -> list[tuple[int, int]]:
        """Improbable runs of a text: maximum-scoring segments of the bits by which the mutual information of pairs with a
        foreign character falls below IMPROBABLE, each taken to the ends of its stretches of foreign characters."""
        foreign = np.array([False, *(ord(c) > 126 for c in text), False])
        touches = foreign[:-1] | foreign[1:]
        scores = np.where(touches, np.clip(IMPROBABLE - self.model.information(text), -1.5, 2.0), -0.5)
        out: list[tuple[int, int]] = []
        for a, b in improbable_runs(scores):
            a, b = max(0, a - 1), min(len(text), b)  # pair i joins characters i - 1 and i
            # one ASCII character between two foreign ones can be the second byte of a character
            while a > 0 and (ord(text[a - 1]) > 126 or a > 1 and ord(text[a - 2]) > 126 and not text[a - 1].isspace()):
                a -= 1
            while b < len(text) and (ord(text[b]) > 126 or b + 1 < len(text) and ord(text[b + 1]) > 126 and not text[b].isspace()):
                b += 1
            while a < b and ord(text[a]) <= 126:
                a += 1
            while a < b and ord(text[b - 1]) <= 126:
                b -= 1
            if a == b:
                continue
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def repair(self, text: str) -> str | None:
        """The text with its garbled runs read anew, or None if none is garbled. Lost characters stay as they are."""
        now = of_two_bytes(text) or text
        for _ in range(4):
            new = None if now.isascii() else self._pass(now)
            if new is None:
                break
            now = new
        return None if now == text else now

    def _pass(self, text: str) -> str | None:
        runs = self.runs(text)
        pair = self._pair(text, runs)
        out, upto, changed = [], 0, False
        for a, b in runs:
            if a < upto:
                continue
            around = text[max(0, a - 1) : a], text[a:b], text[b : b + 1]
            new, gain = self.options(*around).get(pair, ("", 0.0)) if pair else ("", 0.0)
            found = (new, b) if gain > 0 and self._open(*around) and self._again(*around) is None else self._run(text, a, b)
            if found is not None:
                out += [text[upto:a], found[0]]
                upto, changed = found[1], True
        if not changed:
            return None
        return "".join(out) + text[upto:]

    def _pair(self, text: str, runs: list[tuple[int, int]]) -> tuple[str, str] | None:
        """The encodings that explain the runs of a text together, as it was most likely read but once; None if none gains enough."""
        if len(runs) < 2:
            return None
        total: dict[tuple[str, str], float] = {}
        letters: dict[tuple[str, str], int] = {}
        for a, b in runs:
            around = text[max(0, a - 1) : a], text[a:b], text[b : b + 1]
            if LOST in text[a:b] or not self._open(*around):
                continue
            for pair, (new, gain) in self.options(*around).items():
                total[pair] = total.get(pair, 0.0) + gain
                letters[pair] = letters.get(pair, 0) + _changed(text[a:b], new)
        good = [(gain, pair) for pair, gain in total.items() if gain >= max(self.least, self.each * letters[pair])]
        return max(good)[1] if good else None

    def _run(self, text: str, a: int, b: int) -> tuple[str, int] | None:
        run = text[a:b]
        if b < len(text) and not text[b].isspace() and LOST not in run:  # the second byte of the last character
            new = self.best(text[max(0, a - 1) : a], text[a : b + 1], text[b + 1 : b + 2])
            if new is not None and (_KANA.search(new) or _IDEOGRAPH.search(new)):
                return new, b + 1
        if LOST not in run:
            new = self.best(text[max(0, a - 1) : a], run, text[b : b + 1])
            if new is not None:
                return new, b
        out, upto, changed = [], a, False  # not as a whole: word by word, and in these by stretches of foreign characters
        for w in _TOKEN.finditer(text, a, b):
            wa, wb = w.span()
            new = None if LOST in w.group() else self.best(text[max(0, wa - 1) : wa], text[wa:wb], text[wb : wb + 1])
            if new is not None:
                out.append(text[upto:wa] + new)
                upto, changed = wb, True
                continue
            for m in _FOREIGN.finditer(text, wa, wb):
                if LOST in m.group():
                    continue
                new = self.best(text[max(0, m.start() - 1) : m.start()], m.group(), text[m.end() : m.end() + 1])
                if new is not None:
                    out.append(text[upto : m.start()] + new)
                    upto, changed = m.end(), True
        return ("".join(out) + text[upto:b], max(upto, b)) if changed else None


    def by_words(self, text: str, buggy: bool = False) -> str | None:
        """The text with those words read anew that the corpus has far more often in another reading; None if there are none."""
        now, times = text, BUGGY_TIMES if buggy else WORD_TIMES
        for token in {w for w in text.split() if not w.isascii()}:
            core = token.strip(_EDGES)
            found = self._reading(core)
            if found and found[1] >= times:
                now = re.sub(rf"(?<!\S){re.escape(token)}(?!\S)", lambda _, t=token.replace(core, found[0]): t, now)
        return None if now == text else now

    def _reading(self, word: str) -> tuple[str, float] | None:
        """The most frequent reading of a word, and how many times as frequent as the word it is."""
        if word not in self.better:
            if len(self.better) > 200_000:
                self.better.clear()
            found = None
            if sum(map(str.isalpha, word)) >= WORD and not all(c in LOOKALIKES or c.isascii() for c in word):
                own = self.words.get(word, 0)
                options = [(n, new) for new in {*read_again(word), *other_readings(word)} if (n := self.words.get(new, 0)) > own and not DOUBTFUL.search(new)]
                if options:
                    most, new = max(options)
                    found = new, most / max(own, 1)
            self.better[word] = found
        return self.better[word]

    def by_codes(self, text: str, spelt: str) -> bool:
        """Whether the character codes spell what the text was before a wrong encoding: word by word the same or a reading
        of it that is more probable or more frequent. Codes that are themselves misread don't pass."""
        if spelt == text or _CONTROL.search(spelt) or LOST in spelt:
            return False
        own, new = text.split(" "), spelt.split(" ")
        if len(own) != len(new) or any(a != b and b not in read_again(a) and b not in other_readings(a) for a, b in zip(own, new, strict=True)):
            return False
        count = lambda w: self.words.get(w.strip(_EDGES), 0)
        return all(self.gain(" ", a, b, " ") > 0 or count(b) > count(a) for a, b in zip(own, new, strict=True) if a != b)


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """Counts (word, n) of the words with a character beyond ASCII, those of at least WORD_SHARE of all: at most 1 / WORD_SHARE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                counts.update([c for w in t.split() if not w.isascii() and (c := w.strip(_EDGES))])
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    foreign = df.filter(df[text].rlike(r"[^\x00-\x7f]")).select(text)
    counts = map_arrow(foreign, run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).filter(F.col("n") >= F.greatest(F.lit(3), WORD_SHARE * F.col("total"))).select("word", "n")


def spelt_by(codes: pa.Array, texts: list[str]) -> dict[int, str]:
    """What the code points of each row spell, where they are printable code points and differ from the row's text."""
    if pa.types.is_null(codes.type) or not len(codes):
        return {}
    offsets = codes.offsets.to_numpy()
    raw = codes.values
    values = (raw.fill_null(0) if raw.null_count else raw).to_numpy(zero_copy_only=False)
    out = {}
    for i, t in enumerate(texts):
        own = values[offsets[i] : offsets[i + 1]]
        if not len(own) or not t or own.min() < 32 or own.max() >= 0x110000:
            continue
        spelt = own.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        if spelt != t and not any("\ud800" <= c <= "\udfff" for c in spelt):
            out[i] = spelt
    return out


def from_codes(text: str, codes: list[int] | None) -> str | None:
    """The text that the character codes spell, if they agree with it wherever it is sound."""
    if not codes or any(c is None or not 0 < c < 0x110000 or 0xD800 <= c < 0xE000 for c in codes):
        return None
    spelt = "".join(map(chr, codes))
    if any(ord(c) < 32 for c in spelt) or LOST in spelt:
        return None
    sound = [p for p in text.split(LOST) if p]
    at = 0
    for part in sound:
        part = part.strip()
        at = spelt.find(part, at)
        if at < 0:
            return None
        at += len(part)
    return spelt


def restore_texts(df: DataFrame, keys: list[str], text: str, codes: str | None = None, statistics: DataFrame | None = None, buggy: str | None = None) -> DataFrame:
    """Rows whose text was read with a wrong encoding: (*`keys`, original STRING, restored BOOLEAN).

    `original` is the restored text; characters that are lost (U+FFFD) stay in it, with restored false, unless the code
    points of `codes` spell a text that agrees with all that is left. Codes that spell another text of which this one is a
    misreading restore it, and a true column `buggy` lets a smaller difference of word counts do. Null and empty texts are
    sound, and those of printable ASCII: no encoding that is tried turns other text into such. Repeated rows are each reported. `statistics` are pair counts of sound text, by default those of this column.
    No row is shuffled: the statistics are two bounded tables, and only texts with a character beyond printable ASCII reach
    Python again.
    """
    counts = statistics if statistics is not None else pair_counts(df, text, sound=True)
    sent = df.sparkSession.sparkContext.broadcast(PairModel.of(counts).sparse())
    words = df.sparkSession.sparkContext.broadcast({r.word: r.n for r in word_counts(df, text).collect()})
    kinds = df.select(*keys).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", original string, restored boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(model_of(sent), words=words.value)
        for batch in batches:
            rows, originals, whole = [], [], []
            spelt = batch.column(len(keys) + 1)
            flags = batch.column(len(keys) + 2).to_pylist()
            texts = batch.column(len(keys)).to_pylist()
            doubtful = repairer.doubtful(texts) if texts else []
            others = spelt_by(spelt, texts)
            for i, t in enumerate(texts):
                new = repairer.repair(t) if doubtful[i] else None
                again = repairer.by_words(t if new is None else new, bool(flags[i]))
                new = new if again is None else again
                if i in others and others[i] != new and repairer.by_codes(t, others[i]):
                    new = others[i]
                lost = LOST in t or _CONTROL.search(t if new is None else new) is not None
                if new is None and not (lost and doubtful[i]):
                    continue
                new = t if new is None else new
                if lost and (known := from_codes(new, spelt[i].as_py())) is not None:
                    new, lost = known, False
                rows.append(i)
                originals.append(new)
                whole.append(not lost)
            if rows:
                kept = [c.take(pa.array(rows)) for c in batch.columns[: len(keys)]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(originals), pa.array(whole)], [*keys, "original", "restored"])

    extra = df[codes].cast("array<bigint>") if codes else F.lit(None).cast("array<bigint>")
    flag = df[buggy].cast("boolean") if buggy else F.lit(None).cast("boolean")
    foreign = df.filter(df[text].rlike(SUSPECT)).select(*keys, df[text].alias("_text"), extra.alias("_codes"), flag.alias("_buggy"))
    return map_arrow(foreign, run, schema)
