"""One plain form of text for comparisons: folded case, no accents, one letter for look-alikes, no invisible characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import cache

import numpy as np

#: Letters of other scripts and the Latin letters that they look like.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i",
    "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ԍ": "G", "Ү": "Y", "ү": "y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    # Armenian
    "Ս": "U", "Տ": "S", "Լ": "L", "Օ": "O", "ա": "w", "հ": "h", "յ": "j", "ո": "n", "ս": "u", "օ": "o", "ց": "g", "ք": "p", "զ": "q",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮞ": "4", "Ꮟ": "b", "Ꮢ": "R",
    "Ꮤ": "W", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
}
#: Latin letters of phonetic alphabets and of Turkish, which count as their plain neighbours in comparisons only.
NEIGHBOURS = {"ɑ": "a", "ɡ": "g", "ɩ": "i", "ɪ": "i", "ı": "i", "ʏ": "y"}


def fold_char(c: str) -> str:
    """Letters and digits of a character in plain lower case; '' for anything else."""
    out = []
    for d in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", LOOKALIKES.get(c, c)).casefold()):
        d = NEIGHBOURS.get(d := LOOKALIKES.get(d, d).lower(), d)
        if d.isalnum():
            out.append(d)
    return "".join(out)


@cache
def _tables() -> tuple[np.ndarray, dict[int, str]]:
    """The folded letter of each character below 0x10000 that folds to one (0: none), and the strings of the others."""
    codes = np.zeros(0x10000, np.uint32)
    codes[0x3400:0xA000] = np.arange(0x3400, 0xA000)
    several: dict[int, str] = {}
    for p in (*range(0x3400), *range(0xA000, 0xD800), *range(0xE000, 0x10000)):
        folded = fold_char(chr(p))
        if len(folded) == 1 and ord(folded) < 0x10000:
            codes[p] = ord(folded)
        elif folded:
            several[p] = folded
    return codes, several


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def streams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The folded letters and digits of all texts one after the other, as code points, and where each text ends in them.

    They are those of `fold_word`, letter for letter: equal stretches are equal text.
    """
    table, several = _tables()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = _points("".join(texts))
    if len(points) and points.max() >= 0x80:
        present = np.zeros(0x110000, bool)
        present[points] = True
        odd = np.flatnonzero(present[0x80:]) + 0x80
        swap = {p: several[p] if p < 0x10000 else fold_char(chr(p)) for p in odd.tolist() if p in several or p >= 0x10000}
        if swap:
            present[:] = False
            present[list(swap)] = True
            changed = np.unique(np.searchsorted(sizes.cumsum(), np.flatnonzero(present[points]), "right"))
            texts = list(texts)
            for i in changed.tolist():
                texts[i] = texts[i].translate(swap)
                sizes[i] = len(texts[i])
            points = _points("".join(texts))
    beyond = points >= 0x10000  # folded by the translation already
    codes = np.where(beyond, points, table[np.where(beyond, 0, points)]) if beyond.any() else table[points]
    kept = codes > 0
    ends = np.concatenate([[0], kept.cumsum()])[sizes.cumsum()] if len(texts) else np.zeros(0, np.int64)
    return codes[kept], ends


def fold_word(word: str) -> str:
    return "".join(map(_fold_cached, word))


_fold_cached = cache(fold_char)
