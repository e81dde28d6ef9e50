"""From glyphs to characters: names of glyphs, and the character maps inside font files."""

from __future__ import annotations

import re
import struct
import unicodedata

#: Glyph names of punctuation and signs that are not formed from a character's own name.
NAMES = dict(
    pair.split("=", 1)
    for pair in (
        "space=  exclam=! quotedbl=\" numbersign=# dollar=$ percent=% ampersand=& quotesingle=' parenleft=( parenright=) asterisk=* plus=+ comma=, hyphen=- period=. slash=/ colon=: semicolon=; less=< equal== greater=> "
        "question=? at=@ bracketleft=[ backslash=\\ bracketright=] asciicircum=^ underscore=_ grave=` braceleft={ bar=| braceright=} asciitilde=~ quoteleft=‘ quoteright=’ quotedblleft=“ quotedblright=” quotesinglbase=‚ quotedblbase=„ "
        "guilsinglleft=‹ guilsinglright=› guillemotleft=« guillemotright=» endash=– emdash=— bullet=• ellipsis=… dagger=† daggerdbl=‡ fraction=⁄ florin=ƒ exclamdown=¡ questiondown=¿ cent=¢ sterling=£ yen=¥ currency=¤ Euro=€ section=§ "
        "paragraph=¶ degree=° copyright=© registered=® trademark=™ mu=µ plusminus=± multiply=× divide=÷ minus=− brokenbar=¦ logicalnot=¬ ordfeminine=ª ordmasculine=º onehalf=½ onequarter=¼ threequarters=¾ periodcentered=· "
        "germandbls=ß AE=Æ ae=æ OE=Œ oe=œ Oslash=Ø oslash=ø Lslash=Ł lslash=ł dotlessi=ı Eth=Ð eth=ð Thorn=Þ thorn=þ fi=fi fl=fl ff=ff ffi=ffi ffl=ffl"
    ).replace("=  ", "=\xa0 ").split(" ")
)
NAMES["space"] = " "
#: Endings of the names of accented letters, and the marks that they stand for.
ACCENTS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "cedilla": "̧", "caron": "̌", "ring": "̊", "macron": "̄", "breve": "̆", "ogonek": "̨", "dotaccent": "̇", "hungarumlaut": "̋"}
_DIGITS = {n: str(i) for i, n in enumerate("zero one two three four five six seven eight nine".split())}
_GREEK = {unicodedata.name(chr(p)).rsplit(" ", 1)[-1].lower(): chr(p) for p in range(0x3B1, 0x3CA) if p != 0x3C2}
_POINTS = re.compile(r"^(?:uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6}))$")


def glyph_text(name: str) -> str | None:
    """The text of a glyph of this name, ligatures taken apart; None for an unknown one. What follows a dot only names a variant, an
    underscore joins parts."""
    base = name.split(".", 1)[0]
    if not base:
        return None
    if "_" in base:
        parts = [glyph_text(p) for p in base.split("_")]
        return None if None in parts else "".join(parts)
    if base in NAMES:
        return NAMES[base]
    if len(base) == 1 and base.isascii() and base.isalpha():
        return base
    if base in _DIGITS:
        return _DIGITS[base]
    if m := _POINTS.match(base):
        points = [int(m[1][i : i + 4], 16) for i in range(0, len(m[1]), 4)] if m[1] else [int(m[2], 16)]
        return "".join(map(chr, points)) if all(p < 0x110000 and not 0xD800 <= p < 0xE000 for p in points) else None
    for ending, mark in ACCENTS.items():
        if base.endswith(ending) and len(base) == len(ending) + 1 and base[0].isalpha():
            composed = unicodedata.normalize("NFC", base[0] + mark)
            return composed if len(composed) == 1 else None
    greek = _GREEK.get(base.lower())
    return (greek.upper() if base[0].isupper() else greek) if greek else None


def reverse_cmap(font: bytes) -> dict[int, int] | None:
    """Glyph number to character of a TrueType or OpenType font's best Unicode table; of several characters the least. None for what
    is no such font."""
    try:
        count = struct.unpack(">H", font[4:6])[0]
        at = next(struct.unpack(">I", font[r + 8 : r + 12])[0] for r in range(12, 12 + 16 * count, 16) if font[r : r + 4] == b"cmap")
        best = None
        for i in range(struct.unpack(">H", font[at + 2 : at + 4])[0]):
            platform, encoding, offset = struct.unpack(">HHI", font[at + 4 + 8 * i : at + 12 + 8 * i])
            kind = struct.unpack(">H", font[at + offset : at + offset + 2])[0]
            unicode_ = platform == 0 or platform == 3 and encoding in (1, 10)
            if unicode_ and kind in (4, 12) and (best is None or kind > best[0]):
                best = kind, at + offset
        return None if best is None else _segments(font, best[1]) if best[0] == 4 else _groups(font, best[1])
    except (struct.error, StopIteration, IndexError):
        return None


def _groups(font: bytes, at: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for i in range(struct.unpack(">I", font[at + 12 : at + 16])[0]):
        first, last, glyph = struct.unpack(">III", font[at + 16 + 12 * i : at + 28 + 12 * i])
        for p in range(first, min(last, 0x10FFFF) + 1):
            out.setdefault(glyph + p - first, p)
    return out


def _segments(font: bytes, at: int) -> dict[int, int]:
    n = struct.unpack(">H", font[at + 6 : at + 8])[0] // 2
    word = lambda pos: struct.unpack(">H", font[pos : pos + 2])[0]
    ends, starts, deltas, ranges = at + 14, at + 16 + 2 * n, at + 16 + 4 * n, at + 16 + 6 * n
    out: dict[int, int] = {}
    for i in range(n):
        first, last, delta, jump = word(starts + 2 * i), word(ends + 2 * i), word(deltas + 2 * i), word(ranges + 2 * i)
        for p in range(first, last + 1):
            if p == 0xFFFF:
                continue
            glyph = (p + delta) & 0xFFFF if not jump else word(ranges + 2 * i + jump + 2 * (p - first))
            if jump and glyph:
                glyph = (glyph + delta) & 0xFFFF
            if glyph:
                out[glyph] = min(p, out.get(glyph, p))
    return out
