"""Glyphs of a formula as TeX: scripts by their place, fractions by their bars, roots, accents, Greek letters and signs."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

#: Signs and the TeX commands for them.
SIGNS = {
    "∑": r"\sum", "∏": r"\prod", "∫": r"\int", "√": r"\sqrt", "∞": r"\infty", "≤": r"\leq", "≥": r"\geq", "≠": r"\neq", "≈": r"\approx", "≡": r"\equiv", "±": r"\pm", "×": r"\times", "÷": r"\div", "·": r"\cdot", "→": r"\to", "←": r"\leftarrow",
    "⇒": r"\Rightarrow", "⇔": r"\Leftrightarrow", "∈": r"\in", "∉": r"\notin", "⊂": r"\subset", "⊆": r"\subseteq", "∪": r"\cup", "∩": r"\cap", "∅": r"\emptyset", "∀": r"\forall", "∃": r"\exists", "¬": r"\neg", "∧": r"\wedge", "∨": r"\vee",
    "∂": r"\partial", "∇": r"\nabla", "−": "-", "′": "'", "…": r"\ldots", "⟨": r"\langle", "⟩": r"\rangle", "ℝ": r"\mathbb{R}", "ℕ": r"\mathbb{N}", "ℤ": r"\mathbb{Z}", "{": r"\{", "}": r"\}", "%": r"\%", "&": r"\&", "#": r"\#", "_": r"\_",
}
#: Accents that stand above a letter.
ACCENTS = {"ˆ": "hat", "̂": "hat", "˜": "tilde", "̃": "tilde", "¯": "bar", "̄": "bar", "˙": "dot", "̇": "dot", "¨": "ddot", "̈": "ddot", "→": "vec"}


@dataclass
class Glyph:
    text: str
    x: float
    y: float
    width: float
    height: float

    @property
    def middle(self) -> float:
        return self.y + self.height / 2


@dataclass
class Bar:
    x: float
    y: float
    width: float


def command(text: str) -> str:
    """TeX of one character."""
    if text in SIGNS:
        return SIGNS[text]
    name = unicodedata.name(text, "") if len(text) == 1 else ""
    if name.startswith("GREEK") and "LETTER" in name and len(name.split()) == 4:
        word = name.split()[-1].lower()
        plain = {"lamda": "lambda", "omicron": "o"}.get(word, word)
        if plain == "o":
            return "O" if "CAPITAL" in name else "o"
        return "\\" + (plain.capitalize() if "CAPITAL" in name else plain)
    return unicodedata.normalize("NFKC", text)


def tex(glyphs: list[Glyph], bars: list[Bar] | None = None) -> str:
    """The formula of glyphs in points from the top left, with the bars of its fractions and roots. Empty for no glyphs."""
    bars = sorted(bars or [], key=lambda b: -b.width)
    glyphs = [g for g in glyphs if g.text.strip()]
    if not glyphs:
        return ""
    for bar in bars:
        over = [g for g in glyphs if bar.x - 1 <= g.x + g.width / 2 <= bar.x + bar.width + 1]
        above, below = [g for g in over if g.middle < bar.y], [g for g in over if g.middle >= bar.y]
        rest = [b for b in bars if b is not bar]
        inner = lambda own: [b for b in rest if own and min(g.x for g in own) - 1 <= b.x + b.width / 2 <= max(g.x + g.width for g in own) + 1]
        root = next((g for g in glyphs if g.text == "√" and abs(g.x + g.width - bar.x) <= 0.5 * max(g.width, 2.0)), None)
        if root is not None and below and not above:
            whole = f"\\sqrt{{{tex(below, inner(below))}}}"
            used = {id(g) for g in (*below, root)}
        elif above and below:
            near = max(b.height for b in (*above, *below)) * 2.5
            above, below = [g for g in above if bar.y - g.middle <= near], [g for g in below if g.middle - bar.y <= near]
            if not above or not below:
                continue
            whole = f"\\frac{{{tex(above, [b for b in inner(above) if b.y < bar.y])}}}{{{tex(below, [b for b in inner(below) if b.y > bar.y])}}}"
            used = {id(g) for g in (*above, *below)}
        else:
            continue
        kept = [g for g in glyphs if id(g) not in used]
        size = sorted(g.height for g in glyphs)[-1]
        box = Glyph(whole, root.x if root else bar.x, bar.y - size / 2, bar.width, size)
        outside = [b for b in rest if not bar.x - 1 <= b.x + b.width / 2 <= bar.x + bar.width + 1]
        return _row([*kept, box], outside) if not outside else tex([*kept, box], outside)
    return _row(glyphs, [])


def _row(glyphs: list[Glyph], bars: list[Bar]) -> str:
    """Glyphs of a row with those that stand smaller above and below as scripts of what is before them."""
    glyphs = sorted(glyphs, key=lambda g: g.x)
    tall = sorted(g.height for g in glyphs)[-1]
    large = [g for g in glyphs if g.height >= 0.8 * tall]
    middle = sorted(g.middle for g in large)[len(large) // 2]
    out: list[str] = []
    i = 0
    while i < len(glyphs):
        g = glyphs[i]
        shift = middle - g.middle
        if g.text in ACCENTS and out and shift > 0.3 * tall:
            out[-1] = f"\\{ACCENTS[g.text]}{{{out[-1]}}}"
        elif g.height < 0.8 * tall and abs(shift) > 0.15 * tall and out:
            scripts: dict[str, list[Glyph]] = {"^": [], "_": []}
            while i < len(glyphs) and glyphs[i].height < 0.8 * tall and abs(middle - glyphs[i].middle) > 0.15 * tall:
                scripts["^" if glyphs[i].middle < middle else "_"].append(glyphs[i])
                i += 1
            for sign in "_^":
                if scripts[sign]:
                    own = _row(scripts[sign], bars)
                    out[-1] += sign + (own if len(own) == 1 else f"{{{own}}}")
            continue
        else:
            out.append(g.text if g.text.startswith("\\") else command(g.text))
        i += 1
    text = ""
    for part in out:
        gap = text and text[-1].isalpha() and "\\" in text[-12:] and part[:1].isalpha() and text.rsplit("\\", 1)[-1].isalpha()
        text += (" " if gap else "") + part
    return text
