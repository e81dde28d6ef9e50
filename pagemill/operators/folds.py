"""Operators whose state grows along the rows of a page: a window sees the row before, not the state.

Items of a page meet by one exchange, sorted, and whole Arrow batches of many pages run through one Python call each; a page's
items are few whatever the size of the data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.runtime import map_groups

PAGE = ("doc_id", "page")
_GEOMETRY = (*PAGE, "seq", "text", "x", "y", "width", "height", "font_size")


def _plain(items: DataFrame) -> DataFrame:
    known = [F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)).alias(c) for c in ("width", "height")]
    size = F.nanvl("font_size", F.lit(None).cast("double")).alias("font_size")
    return items.select(*PAGE, "seq", "text", "x", "y", *known, size).filter(F.col("x").isNotNull() & F.col("y").isNotNull())


def bands_of(ys: list[float], heights: list[float]) -> list[int]:
    """Line number of items sorted from top to bottom.

    An item joins the open band if it lies within half the lesser height of the band's top (0.3 for one over 24 points and
    twice the band); the band's top and height then take it in."""
    top = tall = None
    line, out = 0, []
    for y, h in zip(ys, heights, strict=True):
        size = min(max(h, 1.0), 24.0)
        factor = 0.3 if tall is not None and h > 24 and h > 2 * tall else 0.5
        if top is None or abs(y - top) >= min(tall, size) * factor:
            line, top, tall = line + 1, y, size
        else:
            top, tall = min(top, y), max(tall, size)
        out.append(line)
    return out


def band_lines(items: DataFrame) -> DataFrame:
    """(doc_id, page, seq, line): items of a page grouped to lines, from top to bottom, by the bands of `bands_of`."""

    def run(own: dict[str, list]) -> list[tuple]:
        return list(zip(own["doc_id"], own["page"], own["seq"], bands_of(own["y"], own["height"]), strict=True))

    return map_groups(_plain(items).select(*PAGE, "seq", "x", "y", "height"), PAGE, ["y", "x", "seq"], run, "doc_id long, page int, seq int, line int")


def merge_adjacent(items: DataFrame, gap: float = 1.0) -> DataFrame:
    """(doc_id, page, seq, text, x, width, members): neighbours on a row merged while the gap to the merged item is small."""

    def run(own: dict[str, list]) -> list[tuple]:
        rows: list[list] = []
        for seq, text, x, y, w, h in zip(*(own[c] for c in ("seq", "text", "x", "y", "width", "height")), strict=True):
            last = rows[-1] if rows else None
            if last and abs(y - last[0]) < 0.5 * max(h, 1.0) and -2.0 <= x - (last[3] + last[4]) <= gap:
                last[2] = (last[2] or "") + (text or "")
                last[4] = max(last[3] + last[4], x + w) - last[3]
                last[5] += 1
            else:
                rows.append([y, seq, text, x, w, 1])
        return [(own["doc_id"][0], own["page"][0], *r[1:]) for r in rows]

    return map_groups(_plain(items), PAGE, ["y", "x", "seq"], run, "doc_id long, page int, seq int, text string, x double, width double, members int")


#: Cuts: points of a bucket, share of the median density up to which a bucket is a valley, least widths of a valley in points (across)
#: and in median heights (down), how much better a cut down must be, items that are cut no more, depth.
BUCKET, SPARSE, ACROSS, DOWN, BETTER, FEW, DEPTH = 2.0, 0.10, 8.0, 1.4, 1.1, 4, 12


def best_cut(spans: list[tuple[float, float, float]], least: float) -> tuple[float, float] | None:
    """(score, position) of the best valley in the density of weighted spans (begin, end, weight): wide and empty; of equally good
    ones the first."""
    origin, end = min(a for a, _, _ in spans), max(b for _, b, _ in spans)
    if end <= origin:
        return None
    size = max(BUCKET, (end - origin) / 4096)
    n = max(1, int(-(-(end - origin) // size)))
    steps = [0.0] * (n + 1)
    for a, b, weight in spans:
        first = max(0, int((a - origin) // size))
        last = min(n, max(int(-(-(b - origin) // size)), first + 1))
        steps[first] += weight
        steps[last] -= weight
    density, now = [], 0.0
    for s in steps[:n]:
        now += s
        density.append(now)
    full = sorted(d for d in density if d > 1e-9)
    if not full:
        return None
    median = full[len(full) // 2]
    dense = [i for i, d in enumerate(density) if d > SPARSE * median]
    best = None
    for i, j in zip(dense, dense[1:], strict=False):
        width = j - i - 1
        if width and width >= max(1, -(-least // size)):
            score = width * max(0.0, 1 - sum(density[i + 1 : j]) / width / median)
            if best is None or score > best[0]:
                best = score, origin + (i + 1 + j) / 2 * size
    return best


def reading_order(items: DataFrame) -> DataFrame:
    """(doc_id, page, seq, region_path, axes, position): recursive cuts at the valleys of the density of characters, between
    columns ('V') where that valley is clearly better than the one between rows ('H'). `axes` names the cuts above an item's
    region, `position` counts the page's items in order."""

    def run(own: dict[str, list]) -> list[tuple]:
        boxes = [(x, y, max(w, 0.0), max(h, 0.0), max(len(t or ""), 1), s) for x, y, w, h, t, s in zip(*(own[c] for c in ("x", "y", "width", "height", "text", "seq")), strict=True)]
        out: list[tuple] = []
        todo = [(boxes, [], "")]
        while todo:
            part, path, axes = todo.pop()
            if len(part) > FEW and len(path) < DEPTH:
                heights = sorted(b[3] for b in part)
                across = best_cut([(b[0], b[0] + b[2], b[4]) for b in part], ACROSS)
                down = best_cut([(b[1], b[1] + b[3], b[4]) for b in part], DOWN * heights[len(heights) // 2])
                axis = "V" if across and (not down or across[0] > BETTER * down[0]) else "H" if down else ""
                if axis:
                    k, at = (0, across[1]) if axis == "V" else (1, down[1])
                    sides = [b for b in part if b[k] + b[k + 2] / 2 < at], [b for b in part if b[k] + b[k + 2] / 2 >= at]
                    if all(sides):
                        todo += [(sides[1], [*path, 1], axes + axis), (sides[0], [*path, 0], axes + axis)]
                        continue
            out += [(path, axes, b[5]) for b in sorted(part, key=lambda b: (b[1], b[0], b[5]))]
        return [(own["doc_id"][0], own["page"][0], s, p, a, i) for i, (p, a, s) in enumerate(out, 1)]

    return map_groups(_plain(items), PAGE, ["seq"], run, "doc_id long, page int, seq int, region_path array<smallint>, axes string, position int")


def search(items: DataFrame, phrase: str, case_sensitive: bool = False) -> DataFrame:
    """(doc_id, page, seq, text, x, y, width, height): places of a phrase that may run over several items.

    Items join without a blank if they touch on a line; leading items that aren't needed are left out, matches don't overlap
    and the text of a match is the phrase. A match consumes its items, so the scan is sequential. An empty phrase has no
    match; a null text is an empty one. An item more than twice as long as the phrase that lacks it ends a search.
    """
    fold = str if case_sensitive else str.lower
    wanted = fold(phrase)

    def run(own: dict[str, list]) -> list[tuple]:
        texts = [t or "" for t in own["text"]]
        x, y, w, h, size = (own[c] for c in ("x", "y", "width", "height", "font_size"))
        glue = [""]
        for i in range(1, len(texts)):
            points = size[i - 1] or size[i] or 12.0
            touch = abs(y[i] - y[i - 1]) < 0.5 * points and x[i] - (x[i - 1] + w[i - 1]) <= 0.3 * points
            glue.append("" if touch else " ")
        found, i = [], 0
        while wanted and i < len(texts):
            text, j = "", i
            while j < len(texts):
                text += (glue[j] if j > i else "") + texts[j]
                if wanted in fold(text) or len(text.encode()) > 2 * len(wanted.encode()):
                    break
                j += 1
            if j < len(texts) and wanted in fold(text):
                while i < j and wanted in fold(text[len(texts[i]) + len(glue[i + 1]) :]):
                    text = text[len(texts[i]) + len(glue[i + 1]) :]
                    i += 1
                u, v = min(x[i : j + 1]), min(y[i : j + 1])
                found.append((own["doc_id"][0], own["page"][0], own["seq"][i], phrase, u, v, max(a + b for a, b in zip(x[i : j + 1], w[i : j + 1])) - u, max(a + b for a, b in zip(y[i : j + 1], h[i : j + 1])) - v))
                i = j + 1
            else:
                i += 1
        return found

    return map_groups(_plain(items), PAGE, ["seq"], run, "doc_id long, page int, seq int, text string, x double, y double, width double, height double")


_TOKEN = r"^\s*(\(?)([a-z]{1,4}|[A-Z]{1,4}|\d{1,3})[.)]\s+\S"
_MARK = re.compile(_TOKEN)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def roman(text: str) -> int | None:
    if not text or any(c not in _ROMAN for c in text):
        return None
    values = [_ROMAN[c] for c in text]
    return sum(-v if i + 1 < len(values) and values[i + 1] > v else v for i, v in enumerate(values))


def list_runs(lines: DataFrame, aside: float = 8.0, apart: int = 12) -> DataFrame:
    """(doc_id, page, line_no, run, value): sequential markers 1. 2. 3., a) b) c), i. ii. iii. from value 1, each within 12 lines of
    the one before and 8 points beside it (column x).

    Runs nest and stay open, so the difference of value and row number does not find them; the latest open run that a marker
    continues takes it. Runs of one member are none.
    """

    def run(own: dict[str, list]) -> list[tuple]:
        held: list[dict] = []
        done: list[dict] = []
        for no, line, x in zip(own["line_no"], own["line"], own["x"], strict=True):
            m = _MARK.match(line or "")
            if not m:
                continue
            token, kinds = m[2], []
            if token.isdigit():
                kinds = [("1", int(token))]
            else:
                if len(token) == 1:
                    kinds.append(("a" if token.islower() else "A", ord(token.lower()) - 96))
                if (value := roman(token.lower())) is not None:
                    kinds.append(("i" if token.islower() else "I", value))
            held = [o for o in held if no - o["rows"][-1][0] <= apart]
            for o in reversed(held):
                if (o["kind"], o["rows"][-1][1] + 1) in kinds and abs((x or 0.0) - o["x"]) <= aside:
                    o["rows"].append((no, o["rows"][-1][1] + 1))
                    break
            else:
                for kind, value in kinds:
                    if value == 1:
                        new = {"kind": kind, "rows": [(no, 1)], "x": x or 0.0}
                        held.append(new)
                        done.append(new)
        kept = [o for o in done if len(o["rows"]) >= 2]
        return [(own["doc_id"][0], own["page"][0], n, i, v) for i, o in enumerate(kept, 1) for n, v in o["rows"]]

    marked = lines.select(*PAGE, "line_no", "line", "x").filter(F.col("line").rlike(_TOKEN))
    return map_groups(marked, PAGE, ["line_no"], run, "doc_id long, page int, line_no int, run int, value int")


def token_faults(items: DataFrame) -> DataFrame:
    """(doc_id, page, judged, malformed, misread): tokens of a page that can be judged, malformed ones, and those with signs between
    letters. Column expressions and one partial aggregation."""
    t = F.coalesce("text", F.lit(""))
    misread = F.size(F.filter(T.tokens(t), lambda w: w.rlike(r"\p{L}[!%*]\p{L}")))
    counts = items.select(*PAGE, T.judged_count(t).alias("judged"), T.malformed_count(t).alias("malformed"), misread.alias("misread"))
    return counts.groupBy(*PAGE).agg(*[F.sum(c).alias(c) for c in ("judged", "malformed", "misread")])


_LIST = re.compile(r"^\s*(?:[•◦▪‣∙·*–-]|\d{1,3}[.)])\s+\S")
_DIVIDER = re.compile(r"[-_=*~─━—.•\s]{3,}")


def classify_blocks(lines: DataFrame, sized: bool = False) -> DataFrame:
    """(doc_id, page, block, kind, text), and with `sized` the font_size of a block's first line: lines of a page to blocks by
    priority: code, divider, heading, list, table row, paragraph.

    What a line is by itself is a column; a block takes in lines while its kind goes on, a state that a window does not have.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    size = F.nanvl("font_size", F.lit(None).cast("double"))
    own = lines.select(*PAGE, "seq", "text", size.alias("font_size"), F.coalesce(F.lower("font_name").rlike("mono|courier|consol"), F.lit(False)).alias("mono"), text.alias("bare")).filter(F.col("bare") != "")

    def run(cols: dict[str, list]) -> list[tuple]:
        weights: dict[float, int] = {}
        for s, t in zip(cols["font_size"], cols["text"], strict=True):
            if s is not None:
                weights[round(s, 2)] = weights.get(round(s, 2), 0) + len(t)
        most = max(weights.values(), default=0)
        body = max((s for s, n in weights.items() if n >= most * 0.5), default=0.0)
        blocks: list[list] = []
        ended = True
        for text, bare, s, mono in zip(cols["text"], cols["bare"], cols["font_size"], cols["mono"], strict=True):
            if mono and not re.search(r"\w\s\w+\s\w", bare):
                kind = "code"
            elif _DIVIDER.fullmatch(bare):
                kind = "rule"
            elif s and s > body + 0.5 and len(bare) <= 140:
                kind = "heading"
            elif _LIST.match(bare):
                kind = "list"
            else:
                kind = "table" if " | " in bare else "paragraph"
            if blocks and kind == blocks[-1][0] and kind in ("code", "table", "paragraph") and not (kind == "paragraph" and ended):
                blocks[-1][1] += ("\n" if kind != "paragraph" else " ") + text
            elif blocks and kind == "paragraph" and blocks[-1][0] == "list" and not ended and text[:1].islower():
                blocks[-1][1] += " " + text
            else:
                blocks.append([kind, text, s])
            ended = bare[-1] in ".!?:"
        return [(cols["doc_id"][0], cols["page"][0], i, *b[: 2 + sized]) for i, b in enumerate(blocks, 1)]

    return map_groups(own, PAGE, ["seq"], run, "doc_id long, page int, block int, kind string, text string" + ", font_size double" * sized)
