"""Lines and the text grid of a page: what stands where, as characters in rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import bidi as B
from pagemill.operators import spatial as J
from pagemill.operators.folds import bands_of
from pagemill.runtime import map_groups

PAGE = ("doc_id", "page")


def line_aggregates(items: DataFrame) -> DataFrame:
    """(doc_id, page, line, text, x, y, width, height, font_size, estimated, font_name, all_bold, all_mono, rtl) of items with a line.

    Pieces stand by x, from the right where they run so. The size, the height and the font are those of most characters (the
    larger of equal ones); a size of 1.5 and less is none, and the height estimates it, as it does where most characters are
    recognised ones. Boldness and fixed width need more than half of the characters.
    """
    n = F.greatest(F.char_length(F.coalesce("text", F.lit(""))), F.lit(1))
    name = F.lower(F.coalesce("font_name", F.lit("")))
    own = items.withColumns({"n": n, "bold": F.coalesce(F.col("font_weight") >= 600, F.lit(False)) | name.rlike("bold|black|heavy"), "mono": name.rlike("mono|courier|consol")})
    keys = [*PAGE, "line"]

    def mode(c: str) -> Column:
        """Of a line's few items the value with most characters, the larger of equal ones."""
        known = F.filter("parts", lambda p: p[c].isNotNull())
        weight = lambda v: F.aggregate(F.filter(known, lambda p: p[c] == v), F.lit(0).cast("bigint"), lambda n, p: n + p["n"])
        return F.array_max(F.transform(F.array_distinct(F.transform(known, lambda p: p[c])), lambda v: F.struct(weight(v).alias("w"), v.alias("v"))))["v"]

    pieces = F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("x", "seq", "text")))), lambda s: s["text"])
    right, bottom = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    lines = own.groupBy(*keys).agg(
        pieces.alias("pieces"), F.collect_list(F.struct(F.col("n").cast("bigint").alias("n"), "font_size", "height", "font_name")).alias("parts"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(right).alias("right"), F.max(bottom).alias("bottom"), F.sum("n").alias("n"),
        F.sum(F.when(F.col("bold"), F.col("n")).otherwise(0)).alias("bold"), F.sum(F.when(F.col("mono"), F.col("n")).otherwise(0)).alias("mono"), F.sum(F.when(F.col("confidence").isNotNull(), F.col("n")).otherwise(0)).alias("read"),
    )
    lines = lines.withColumns({f"most_{c}": mode(c) for c in ("font_size", "height", "font_name")})
    tiny = F.coalesce(F.col("most_font_size") <= 1.5, F.lit(True))
    return lines.select(
        *keys, B.joined(F.col("pieces")).alias("text"), "x", "y", (F.col("right") - F.col("x")).alias("width"), (F.col("bottom") - F.col("y")).alias("height"),
        F.when(tiny, F.col("most_height")).otherwise(F.col("most_font_size")).alias("font_size"), (tiny | (2 * F.col("read") > F.col("n"))).alias("estimated"), F.col("most_font_name").alias("font_name"),
        (2 * F.col("bold") > F.col("n")).alias("all_bold"), (2 * F.col("mono") > F.col("n")).alias("all_mono"), B.is_rtl(F.array_join("pieces", "")).alias("rtl"),
    )


def textbox_medians(items: DataFrame) -> DataFrame:
    """(doc_id, page, char_width, char_height): medians over a page's boxes, a box's width shared by its characters."""
    each = F.col("width") / F.nullif(F.char_length("text"), F.lit(0))
    return items.filter((F.col("width") > 0) & (F.col("height") > 0)).groupBy(*PAGE).agg(F.round(F.median(each), 4).alias("char_width"), F.round(F.median("height"), 4).alias("char_height"))


def blank_segments(rows: DataFrame) -> DataFrame:
    """(doc_id, page, segment, first, last): blocks of grid rows (doc_id, page, row, empty) between two empty rows in a row; a block
    takes in what follows it up to the second empty row, the last one up to the end. A page of empty rows is one block."""
    w = Window.partitionBy(*PAGE).orderBy("row")
    ends = F.col("empty") & F.coalesce(F.lag("empty").over(w), F.lit(False))
    cut = rows.withColumn("part", F.coalesce(F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = Window.partitionBy(*PAGE)
    known = cut.withColumns({"any": F.min("empty").over(whole), "from": F.min("row").over(whole), "upto": F.max("row").over(whole)})
    parts = known.groupBy(*PAGE, "part").agg(F.min(F.when(~F.col("empty"), F.col("row"))).alias("first"), F.max("row").alias("last"), F.first("any").alias("any"), F.first("from").alias("from"), F.first("upto").alias("upto"))
    kept = parts.filter(F.col("first").isNotNull() | (F.col("any") & (F.col("part") == 0)))
    nth = F.row_number().over(Window.partitionBy(*PAGE).orderBy("part"))
    return kept.select(*PAGE, nth.alias("segment"), F.coalesce("first", "from").alias("first"), F.when(F.col("any"), F.col("upto")).otherwise(F.col("last")).alias("last"))


def anchor_key(x: Column) -> Column:
    """Quarter points, by which left, right and middle anchors meet."""
    return F.round(x * 4).cast("int")


def anchored(items: DataFrame, share: float = 0.05, height: float = 792.0) -> DataFrame:
    """(doc_id, page, seq, anchor, y) of items whose left edge stands in line with that of another one not further than `share` of the
    page's height above or below."""
    keyed = items.select(*PAGE, "seq", "x", "y", anchor_key(F.col("x")).alias("anchor")).filter(F.col("anchor").isNotNull())
    w = Window.partitionBy(*PAGE, "anchor").orderBy("y", "seq")
    near = F.least(F.col("y") - F.lag("y").over(w), F.lead("y").over(w) - F.col("y"))
    return keyed.withColumn("near", near).filter(F.col("near") < share * height).drop("near")


def clear_anchors(anchors: DataFrame, items: DataFrame) -> DataFrame:
    """Anchors of (doc_id, page, seq, anchor, y) without those that other text crosses between every two members that follow each
    other; an anchor of one member stays."""
    w = Window.partitionBy(*PAGE, "anchor").orderBy("y", "seq")
    spans = anchors.withColumn("below", F.lead("y").over(w)).filter(F.col("below").isNotNull()).select(*PAGE, "anchor", "seq", (F.col("anchor") / 4.0).alias("ax"), "y", "below")
    own = spans.select(*PAGE, "anchor", F.col("seq").alias("first"), "ax", F.col("y").alias("top"), "below")
    met = J.pairs(own, J.native_boxes(items), (F.col("ax"), F.col("top"), F.lit(0.0), F.col("below") - F.col("top")), J.box(*J.OTHER))
    crossed = met.filter((F.col("ny") > F.col("top")) & (F.col("ny") < F.col("below")) & (F.col("nx") < F.col("ax")) & (F.col("nx") + F.col("nw") > F.col("ax"))).select(*PAGE, "anchor", "first").distinct()
    clear = own.join(crossed, [*PAGE, "anchor", "first"], "left_anti").select(*PAGE, "anchor").distinct()
    several = own.select(*PAGE, "anchor").distinct()
    return anchors.join(several.join(clear, [*PAGE, "anchor"], "left_anti"), [*PAGE, "anchor"], "left_anti")


def aligned_floating(floating: DataFrame, anchors: DataFrame, margin: float = 4.0) -> DataFrame:
    """Boxes (doc_id, page, line, seq, x) with the nearest anchor (doc_id, page, line, anchor) on the line above or below that is within
    the margin; of equally near ones the one above, then the leftmost. null for none."""
    beside = anchors.select(*PAGE, F.explode(F.array(F.struct((F.col("line") + 1).alias("line"), F.lit(0).alias("side")), F.struct((F.col("line") - 1).alias("line"), F.lit(1).alias("side")))).alias("b"), "anchor")
    met = floating.join(beside.select(*PAGE, "b.line", "b.side", "anchor").distinct(), [*PAGE, "line"])
    away = F.abs(F.col("anchor") / 4.0 - F.col("x"))
    best = met.filter(away <= margin).groupBy(*PAGE, "line", "seq").agg(F.min(F.struct(away.alias("away"), "side", "anchor"))["anchor"].alias("anchor"))
    return floating.join(best, [*PAGE, "line", "seq"], "left")


def without_gutter_numbers(items: DataFrame, width: float = 612.0, least: int = 3) -> DataFrame:
    """Items without line numbers in the middle gutter: one or two digits (an O may stand for a last zero) that stand alone on their
    baseline, where at least `least` baselines have such numbers. One below all other text is a page number and stays."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    centre = F.col("x") + F.col("width") / 2
    number = F.coalesce(t.rlike("^[0-9]{1,2}O?$") & (centre > width / 2 - 5) & (centre < width / 2 + 20) & (F.col("width") < 15), F.lit(False))
    row = F.round("y").cast("int")
    own = items.withColumns({"_number": number, "_row": row})
    page, line = Window.partitionBy(*PAGE), Window.partitionBy(*PAGE, "_row")
    rows = F.size(F.collect_set(F.when(F.col("_number"), F.col("_row"))).over(page))
    alone = ~F.max(~F.col("_number")).over(line)
    lowest = F.max(F.when(~F.col("_number"), F.col("y"))).over(page)
    marked = own.withColumns({"_rows": rows, "_alone": alone, "_lowest": lowest})
    gone = F.col("_number") & F.col("_alone") & (F.col("_rows") >= least) & ~F.coalesce(F.col("y") > F.col("_lowest"), F.lit(True))
    return marked.filter(~gone).drop("_number", "_row", "_rows", "_alone", "_lowest")


def scripts(items: DataFrame) -> DataFrame:
    """(doc_id, page, seq, script 'sup' | 'sub') of raised and lowered small items of lines (doc_id, page, line).

    The line's body height is the median of its characters, its base the upper median of the bottoms of tall items. Small items
    of up to six characters that end above it are raised, those that reach below it lowered; a row of them counts if it is
    short and stands close to the body. Formulas and recognised items are left out.
    """

    def run(own: dict[str, list]) -> list[tuple]:
        rows = sorted(zip(own["x"], own["y"], own["width"], own["height"], own["text"], own["seq"], strict=True))
        count = [len(re.sub(r"\s", "", r[4])) for r in rows]
        heights = sorted((r[3], n) for r, n in zip(rows, count, strict=True) if r[3] > 0)
        total, upto, body = sum(n for _, n in heights), 0, 0.0
        if total < 4:
            return []
        for h, n in heights:
            upto += n
            if 2 * upto >= total:
                body = h
                break
        bottoms = sorted(r[1] + r[3] for r in rows if r[3] >= 0.9 * body)
        if not bottoms or body <= 0:
            return []
        base = bottoms[len(bottoms) // 2]
        kinds: list[str | None] = []
        for r in rows:
            n, bottom = len(r[4].strip()), r[1] + r[3]
            small = 0 < n <= 6 and r[3] <= 0.78 * body
            kinds.append("sup" if small and bottom <= base - 0.2 * body else "sub" if small and bottom >= base + 0.1 * body and r[1] >= base - 0.6 * body else None)
        i, out = 0, []
        while i < len(rows):
            j = i
            while j < len(rows) and kinds[j]:
                j += 1
            if j > i:
                before = i > 0 and rows[i][0] - (rows[i - 1][0] + rows[i - 1][2]) <= 0.5 * body
                after = j < len(rows) and rows[j][0] - (rows[j - 1][0] + rows[j - 1][2]) <= 0.5 * body
                if j - i < 3 and sum(count[i:j]) <= 8 and (before or after):
                    out += [(own["doc_id"][0], own["page"][0], rows[k][5], kinds[k]) for k in range(i, j)]
            i = max(j, i + 1)
        return out

    native = items.filter(F.col("confidence").isNull() & ~F.coalesce("math", F.lit(False)) & F.col("text").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    own = native.select(*PAGE, "line", "seq", "text", "x", "y", F.coalesce("width", F.lit(0.0)).alias("width"), F.coalesce("height", F.lit(0.0)).alias("height"))
    return map_groups(own, [*PAGE, "line"], ["x", "seq"], run, "doc_id long, page int, seq int, script string")


def squeezed(line: str, least: int = 4, to: int = 2) -> str:
    """A line with each run of at least so many blanks made shorter."""
    return re.sub(rf" {{{least},}}", " " * to, line)


def cleaned_rows(rows: Sequence[str]) -> list[str]:
    """Rows of a page's text without zero bytes, blank margins, blanks at their ends and their common indent; in a long block between
    empty rows that is over 80 % blanks, wide gaps are made narrow."""
    out = [r.replace("\0", " ").rstrip() for r in rows]
    while out and not out[0]:
        out.pop(0)
    while out and not out[-1]:
        out.pop()
    indent = min((len(r) - len(r.lstrip(" ")) for r in out if r), default=0)
    out = [r[indent:] for r in out]
    begin = 0
    for i in range(len(out) + 1):
        if i == len(out) or not out[i]:
            size = sum(map(len, out[begin:i]))
            if size >= 500 and sum(c.isspace() for r in out[begin:i] for c in r) > 0.8 * size:
                out[begin:i] = map(squeezed, out[begin:i])
            begin = i + 1
    return out


def grid(boxes: list[tuple[float, float, float, float, str]]) -> list[str]:
    """Rows of characters that show where boxes (x, y, width, height, text) stand.

    Lines are bands; a character is as wide as the median of the boxes. A box begins at the column of its left edge, or later
    where the text before it reaches further, and then all boxes below it with the same left edge move along. Gaps between
    lines of more than 1.8 heights are empty rows, two at most.
    """
    boxes = sorted((b for b in boxes if b[4].strip()), key=lambda b: (b[1], b[0]))
    if not boxes:
        return []
    widths = sorted(b[2] / len(b[4]) for b in boxes if b[2] > 0)
    wide = max(widths[len(widths) // 2], 0.5) if widths else 5.0
    heights = sorted(max(b[3], 1.0) for b in boxes)
    tall = heights[len(heights) // 2]
    origin = min(b[0] for b in boxes)
    numbers = bands_of([b[1] for b in boxes], [b[3] for b in boxes])
    lines: list[list] = [[] for _ in range(numbers[-1])]
    for b, n in zip(boxes, numbers, strict=True):
        lines[n - 1].append(b)
    moved: dict[int, int] = {}
    out: list[str] = []
    bottom = None
    for line in lines:
        top = min(b[1] for b in line)
        if bottom is not None:
            out += [""] * min(2, max(0, int((top - bottom) / tall - 0.8)))
        row = ""
        for b in sorted(line, key=lambda b: b[0]):
            edge = round(b[0] / 2)
            at = max(round((b[0] - origin) / wide), moved.get(edge, 0), len(row) + (1 if row else 0))
            if at > round((b[0] - origin) / wide):
                moved[edge] = at
            row = row.ljust(at) + b[4]
        out.append(row)
        bottom = max(b[1] + max(b[3], 1.0) for b in line)
    return out


def grid_pages(items: DataFrame) -> DataFrame:
    """(doc_id, page, text): each page as a grid of characters. The columns that boxes are moved to grow down the page, so a page is
    one fold."""

    def run(own: dict[str, list]) -> list[tuple]:
        boxes = list(zip(own["x"], own["y"], own["width"], own["height"], own["text"], strict=True))
        return [(own["doc_id"][0], own["page"][0], "\n".join(cleaned_rows(grid(boxes))))]

    known = items.filter(F.col("text").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    own = known.select(*PAGE, "seq", "text", "x", "y", F.coalesce("width", F.lit(0.0)).alias("width"), F.coalesce("height", F.lit(0.0)).alias("height"))
    return map_groups(own, PAGE, ["y", "x", "seq"], run, "doc_id long, page int, text string")
