"""Blocks of a page put together and taken apart: sentences over hyphens and figures, tables with repeated headers, rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.runtime import map_groups

PAGE = ("doc_id", "page")
_CLOSED = re.compile(r"[.!?:;][*_~`)\"'”’\]]*\s*$")
_SMALL = re.compile(r"^\s*[*_~]*[a-zß-öø-ÿ]")
_SOFT = re.compile(r"[^\W\d_][-‐]\s*$")


def splice_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, block, kind, text, bold, italic): paragraphs joined to the one before where that breaks off.

    A plain paragraph that ends in a soft hyphen takes in the plain one after it, without the hyphen; one that ends no sentence takes
    in what follows the figures after it, if that begins small and is as bold and slanted. The figures come after the joined
    paragraph. Blocks are numbered anew. A joined paragraph can go on again: a fold.
    """

    def run(cols: dict[str, list]) -> list[tuple]:
        out: list[list] = []
        rows = [list(r) for r in zip(*(cols[c] for c in ("kind", "text", "bold", "italic")), strict=True)]
        i = 0
        while i < len(rows):
            kind, text, bold, italic = rows[i]
            i += 1
            held: list[list] = []
            while kind == "paragraph":
                j = i
                while j < len(rows) and rows[j][0] == "figure":
                    j += 1
                if j == len(rows) or rows[j][0] != "paragraph":
                    break
                after = rows[j]
                if j == i and not (bold or italic or after[2] or after[3]) and _SOFT.search(text) and _SMALL.match(after[1]):
                    text = text.rstrip()[:-1] + after[1].lstrip()
                elif j > i and not _CLOSED.search(text) and text.strip() and _SMALL.match(after[1]) and (bold, italic) == (after[2], after[3]):
                    held += rows[i:j]
                    text = text.rstrip() + " " + after[1].lstrip()
                else:
                    break
                i = j + 1
            out += [[kind, text, bold, italic], *held]
        return [(cols["doc_id"][0], cols["page"][0], n, *b) for n, b in enumerate(out, 1)]

    known = blocks.select(*PAGE, "block", "kind", F.coalesce("text", F.lit("")).alias("text"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("bold", "italic")])
    return map_groups(known, PAGE, ["block"], run, "doc_id long, page int, block int, kind string, text string, bold boolean, italic boolean")


_NUMERIC = re.compile(r"^[\d .,%$()\-–+*/]*\d[\d .,%$()\-–+*/]*$")


def _head(row: list[str]) -> str | None:
    """What a row looks like as a header: three filled cells, a third of them numbers at most."""
    filled = [c for c in row if c.strip()]
    return "\x1f".join(" ".join(c.split()).lower() for c in row) if len(filled) >= 3 and 3 * sum(bool(_NUMERIC.match(c.strip())) for c in filled) <= len(filled) else None


def header_cuts(rows: list[list[str]]) -> list[int]:
    """Rows at which a table begins again with a header that stands among its first three rows; a lone title above goes with it."""
    cuts, begin = [], 0
    for i in range(1, len(rows)):
        key = _head(rows[i])
        if key is None or key not in [_head(r) for r in rows[begin : min(i, begin + 3)]]:
            continue
        at = i - 1 if i - 1 > begin and sum(bool(c.strip()) for c in rows[i - 1]) == 1 else i
        if at > begin:
            cuts.append(at)
            begin = at
    return cuts


def gutter(rows: list[list[str]]) -> int | None:
    """The empty column between two tables side by side whose headers share half of their cells."""
    width = max(map(len, rows), default=0)
    empty = [all(c >= len(r) or not r[c].strip() for r in rows) for c in range(width)]
    for g in range(2, width - 2):
        left = [" ".join(c.split()).lower() for c in rows[0][:g] if c.strip()]
        right = [" ".join(c.split()).lower() for c in rows[0][g + 1 :] if c.strip()]
        if empty[g] and not all(empty[:g]) and not all(empty[g + 1 :]) and min(len(left), len(right)) >= 2 and 2 * sum(c in left for c in right) >= min(len(left), len(right)):
            return g
    return None


def split_rows(rows: list[list[str]]) -> list[list[list[str]]]:
    at = gutter(rows)
    if at is not None:
        wide = [r + [""] * (at + 1 - len(r)) for r in rows]
        return [*split_rows([r[:at] for r in wide]), *split_rows([r[at + 1 :] for r in wide])]
    bounds = [0, *header_cuts(rows), len(rows)]
    return [rows[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def split_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, page, table, part, row, col, text): tables of cells (doc_id, page, table, row, col, text) taken apart at repeated headers and
    at the gutter of two tables side by side; rows and columns of each part from 1."""

    def run(cols: dict[str, list]) -> list[tuple]:
        rows = [["" for _ in range(max(cols["col"]))] for _ in range(max(cols["row"]))]
        for r, c, t in zip(cols["row"], cols["col"], cols["text"], strict=True):
            rows[r - 1][c - 1] = t or ""
        key = cols["doc_id"][0], cols["page"][0], cols["table"][0]
        return [(*key, p, r, c, t) for p, part in enumerate(split_rows(rows), 1) for r, row in enumerate(part, 1) for c, t in enumerate(row, 1)]

    return map_groups(cells.select(*PAGE, "table", "row", "col", "text"), [*PAGE, "table"], ["row", "col"], run, "doc_id long, page int, table int, part int, row int, col int, text string")


def without_repeated_rules(blocks: DataFrame) -> DataFrame:
    """Blocks without dividers at a page's beginning and end, after another divider, and on pages with nothing else."""
    w, full = Window.partitionBy(*PAGE).orderBy("block"), Window.partitionBy(*PAGE)
    content = F.when(F.col("kind") != "rule", F.col("block"))
    marked = blocks.withColumns({"_old": F.lag("kind").over(w), "_first": F.min(content).over(full), "_last": F.max(content).over(full)})
    inside = (F.col("block") > F.col("_first")) & (F.col("block") < F.col("_last")) & (F.coalesce("_old", F.lit("")) != "rule")
    return marked.filter((F.col("kind") != "rule") | inside).drop("_old", "_first", "_last")


def kept_pages(blocks: DataFrame, chosen: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Blocks of the chosen pages (doc_id, page) and of the first `most` pages of each document that remain."""
    own = blocks.join(chosen.select(*PAGE).distinct(), list(PAGE), "left_semi") if chosen is not None else blocks
    if most is None:
        return own
    return own.withColumn("_nth", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page"))).filter(F.col("_nth") <= most).drop("_nth")


def remapped_boxes(blocks: DataFrame, items: DataFrame) -> DataFrame:
    """Blocks (doc_id, page, block, item_indices ARRAY<INT>) with the union of their items' boxes in the page's own frame and the indices
    each once, in their first order. Blocks whose items are unknown have null boxes."""
    once = blocks.withColumn("item_indices", F.array_distinct("item_indices"))
    each = once.select(*PAGE, "block", F.explode("item_indices").alias("seq")).join(items.select(*PAGE, "seq", "x", "y", "width", "height"), [*PAGE, "seq"])
    right, bottom = F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))
    boxes = each.groupBy(*PAGE, "block").agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("width"), (bottom - F.min("y")).alias("height"))
    return once.join(boxes, [*PAGE, "block"], "left")
