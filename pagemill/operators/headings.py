"""Headings beside those that a size tells: tags, outline entries, bold lines; wraps of headings; what is no line of the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.runtime import map_groups

PAGE = ["doc_id", "page"]
LEVELS = 6


def sideways(rotation: Column) -> Column:
    """Whether text runs over 5 degrees off the horizontal."""
    r = F.abs(F.coalesce(rotation, F.lit(0.0))) % 360.0
    return ~((r < 5) | r.between(175, 185) | (r >= 355))


def without_furniture(lines: DataFrame) -> DataFrame:
    """Lines without those that run sideways, unless these have 30 % of the page's characters and are its text."""
    side = sideways(F.col("rotation"))
    n = F.char_length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s", ""))
    whole = Window.partitionBy(*PAGE)
    share = F.sum(F.when(side, n).otherwise(0)).over(whole) * 10 >= 3 * F.sum(n).over(whole)
    return lines.withColumn("content", share & (F.sum(n).over(whole) > 0)).filter(~side | F.col("content")).drop("content")


def without_stray(items: DataFrame) -> DataFrame:
    """Items of lines (doc_id, page, line) without sideways ones where the upright ones have more characters."""
    side = sideways(F.col("rotation"))
    n = F.char_length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s", ""))
    own = Window.partitionBy(*PAGE, "line")
    stray = F.sum(F.when(side, n).otherwise(0)).over(own) < F.sum(F.when(side, 0).otherwise(n)).over(own)
    return items.withColumn("stray", stray).filter(~side | ~F.col("stray")).drop("stray")


def tag_levels(lines: DataFrame, tags: DataFrame) -> DataFrame:
    """Lines with the level of the first tag (doc_id, page, pos, role, mcids ARRAY<INT>) H1 to H6 that has their mark; null for none."""
    named = tags.withColumn("level", F.regexp_extract(F.trim("role"), r"^[Hh]([1-6])$", 1)).filter("level <> ''")
    marks = named.select(*PAGE, "pos", F.col("level").cast("int").alias("level"), F.explode("mcids").alias("mcid"))
    first = marks.groupBy(*PAGE, "mcid").agg(F.min_by("level", "pos").alias("tag_level"))
    return lines.join(first, [*PAGE, "mcid"], "left")


def outline_levels(lines: DataFrame, outline: DataFrame, page_height: float = 792.0) -> DataFrame:
    """Lines (doc_id, page, seq, text, y, height) with the level of the first outline entry (doc_id, page, pos, level, title, y_pdf)
    of their page that they are: one text begins with the other, the entry's place (from the bottom) is within one and a
    half heights if it has one on the page, and the line is no running text."""
    norm = lambda c: F.lower(T.collapse_whitespace(c))
    entries = outline.select(*PAGE, "pos", F.col("level").alias("l"), norm(F.col("title")).alias("title"), "y_pdf").filter("title <> ''")
    own = lines.select(*PAGE, "seq", norm(F.col("text")).alias("norm"), "y", "height").filter("norm <> ''")
    at = page_height - F.col("y_pdf")
    near = F.col("y_pdf").isNull() | (at < 0) | (at > page_height) | (F.abs(at - F.col("y")) <= 1.5 * F.greatest("height", F.lit(1.0)))
    size, title = F.char_length("norm"), F.char_length("title")
    breaks = (F.char_length("norm") - F.char_length(F.replace("norm", F.lit(". "), F.lit("")))) / 2
    fits = (size <= F.greatest(title * 3, F.lit(120))) & (breaks < 2) & ~((breaks >= 1) & (size > title + 15))
    same = F.startswith("norm", "title") | F.startswith("title", "norm")
    # begins with the other: equal first characters bring them together before anything longer is compared
    met = own.withColumn("k", F.substring("norm", 1, 1)).join(entries.withColumn("k", F.substring("title", 1, 1)), [*PAGE, "k"]).filter(near & fits & same)
    first = met.groupBy(*PAGE, "seq").agg(F.min_by(F.least("l", F.lit(LEVELS)), "pos").alias("outline_level"))
    return lines.join(first, [*PAGE, "seq"], "left")


def alpha_ratio(c: Column) -> Column:
    """Share of letters among the characters that are no blanks."""
    return F.char_length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.nullif(F.char_length(F.regexp_replace(c, r"(?U)\s", "")), F.lit(0))


def continues(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether line b goes on with the paragraph of line a: size, boldness, indent and gap (columns size, bold, x, y, height)."""
    return (F.abs(a["size"] - b["size"]) <= 0.5) & (a["bold"] == b["bold"]) & (b["x"] - a["x"] <= 6) & (b["y"] - (a["y"] + a["height"]) <= 1.5 * F.greatest(a["height"], b["height"]))


def bold_headings(lines: DataFrame, most: int = 80) -> DataFrame:
    """Lines that are headings by their boldness alone: short, bold from end to end, no caption, attribution, sentence, run-in head
    or row of cells, beginning with no small letter, letters for half of them, and a paragraph of their own between their
    neighbours (a bold line may follow)."""
    w = Window.partitionBy(*PAGE).orderBy("seq")
    size, bold = F.coalesce("font_size", "height"), F.coalesce(F.col("font_weight") >= 600, F.lit(False))
    own = lines.withColumns({"size": size, "bold": bold})
    now = {c: F.col(c) for c in ("size", "bold", "x", "y", "height")}
    before, after = ({c: f(c).over(w) for c in now} for f in (F.lag, F.lead))
    t = F.trim("text")
    head = F.regexp_extract(t, r"^(.*?)(?:\. |: )(.*)$", 1)
    rest = F.trim(F.regexp_extract(t, r"^(.*?)(?:\. |: )(.*)$", 2))
    words = F.size(F.filter(F.split(rest, r"\s+"), lambda x: x != ""))
    run_in = (rest != "") & ~head.rlike(r"^(?:(?:Sec|Section|Ch|Chapter|Part|§)\.?\s+)?[0-9]+(?:\.[0-9]+)*$") & rest.rlike("^[A-Z]") & (((words >= 2) & t.endswith("-")) | ((words >= 3) & (F.char_length(t) > 50)))
    fits = (
        (t != "") & (F.char_length(t) <= most) & ~T.is_caption(t) & ~T.is_attribution(t) & F.col("bold") & ~t.endswith(".") & ~run_in & ~t.rlike(r"^\p{Ll}")
        & (alpha_ratio(t) >= 0.5) & ~t.rlike(r"\S {2,}\S.* {2,}\S")
    )
    alone = F.lag("seq").over(w).isNull() | ~F.coalesce(continues(before, now), F.lit(False))
    ends = F.lead("seq").over(w).isNull() | ~F.coalesce(continues(now, after), F.lit(False)) | F.coalesce(after["bold"], F.lit(False))
    return own.withColumn("heading", F.coalesce(fits, F.lit(False)) & alone & ends).filter("heading").drop("size", "bold", "heading")


def wrapped_headings(lines: DataFrame, most: int = 140) -> DataFrame:
    """(doc_id, page, seq, level, text, lines): heading lines (level not null) of one level that follow each other, joined while the
    text stays within `most` characters; beyond that a new heading begins. The length so far is a state that no window has."""

    def join(own: dict[str, list]) -> list[tuple]:
        out: list[list] = []
        last = None
        for seq, level, text in zip(own["seq"], own["level"], own["text"], strict=True):
            if level is not None:
                t = (text or "").strip()
                if last == level and len(out[-1][2]) + 1 + len(t) <= most:
                    out[-1][2] += " " + t
                    out[-1][3] += 1
                else:
                    out.append([seq, level, t, 1])
            last = level
        return [(own["doc_id"][0], own["page"][0], *h) for h in out]

    return map_groups(lines.select(*PAGE, "seq", "level", "text"), PAGE, ["seq"], join, "doc_id long, page int, seq int, level int, text string, lines int")


def heading_levels(lines: DataFrame, sizes: DataFrame, contents: DataFrame) -> DataFrame:
    """Lines with `level`: that of their tag, else of the outline (not on pages of contents), else of their size (the first within
    0.6), else 1 for the title of contents. Sizes don't count for captions, attributions, sideways or long lines and for
    lines that break off inside a word.

    `lines` have tag_level and outline_level; `sizes` (doc_id, size, level) come from the document; `contents` (doc_id, page).
    """
    near = lines.join(sizes.withColumnRenamed("level", "size_level"), "doc_id", "left").filter(F.col("size").isNull() | (F.abs(F.col("font_size") - F.col("size")) < 0.6))
    best = near.filter("size IS NOT NULL").groupBy("doc_id", "page", "seq").agg(F.min("size_level").alias("size_level"))
    met = lines.join(best, ["doc_id", "page", "seq"], "left").join(contents.select(*PAGE).distinct().withColumn("toc", F.lit(True)), PAGE, "left")
    t, toc = F.trim("text"), F.coalesce("toc", F.lit(False))
    veto = T.is_caption(t) | T.is_attribution(t) | sideways(F.col("rotation")) | (F.char_length(t) > 140) | t.rlike(r"[a-z].*[a-z]-$")
    level = F.coalesce("tag_level", F.when(~toc, F.col("outline_level")), F.when(~F.coalesce(veto, F.lit(True)), F.col("size_level")), F.when(T.is_toc_title(t), 1))
    return met.withColumn("level", F.when(toc & F.col("tag_level").isNull() & ~T.is_toc_title(t), None).otherwise(level)).drop("toc", "size_level")
