"""Lines, headings, running chrome and paragraphs from positioned items, by aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import text as T
from pagemill.operators.triage import PAGE_HEIGHT, PAGE_WIDTH


def target_pages(specs: DataFrame, spec: str = "spec", most: int = 100_000) -> DataFrame:
    """Sorted distinct pages of texts such as '2-4,9'; null where a part is reversed, not a number or names over `most` pages."""
    parts = F.transform(F.split(F.col(spec), ","), lambda p: F.trim(p))
    good = F.forall(parts, lambda p: p.rlike(r"^[0-9]{1,9}(\s*-\s*[0-9]{1,9})?$"))
    bounds = F.transform(parts, lambda p: F.transform(F.split(p, "-"), lambda q: F.trim(q).try_cast("bigint")))
    ordered = F.forall(bounds, lambda b: (F.try_element_at(b, F.lit(1)) >= 1) & (F.try_element_at(b, F.lit(1)) <= F.try_element_at(b, F.lit(-1))))
    size = F.aggregate(bounds, F.lit(0).cast("bigint"), lambda n, b: n + F.try_element_at(b, F.lit(-1)) - F.try_element_at(b, F.lit(1)) + 1)
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(bounds, lambda b: F.sequence(F.try_element_at(b, F.lit(1)), F.try_element_at(b, F.lit(-1)))))))
    return specs.withColumn("pages", F.when(good, F.when(ordered & (size <= most), pages)))


def cap_pages(pages: DataFrame, most: int) -> DataFrame:
    """The first pages of each document."""
    w = Window.partitionBy("doc_id").orderBy("page")
    return pages.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).drop("rank")


def crop(items: DataFrame, left: float, top: float, right: float, bottom: float, width: float = PAGE_WIDTH, height: float = PAGE_HEIGHT) -> DataFrame:
    """Items wholly inside what remains when these shares are cut from the sides; bounds belong to it."""
    inside = (F.col("x") >= left * width) & (F.col("x") + F.col("width") <= (1 - right) * width) & (F.col("y") >= top * height) & (F.col("y") + F.col("height") <= (1 - bottom) * height)
    return items.filter(inside)


def drop_diagonal(items: DataFrame, most: float = 2.0) -> DataFrame:
    return items.filter(G.off_axis(F.coalesce("rotation", F.lit(0.0))) <= most)


def body_size(lines: DataFrame) -> DataFrame:
    """Body size of each document: of the sizes with at least half the weight of the heaviest, the largest."""
    weighted = lines.filter(F.col("font_size").isNotNull() & F.col("text").isNotNull()).groupBy("doc_id", F.round(F.col("font_size") * 100).cast("bigint").alias("size_key")).agg(F.sum(F.greatest(F.char_length("text"), F.lit(1))).alias("weight"))
    top = weighted.withColumn("most", F.max("weight").over(Window.partitionBy("doc_id")))
    return top.filter(F.col("weight") >= F.floor(F.col("most") * 0.5)).groupBy("doc_id").agg((F.max("size_key") / 100).alias("body_size"))


def heading_map(lines: DataFrame, levels: int = 6) -> DataFrame:
    """Sizes above a document's body size as heading levels, largest first.

    Captions and lines whose text occurs three times and more are no candidates; a size needs ten visible characters, 8
    to 200 characters a line, and letters for half of them.
    """
    upright = lines.filter(F.coalesce(F.col("rotation"), F.lit(0.0)) == 0)
    large = upright.join(body_size(lines), "doc_id").filter((F.col("font_size") > F.col("body_size") + 0.5) & ~T.is_caption(F.col("text")))
    norm = F.lower(T.collapse_whitespace(F.col("text")))
    seen = large.withColumn("times", F.count("*").over(Window.partitionBy("doc_id", norm))).filter(F.col("times") < 3)
    sizes = seen.groupBy("doc_id", F.round(F.col("font_size") * 100).cast("bigint").alias("size_key")).agg(
        F.sum(F.char_length(F.regexp_replace("text", r"\s", ""))).alias("chars"), F.sum(F.char_length("text")).alias("length"), F.count("*").alias("n"), F.sum(F.char_length(F.regexp_replace("text", r"[^\p{L}]", ""))).alias("letters")
    )
    kept = sizes.filter((F.col("chars") >= 10) & (F.col("length") >= 8 * F.col("n")) & (F.col("length") <= 200 * F.col("n")) & (F.col("letters") * 2 >= F.col("chars")))
    return kept.withColumn("level", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size_key")))).filter(F.col("level") <= levels).select("doc_id", (F.col("size_key") / 100).alias("size"), "level")


def _bands(lines: DataFrame, height: float, share: float) -> DataFrame:
    top, bottom = F.col("y") <= share * height, F.col("y") + F.col("height") >= (1 - share) * height
    bands = F.filter(F.array(F.when(top, "h"), F.when(bottom, "f")), lambda b: b.isNotNull())
    return lines.filter(F.col("text").isNotNull()).withColumn("band", F.explode(bands)).withColumn("norm", T.normalize_for_repetition(F.col("text")))


def chrome_keys(lines: DataFrame, height: float = PAGE_HEIGHT, share: float = 0.12) -> DataFrame:
    """Running headers and footers of documents of two pages and more: (doc_id, band, norm, pages).

    A line counts in a band on at least half of the pages and two. Where more than three kept lines of a band look like no
    chrome, only those that do stay: so many are a letterhead.
    """
    banded = _bands(lines, height, share)
    sizes = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("total")).filter("total >= 2")
    keys = banded.groupBy("doc_id", "band", "norm").agg(F.countDistinct("page").alias("pages"), F.max(T.is_chrome(F.col("text"))).alias("pattern"))
    kept = keys.join(sizes, "doc_id").filter((F.col("pages") >= 2) & (F.col("pages") * 2 >= F.col("total")) & (F.col("norm") != ""))
    plain = F.sum((~F.col("pattern")).cast("int")).over(Window.partitionBy("doc_id", "band"))
    return kept.withColumn("plain", plain).filter((F.col("plain") <= 3) | F.col("pattern")).select("doc_id", "band", "norm", "pages")


def strip_chrome(lines: DataFrame, height: float = PAGE_HEIGHT, share: float = 0.12) -> DataFrame:
    """Lines without running headers and footers: each meets the keys of its document and normalised text once, and goes if it stands in
    a band of theirs. Null texts and places stay."""
    keys = chrome_keys(lines, height, share).groupBy("doc_id", "norm").agg(F.max(F.col("band") == "h").alias("_h"), F.max(F.col("band") == "f").alias("_f"))
    own = lines.withColumn("norm", T.normalize_for_repetition(F.col("text"))).join(keys, ["doc_id", "norm"], "left")
    top, bottom = F.col("y") <= share * height, F.col("y") + F.col("height") >= (1 - share) * height
    gone = (top & F.col("_h")) | (bottom & F.col("_f"))
    return own.filter(~F.coalesce(gone, F.lit(False))).select(*lines.columns)


def single_page_chrome(lines: DataFrame, height: float = PAGE_HEIGHT) -> DataFrame:
    """Chrome of single pages: a short pattern line in the outer 15 %, at least its height away from the nearest body line."""
    pattern = F.coalesce(T.is_chrome(F.col("text")) & (F.char_length("text") <= 200), F.lit(False))
    flagged = lines.withColumn("pattern", pattern).withColumn("bottom", F.col("y") + F.col("height"))
    up = Window.partitionBy("doc_id", "page").orderBy("y", "seq").rowsBetween(1, Window.unboundedFollowing)
    down = Window.partitionBy("doc_id", "page").orderBy("y", "seq").rowsBetween(Window.unboundedPreceding, -1)
    near = flagged.withColumn("next_body", F.min(F.when(~F.col("pattern"), F.col("y"))).over(up)).withColumn("last_body", F.max(F.when(~F.col("pattern"), F.col("bottom"))).over(down))
    top = (F.col("bottom") <= 0.15 * height) & F.coalesce(F.col("next_body") - F.col("bottom") >= F.col("height"), F.lit(True))
    foot = (F.col("y") >= 0.85 * height) & F.coalesce(F.col("y") - F.col("last_body") >= F.col("height"), F.lit(True))
    return near.filter(F.col("pattern") & (top | foot))


def paragraph_ids(lines: DataFrame) -> DataFrame:
    """Paragraph number of each line of a page: a new one where the size or the boldness changes, the indent grows by over
    6 points or the gap exceeds one and a half heights. The test needs the line before only, so a window is exact."""
    w = Window.partitionBy("doc_id", "page").orderBy("seq")
    size, before = F.coalesce("font_size", "height"), F.lag(F.coalesce("font_size", "height")).over(w)
    bold, old_bold = F.coalesce(F.col("font_weight") >= 600, F.lit(False)), F.lag(F.coalesce(F.col("font_weight") >= 600, F.lit(False))).over(w)
    gap = F.col("y") - F.lag(F.col("y") + F.col("height")).over(w)
    breaks = F.lag("seq").over(w).isNull() | (F.abs(size - before) > 0.5) | (bold != old_bold) | (F.col("x") - F.lag("x").over(w) > 6) | (gap > 1.5 * F.greatest(F.col("height"), F.lag("height").over(w)))
    flagged = lines.withColumn("breaks", F.coalesce(breaks, F.lit(False)).cast("int"))
    return flagged.withColumn("paragraph", F.sum("breaks").over(w)).drop("breaks")


def split_cells(items: DataFrame) -> DataFrame:
    """Cells of each row of items at the same height: a new cell where the gap to the item before exceeds the font size."""
    w = Window.partitionBy("doc_id", "page", "row_y").orderBy("x", "seq")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    starts = F.coalesce(gap > F.coalesce("font_size", "height"), F.lag("seq").over(w).isNull(), F.lit(False)).cast("int")
    rows = items.withColumn("row_y", F.round("y").cast("int")).withColumn("starts", starts)
    return rows.withColumn("cell", F.sum("starts").over(w)).drop("starts")


def cluster_positions(items: DataFrame, value: str, tolerance: float) -> DataFrame:
    """Positions of a page chained while neighbours lie within the tolerance: (doc_id, page, center, n)."""
    distinct = items.select("doc_id", "page", F.col(value).alias("v")).filter(F.col("v").isNotNull()).groupBy("doc_id", "page", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id", "page").orderBy("v")
    starts = F.coalesce((F.col("v") - F.lag("v").over(w) > tolerance), F.lit(True)).cast("int")
    numbered = distinct.withColumn("starts", starts).withColumn("cluster", F.sum("starts").over(w))
    return numbered.groupBy("doc_id", "page", "cluster").agg(F.round(F.avg("v"), 3).alias("center"), F.sum("n").alias("n")).drop("cluster")


def page_line_stats(lines: DataFrame) -> DataFrame:
    """Spacing of the lines of each page: median size, population deviation over mean of the gaps, quarter turn share."""
    w = Window.partitionBy("doc_id", "page").orderBy("y", "seq")
    gaps = lines.withColumn("gap", F.col("y") - F.lag("y").over(w))
    turned = F.avg((G.canonical_rotation(F.coalesce("rotation", F.lit(0.0))) != 0).cast("double"))
    cv = F.when(F.count("*") >= 3, F.coalesce(F.stddev_pop("gap") / F.nullif(F.avg("gap"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    return gaps.groupBy("doc_id", "page").agg(F.count("*").alias("lines"), F.round(F.median("height"), 3).alias("median_height"), F.round(cv, 4).alias("spacing_cv"), F.round(turned, 4).alias("turned_share"))


def density(items: DataFrame, bucket: float = 2.0) -> DataFrame:
    """Weight of characters in each bucket of a page's width: (doc_id, page, bucket, weight)."""
    boxed = items.filter((F.col("width") > 0) & F.col("text").isNotNull())
    spread = boxed.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("x") / bucket), F.floor((F.col("x") + F.col("width")) / bucket))))
    return spread.groupBy("doc_id", "page", "bucket").agg(F.sum(F.char_length("text")).alias("weight"))


def font_modes(lines: DataFrame) -> DataFrame:
    """Dominant size and font of each page by characters, the larger of equal ones; whether most characters are bold."""
    sized = lines.filter(F.col("text").isNotNull()).withColumn("n", F.char_length("text"))
    def mode(column: str, name: str) -> DataFrame:
        sums = sized.filter(F.col(column).isNotNull()).groupBy("doc_id", "page", column).agg(F.sum("n").alias("w"))
        return sums.groupBy("doc_id", "page").agg(F.max_by(column, F.struct("w", column)).alias(name))
    bold = sized.groupBy("doc_id", "page").agg((2 * F.sum(F.when(F.col("font_weight") >= 600, F.col("n")).otherwise(0)) > F.sum("n")).alias("all_bold"))
    return bold.join(mode("font_size", "dominant_size"), ["doc_id", "page"], "left").join(mode("font_name", "dominant_font"), ["doc_id", "page"], "left")


def toc_pages(lines: DataFrame, most: float = 0.7) -> DataFrame:
    """Pages that list contents (doc_id, page, entries, forward_share): four entries and more, three of them with arabic page
    numbers, of which 70 % do not go back."""
    w = Window.partitionBy("doc_id", "page").orderBy("seq")
    c = F.col("text")
    entries = lines.withColumn("target", T.toc_page(c)).filter(F.col("target").isNotNull() | T.toc_roman(c))
    arabic = F.last("target", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    forward = (F.col("target") >= arabic).cast("double")
    pages = entries.withColumn("forward", forward).groupBy("doc_id", "page").agg(F.count("*").alias("entries"), F.count("target").alias("arabic"), F.avg("forward").alias("share"))
    return pages.filter((F.col("entries") >= 4) & (F.col("arabic") >= 3) & (F.col("share") >= most)).select("doc_id", "page", "entries", F.round("share", 4).alias("forward_share"))


def relative_indents(lines: DataFrame) -> DataFrame:
    return lines.withColumn("indent", F.greatest(F.lit(0.0), F.col("x") - F.min("x").over(Window.partitionBy("doc_id", "page"))))


def page_batches(pages: DataFrame, size: int = 25) -> DataFrame:
    """Pages (doc_id, page) with the number of their batch of so many pages of the document, from 1: what a session works on at once."""
    nth = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page"))
    return pages.withColumn("batch", F.floor((nth - 1) / size).cast("int") + 1)


def attached(pages: DataFrame, stats: DataFrame) -> DataFrame:
    """Pages with their statistics (doc_id, page, ...); those without keep nulls."""
    return pages.join(stats, ["doc_id", "page"], "left")


#: Columns of an item by the feature that a caller asks for.
FEATURES = {
    "metadata": ("rotation", "font_name", "font_size", "font_weight", "font_flags"), "colour": ("fill_color", "stroke_color"), "codes": ("char_codes", "font_is_buggy", "has_unicode_map_error"),
    "marks": ("link", "strike", "underline", "sup", "sub", "math"), "tags": ("mcid",), "confidence": ("confidence",),
}


def with_features(items: DataFrame, *features: str) -> DataFrame:
    """Items with their place and text and the columns of the features asked for; no other column is read."""
    unknown = set(features) - FEATURES.keys()
    if unknown:
        raise ValueError(f"unknown features: {', '.join(sorted(unknown))}")
    return items.select("doc_id", "page", "seq", "text", "x", "y", "width", "height", *[c for f in FEATURES if f in features for c in FEATURES[f]])
