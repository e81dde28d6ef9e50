"""Which pages need recognition: usable text, coverage, pictures, garbling; and how complicated their layout is."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import spatial as J
from pagemill.runtime import map_groups, written

PAGE = ["doc_id", "page"]
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
#: Least sides of a picture that counts, and the share of the page's sides above which it is the page.
IMAGE, FULL = 25.0, 0.9


def unusable(text: Column, unmapped: Column) -> Column:
    """An item whose font has no map to Unicode, or of ten letters and more with hardly a vowel."""
    letters, vowels = T.letter_count(text), T.vowel_count(text)
    return F.coalesce(unmapped, F.lit(False)) | F.coalesce((letters >= 10) & (vowels * 10 < letters), F.lit(False))


def counted(items: DataFrame) -> DataFrame:
    """Items with the counts of their letters, vowels and visible characters (_letters, _vowels, _visible), if they don't have them yet."""
    if "_letters" in items.columns:
        return items
    t = F.coalesce("text", F.lit(""))
    return items.withColumns({"_letters": T.letter_count(t), "_vowels": T.vowel_count(t), "_visible": T.visible_count(t)})


def native_text(items: DataFrame, width: float = PAGE_WIDTH, height: float = PAGE_HEIGHT) -> DataFrame:
    """(doc_id, page, text_length, coverage, unmapped, visible): bytes and boxes of usable items. One partial aggregation."""
    flagged = counted(items)
    good = ~(F.coalesce("has_unicode_map_error", F.lit(False)) | ((F.col("_letters") >= 10) & (F.col("_vowels") * 10 < F.col("_letters"))))
    visible = F.col("_visible")
    return flagged.groupBy(*PAGE).agg(
        F.coalesce(F.sum(F.when(good, F.octet_length("text"))), F.lit(0)).alias("text_length"),
        F.round(F.coalesce(F.sum(F.when(good, F.col("width") * F.col("height"))), F.lit(0.0)) / (width * height), 4).alias("coverage"),
        F.sum(F.when(F.coalesce("has_unicode_map_error", F.lit(False)), visible).otherwise(0)).alias("unmapped"),
        F.sum(visible).alias("visible"),
    )


def sparse_pages(items: DataFrame) -> DataFrame:
    """(doc_id, page, sparse): under 20 bytes of usable text, or under 15 % of the page covered: the test of a failed recognition."""
    return native_text(items).select(*PAGE, ((F.col("text_length") < 20) | (F.col("coverage") < 0.15)).alias("sparse"))


def image_facts(images: DataFrame, width: float = PAGE_WIDTH, height: float = PAGE_HEIGHT) -> DataFrame:
    """(doc_id, page, image_blocks, image_coverage, largest_coverage, full_page): pictures of 25 points and more; one that is the
    page counts apart."""
    sized = images.filter((F.col("width") >= IMAGE) & (F.col("height") >= IMAGE))
    full = (F.col("width") > FULL * width) & (F.col("height") > FULL * height)
    share = F.col("width") * F.col("height") / (width * height)
    return sized.groupBy(*PAGE).agg(
        F.count_if(~full).cast("int").alias("image_blocks"), F.round(F.least(F.coalesce(F.sum(F.when(~full, share)), F.lit(0.0)), F.lit(1.0)), 4).alias("image_coverage"),
        F.round(F.least(F.coalesce(F.max(F.when(~full, share)), F.lit(0.0)), F.lit(1.0)), 4).alias("largest_coverage"), F.max(full).alias("full_page"),
    )


def _unmapped() -> Column:
    return (F.col("unmapped") >= 30) & (F.col("unmapped") * 100 >= F.col("visible") * 15)


def page_complexity(items: DataFrame, images: DataFrame | None = None, facts: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """One row for each page with items: text_length, coverage, image columns, uncovered, reasons (in a fixed order) and needs_ocr.

    `images` (doc_id, page, seq, x, y, width, height), `facts` (annotation_text, invisible_share, hidden_share) and filled
    `paths` add their reasons where given; the area of paths that text does not cover is looked at only where there is no
    other reason, and null elsewhere. Null texts count nothing, null boxes cover nothing.
    """
    items = written(counted(items.select(*PAGE, "seq", "text", "x", "y", "width", "height", "font_name", "math", "has_unicode_map_error")))  # read five times
    pages = native_text(items).join(garbled_pages(items), PAGE, "left")
    none = {"image_blocks": F.lit(0), "image_coverage": F.lit(0.0), "largest_coverage": F.lit(0.0), "full_page": F.lit(False)}
    pages = pages.join(image_facts(images), PAGE, "left") if images is not None else pages.withColumns({k: F.lit(None) for k in none})
    pages = pages.withColumns({k: F.coalesce(F.col(k), v) for k, v in none.items()})
    own = {"annotation_text": F.lit(False), "invisible_share": F.lit(0.0), "hidden_share": F.lit(0.0)}
    pages = pages.join(facts, PAGE, "left") if facts is not None else pages.withColumns({k: F.lit(None) for k in own})
    pages = pages.withColumns({k: F.coalesce(F.col(k), v) for k, v in own.items()})
    short = F.col("text_length") < 20
    sparse = (F.col("text_length") < 2000) & (F.col("coverage") < 0.15) & (F.col("full_page") | (F.col("text_length") < 500))
    hidden = F.col("full_page") & ~short & ((F.col("invisible_share") >= 0.9) | (F.col("hidden_share") >= 0.9))
    found = [
        F.when(short, F.when(F.col("full_page"), "scanned").otherwise("no-text")).when(sparse, "sparse-text"), F.when(short & F.col("annotation_text"), "annotation-text"),
        F.when(F.col("image_blocks") > 0, "embedded-images"), F.when(F.coalesce("garbled", F.lit(False)) | _unmapped(), "garbled"), F.when(hidden, "invisible-text-layer"),
    ]
    pages = pages.withColumn("reasons", F.array_compact(F.array(*found)))
    plain = F.size("reasons") == 0
    if paths is not None:
        pages = written(pages)  # one row a page; the join of boxes then meets only those without another reason
        open_ = pages.filter(plain).select(*PAGE)
        area = J.uncovered_area(paths.join(open_, PAGE, "left_semi"), items.join(open_, PAGE, "left_semi"))
        pages = pages.join(area, PAGE, "left").withColumn("uncovered", F.when(plain, F.coalesce("uncovered", F.lit(0.0))))
        pages = pages.withColumn("reasons", F.when(plain & (F.col("uncovered") >= 400), F.array(F.lit("vector-text"))).otherwise(F.col("reasons")))
    else:
        pages = pages.withColumn("uncovered", F.when(plain, 0.0))
    columns = ["text_length", "coverage", "image_blocks", "image_coverage", "largest_coverage", "full_page", "uncovered"]
    return pages.select(*PAGE, *columns, F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") > 0).alias("needs_ocr"))


def native_page_complexity(items: DataFrame, rects: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Triage without a file at hand: pictures as rectangles, tables (doc_id, page, tables) and columns (doc_id, page, columns)
    counted by the caller. Here sparse text needs no further condition, and all rectangles make the figure coverage."""
    pages = native_text(items).join(garbled_pages(items), PAGE, "left").join(image_facts(rects), PAGE, "left")
    area = rects.groupBy(*PAGE).agg(F.round(F.least(F.sum(F.greatest("width", F.lit(0.0)) * F.greatest("height", F.lit(0.0))) / (PAGE_WIDTH * PAGE_HEIGHT), F.lit(1.0)), 4).alias("figure_coverage"), F.count("*").cast("int").alias("figures"))
    pages = pages.join(area, PAGE, "left").join(tables, PAGE, "left").join(columns, PAGE, "left")
    full, blocks = F.coalesce("full_page", F.lit(False)), F.coalesce("image_blocks", F.lit(0))
    text = F.when(F.col("text_length") < 20, F.when(full, "scanned").otherwise("no-text")).when((F.col("text_length") < 2000) & (F.col("coverage") < 0.15), "sparse-text")
    reasons = F.array_compact(F.array(text, F.when(blocks > 0, "embedded-images"), F.when(F.coalesce("garbled", F.lit(False)) | _unmapped(), "garbled")))
    layout = layout_reasons(F.greatest(F.coalesce("columns", F.lit(1)), F.lit(1)), F.coalesce("tables", F.lit(0)) > 0, F.coalesce("figure_coverage", F.lit(0.0)))
    return pages.select(*PAGE, "text_length", "coverage", F.array_join(reasons, ",").alias("reasons"), F.array_join(layout, ",").alias("layout_reasons"), F.coalesce("figures", F.lit(0)).alias("figures"))


def layout_reasons(columns: Column, tables: Column, figures: Column) -> Column:
    return F.array_compact(F.array(F.when(columns >= 2, "multi-column"), F.when(tables, "table-likely"), F.when(figures >= 0.2, "dense-graphics")))


def layout_complexity(pages: DataFrame, columns: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """(doc_id, page, columns, tables, figure_coverage, reasons) of pages, from their column counts (columns), their tables
    (doc_id, page, kind, with one row each) and figure boxes (fw, fh)."""
    counted = tables.groupBy(*PAGE).agg(F.count("*").cast("int").alias("tables"))
    drawn = figures.groupBy(*PAGE).agg(F.round(F.least(F.sum(F.greatest("fw", F.lit(0.0)) * F.greatest("fh", F.lit(0.0))) / (PAGE_WIDTH * PAGE_HEIGHT), F.lit(1.0)), 4).alias("figure_coverage"))
    met = pages.select(*PAGE).distinct().join(columns, PAGE, "left").join(counted, PAGE, "left").join(drawn, PAGE, "left")
    met = met.withColumns({"columns": F.greatest(F.coalesce("columns", F.lit(1)), F.lit(1)), "tables": F.coalesce("tables", F.lit(0)), "figure_coverage": F.coalesce("figure_coverage", F.lit(0.0))})
    return met.withColumn("reasons", F.array_join(layout_reasons(F.col("columns"), F.col("tables") > 0, F.col("figure_coverage")), ","))


def column_counts(regions: DataFrame) -> DataFrame:
    """(doc_id, page, columns) of items in the leaves of a page's cuts (region_path ARRAY<SMALLINT>, axes STRING: the axis of each
    cut above the leaf, 'V' or 'H'). Side by side columns add up, what stands one below the other counts by its most; parts
    with under 8 items or 15 % of the page count none."""

    def count(own: dict[str, list]) -> list[tuple]:
        sizes: dict[tuple, int] = {}
        axis: dict[tuple, str] = {}
        total = len(own["region_path"])
        for path, axes in zip(own["region_path"], own["axes"], strict=True):
            for k in range(len(path) + 1):
                sizes[tuple(path[:k])] = sizes.get(tuple(path[:k]), 0) + 1
                if k < len(path):
                    axis[tuple(path[:k])] = axes[k]
        least = max(8, -(-total * 15 // 100))

        def of(path: tuple) -> int:
            if sizes.get(path, 0) < least:
                return 0
            if path not in axis:
                return 1
            parts = [of((*path, i)) for i in (0, 1)]
            return sum(parts) if axis[path] == "V" else max(parts)

        return [(own["doc_id"][0], own["page"][0], max(1, of(())))]

    return map_groups(regions.select(*PAGE, "seq", "region_path", "axes"), PAGE, ["seq"], count, "doc_id long, page int, columns int")


def invisible_shares(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page, invisible_share, skip): share of visible glyphs (doc_id, page, text, mode) that are painted in mode 3. Such
    text is skipped where others prevail: there are both, and it is under 30 %."""
    solid = glyphs.filter(~F.col("text").rlike(r"^[\p{Cc}\s]*$"))
    sums = solid.groupBy(*PAGE).agg(F.count_if(F.col("mode") == 3).alias("hidden"), F.count("*").alias("all"))
    share = F.col("hidden") / F.col("all")
    return sums.select(*PAGE, F.round(share, 4).alias("invisible_share"), ((F.col("hidden") > 0) & (share < 0.3)).alias("skip"))


def drop_invisible(glyphs: DataFrame) -> DataFrame:
    """Glyphs without those of mode 3 on pages where they are skipped."""
    skipped = invisible_shares(glyphs).filter("skip").select(*PAGE)
    hidden = F.col("mode") == 3
    return glyphs.filter(~hidden).unionByName(glyphs.filter(hidden).join(skipped, PAGE, "left_anti"))


def hidden_shares(objects: DataFrame) -> DataFrame:
    """(doc_id, page, hidden_share): share of text objects (doc_id, page, seq, kind, width, height) painted before the page's first
    picture that fills it; 0 without one."""
    full = (F.col("kind") == "image") & (F.col("width") > FULL * PAGE_WIDTH) & (F.col("height") > FULL * PAGE_HEIGHT)
    first = F.min(F.when(full, F.col("seq"))).over(Window.partitionBy(*PAGE))
    texts = objects.withColumn("first", first).filter("kind = 'text'")
    return texts.groupBy(*PAGE).agg(F.round(F.count_if(F.col("seq") < F.col("first")) / F.count("*"), 4).alias("hidden_share"))


#: The detectors: name, least number, least percentage, and the sums that they compare.
DETECTORS = {"vowel": ("letters", "vowels"), "script": ("script", "script_odd"), "symbol": ("alphabetic", "symbols"), "control": ("visible", "controls"), "token": ("judged", "malformed")}


def _garbled(font: Column | None = None) -> Column:
    """Whether the sums of a page, or of one of its fonts, tell garbled text."""
    c = F.col
    vowel = (c("letters") >= 30) & (c("vowels") * 5 < c("letters"))
    if font is not None:
        vowel = vowel & (c("letters") >= font)
    tests = [
        vowel, (c("script_odd") >= 5) & (c("script_odd") * 1000 >= c("script") * 15), (c("symbols") >= 20) & (c("symbols") * 100 >= c("alphabetic") * 3),
        (c("controls") >= 5) & (c("controls") * 50 >= c("visible") + c("controls")), (c("malformed") >= 10) & (c("malformed") * 5 >= c("judged")),
    ]
    return reduce(or_, tests)


def garbled_scopes(items: DataFrame) -> DataFrame:
    """The five detectors on page totals and for each font of a page (font_name null for the page, '(none)' for items without),
    by grouping sets: (doc_id, page, font_name, the sums, garbled).

    A page is judged by its totals. Its fonts are judged only if it is sound itself; there the vowel test also needs 15 % of
    the page's letters. Formulas and fonts of signs are left out of the control and token tests.
    """
    t = F.coalesce("text", F.lit(""))
    plain = ~(F.coalesce("math", F.lit(False)) | T.is_symbol_font(F.col("font_name")))
    ascii_ = F.octet_length(t) == F.char_length(t)
    own = {"letters": F.col("_letters"), "vowels": F.col("_vowels"), "script": F.when(ascii_, 0).otherwise(T.complex_count(t)), "script_odd": F.when(ascii_, 0).otherwise(T.script_intrusions(t)),
           "alphabetic": F.when(ascii_, F.col("_letters")).otherwise(T.all_letters(t)), "symbols": T.symbol_intrusions(t)}
    own |= {k: F.when(plain, v).otherwise(0) for k, v in {"controls": T.control_count(t), "visible": F.col("_visible")}.items()}
    prepared = counted(items).select(*PAGE, F.coalesce("font_name", F.lit("(none)")).alias("font_name"), *[v.alias(k) for k, v in own.items()], F.when(plain, T.judged_count(t)).otherwise(0).alias("judged"), F.when(plain, T.malformed_count(t)).otherwise(0).alias("malformed"))
    names = [*own, "judged", "malformed"]
    sums = prepared.groupingSets([PAGE, [*PAGE, "font_name"]], *PAGE, "font_name").agg(*[F.sum(n).alias(n) for n in names])
    whole = Window.partitionBy(*PAGE)
    page = F.col("font_name").isNull()
    letters = F.max(F.when(page, F.col("letters"))).over(whole)
    bad = sums.withColumn("own_page", F.max(F.when(page, _garbled())).over(whole))
    return bad.withColumn("garbled", F.when(page, F.col("own_page")).otherwise(~F.col("own_page") & _garbled(F.ceil(letters * 15 / 100)))).drop("own_page")


#: Signs around a word.
EDGES = r"""[.,;:()\[\]{}'"!?«»“”‘’]+"""


def misread_fonts(items: DataFrame) -> DataFrame:
    """(doc_id, page, base): fonts, without the tags of their subsets, in which one character stands in three different words and
    before two different ends where it can't belong: '!', '%' or '*' between letters, or a capital before one or two last
    small letters."""
    sign = F.col("text").rlike(r"\p{L}[!%*]\p{L}|\p{Ll}\p{Lu}\p{Ll}{1,2}(?!\p{L})")
    plain = items.filter(sign & ~(F.coalesce("math", F.lit(False)) | T.is_symbol_font(F.col("font_name"))))
    bare = F.transform(F.split("text", r"(?U)\s+"), lambda t: F.regexp_replace(t, f"^{EDGES}|{EDGES}$", ""))
    kept = F.filter(bare, lambda t: (F.char_length(t) >= 3) & ~t.startswith("http") & ~t.rlike(r"[_@\\$/]") & t.rlike(r"\p{L}[!%*]\p{L}|\p{Ll}\p{Lu}\p{Ll}{1,2}$"))
    words = plain.select(*PAGE, F.coalesce(T.base_font(F.col("font_name")), F.lit("(none)")).alias("base"), F.explode(kept).alias("t"))
    word = F.lower(F.regexp_replace("t", r"[^\p{L}]", ""))
    signs = F.transform(F.regexp_extract_all("t", F.lit(r"(?<=[\p{IsLatin}\p{IsGreek}\p{IsCyrillic}])([!%*])(?=[\p{IsLatin}\p{IsGreek}\p{IsCyrillic}])"), F.lit(1)), lambda c: F.struct(c.alias("ch"), word.alias("tail")))
    tail = F.regexp_extract("t", r".\p{Ll}(\p{Lu}\p{Ll}{1,2})$", 1)
    capital = F.when((tail != "") & ~F.col("t").rlike("[0-9]"), F.array(F.struct(F.substring(tail, 1, 1).alias("ch"), tail.alias("tail")))).otherwise(F.array())
    found = words.select(*PAGE, "base", word.alias("word"), F.explode(F.concat(signs, capital)).alias("m"))
    return found.groupBy(*PAGE, "base", "m.ch").agg(F.countDistinct("word").alias("words"), F.countDistinct("m.tail").alias("tails")).filter("words >= 3 AND tails >= 2").select(*PAGE, "base").distinct()


def garbled_pages(items: DataFrame) -> DataFrame:
    """(doc_id, page, garbled): garbled as a whole, or in one of its fonts."""
    scopes = garbled_scopes(items).groupBy(*PAGE).agg(F.max("garbled").alias("garbled"))
    misread = misread_fonts(items).select(*PAGE).distinct().withColumn("misread", F.lit(True))
    return scopes.join(misread, PAGE, "left").select(*PAGE, (F.col("garbled") | F.coalesce("misread", F.lit(False))).alias("garbled"))


def drop_garbled(items: DataFrame) -> DataFrame:
    """Items without those of garbled pages, and on others without those of garbled fonts and of misread ones: three anti-joins on
    the flagged keys."""
    scopes = garbled_scopes(items).filter("garbled")
    named = items.withColumns({"font_key": F.coalesce("font_name", F.lit("(none)")), "base": F.coalesce(T.base_font(F.col("font_name")), F.lit("(none)"))})
    pages = scopes.filter(F.col("font_name").isNull()).select(*PAGE)
    fonts = scopes.filter(F.col("font_name").isNotNull()).select(*PAGE, F.col("font_name").alias("font_key"))
    return named.join(pages, PAGE, "left_anti").join(fonts, [*PAGE, "font_key"], "left_anti").join(misread_fonts(items), [*PAGE, "base"], "left_anti").drop("font_key", "base")


def garbage_fonts(items: DataFrame, share: float = 0.3) -> DataFrame:
    """Fonts whose characters are mostly controls or for private use."""
    t = F.coalesce("text", F.lit(""))
    sums = items.groupBy("font_name").agg(F.sum(T.control_count(t) + T.private_use_count(t)).alias("odd"), F.sum(F.char_length(t)).alias("chars"))
    return sums.withColumn("garbage", (F.col("odd") >= 5) & (F.col("odd") >= share * F.col("chars")))
