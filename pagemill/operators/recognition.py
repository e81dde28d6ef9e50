"""Recognised text and its union with what a file holds: what is sent to recognition, what of its results counts, and where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import spatial as J
from pagemill.runtime import written

PAGE = ["doc_id", "page"]
#: Longest side of a drawn page in pixels.
LONGEST = 4096.0
#: Lone signs that a scanner makes of a ruled line.
BARS = r"^[|Il1!ij\[\](){}/\\]$"


def clamp_dpi(dpi: float, width: Column, height: Column, longest: float = LONGEST) -> Column:
    """Resolution at which the longer side of a page stays within so many pixels."""
    return F.least(F.lit(dpi), longest * 72 / F.greatest(width, height))


def recognition_tasks(triage: DataFrame, pages: DataFrame, dpi: float = 150.0, chosen: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, seq, dpi, has_native_text, replace_native) of the pages that need recognition, or of the `chosen` ones
    (doc_id, page) alone; `pages` has page_width and page_height. seq numbers the tasks of a document in page order."""
    own = triage.join(chosen.select(*PAGE).distinct(), PAGE, "left_semi") if chosen is not None else triage.filter("needs_ocr")
    sized = own.join(pages, PAGE)
    native = F.col("text_length") > 0
    replace = F.array_contains(F.split("reasons", ","), "invisible-text-layer")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    return sized.select(*PAGE, nth.alias("seq"), F.round(clamp_dpi(dpi, F.col("page_width"), F.col("page_height")), 4).alias("dpi"), native.alias("has_native_text"), replace.alias("replace_native"))


def supplied_images(tasks: DataFrame, images: DataFrame, stretch: float = 0.02) -> DataFrame:
    """Tasks with the picture of the whole page that the caller has (doc_id, page, path, pixel_width, pixel_height, page_width,
    page_height): its resolution follows from the longer side; one whose sides give two resolutions over `stretch` apart is
    not taken, and path is null."""
    across, down = F.col("pixel_width") * 72 / F.col("page_width"), F.col("pixel_height") * 72 / F.col("page_height")
    good = F.abs(across - down) <= stretch * F.greatest(across, down)
    known = images.filter((F.col("page_width") > 0) & (F.col("page_height") > 0) & good)
    own = F.when(F.col("page_width") >= F.col("page_height"), across).otherwise(down)
    best = known.groupBy(*PAGE).agg(F.min(F.struct("path", F.round(own, 4).alias("dpi"))).alias("p"))
    return tasks.join(best, PAGE, "left").withColumn("dpi", F.coalesce("p.dpi", "dpi")).withColumn("path", F.col("p.path")).drop("p")


def matched_outcomes(outcomes: DataFrame, pages: DataFrame) -> DataFrame:
    """Outcomes in the order of their tasks; one whose page is not among the pages is an error when it is read."""
    known = pages.select(*PAGE).distinct().withColumn("known", F.lit(True))
    met = outcomes.join(known, PAGE, "left")
    message = F.concat(F.lit("an outcome has no page: "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.lit("/"), F.coalesce(F.col("page").cast("string"), F.lit("?")))
    checked = F.when(F.col("known"), F.col("page")).otherwise(F.raise_error(message).cast("int"))
    return met.withColumn("page", checked).drop("known").orderBy("doc_id", "seq")


def is_rule_artifact(text: Column, width: Column, height: Column) -> Column:
    """Text without a letter or digit, or a lone bar that is much narrower than tall."""
    s = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return ~F.coalesce(s.rlike(r"[\p{L}\p{N}]"), F.lit(False)) | (s.rlike(BARS) & (height > 0) & (width < 0.35 * height))


def page_skew(results: DataFrame) -> DataFrame:
    """(doc_id, page, skew): angle of long nearly level lines (px1..py4: corners from the top left clockwise), the median by
    length of at least three; null below 0.3 and above 10 degrees."""
    dx, dy = F.col("px2") - F.col("px1"), F.col("py2") - F.col("py1")
    size, tall = F.sqrt(dx * dx + dy * dy), F.sqrt((F.col("px4") - F.col("px1")) ** 2 + (F.col("py4") - F.col("py1")) ** 2)
    angle = F.degrees(F.atan2(dy, dx))
    lines = results.select(*PAGE, angle.alias("angle"), size.alias("size"), tall.alias("tall")).filter((F.col("size") >= 4 * F.col("tall")) & (F.col("size") > 0) & (F.abs("angle") <= 45))
    whole, upto = Window.partitionBy(*PAGE), Window.partitionBy(*PAGE).orderBy("angle", "size")
    weighed = lines.withColumns({"n": F.count("*").over(whole), "half": F.sum("size").over(whole) / 2, "upto": F.sum("size").over(upto.rowsBetween(Window.unboundedPreceding, 0))})
    middle = weighed.filter((F.col("n") >= 3) & (F.col("upto") >= F.col("half"))).groupBy(*PAGE).agg(F.min_by("angle", F.struct("angle", "size")).alias("middle"))
    return middle.select(*PAGE, F.when(F.abs("middle").between(0.3, 10.0), F.round("middle", 6)).alias("skew"))


def rotated(x: Column, y: Column, cx: Column, cy: Column, degrees: Column) -> tuple[Column, Column]:
    """A point turned about a centre."""
    s, c = F.sin(F.radians(degrees)), F.cos(F.radians(degrees))
    return cx + (x - cx) * c - (y - cy) * s, cy + (x - cx) * s + (y - cy) * c


def deskewed(boxes: DataFrame, skews: DataFrame, width: float = 612.0, height: float = 792.0, back: bool = False) -> DataFrame:
    """Boxes with their centres turned about the page's centre against its skew (or `back` by it); sizes stay. Pages without a
    skew are left alone."""
    met = boxes.join(skews, PAGE, "left")
    mx, my = rotated(F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2, F.lit(width / 2), F.lit(height / 2), F.col("skew") if back else -F.col("skew"))
    turned = {"x": F.when(F.col("skew").isNotNull(), mx - F.col("width") / 2).otherwise(F.col("x")), "y": F.when(F.col("skew").isNotNull(), my - F.col("height") / 2).otherwise(F.col("y"))}
    return met.withColumns(turned).drop("skew")


def upright_scans(items: DataFrame, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """Items of scans that lie on a side or upside down turned upright: where one quarter turn has 70 % of at least 20
    characters of the page. Their rotation becomes 0; `turn` says by how many quarters the page was turned."""
    quarter = (F.pmod(F.round(F.pmod(F.coalesce("rotation", F.lit(0.0)), F.lit(360.0)) / 90), F.lit(4.0))).cast("int")
    counted = items.groupBy(*PAGE, quarter.alias("q")).agg(F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("n"))
    vote = counted.groupBy(*PAGE).agg(F.max(F.struct("n", "q")).alias("top"), F.sum("n").alias("total"))
    turned = vote.filter((F.col("top.q") != 0) & (F.col("total") >= 20) & (F.col("top.n") * 10 >= F.col("total") * 7)).select(*PAGE, F.col("top.q").alias("turn"))
    met = items.join(turned, PAGE, "left").withColumn("turn", F.coalesce("turn", F.lit(0)))
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    q = F.col("turn")
    new = {
        "x": F.when(q == 1, height - (y + h)).when(q == 2, width - (x + w)).when(q == 3, y).otherwise(x), "y": F.when(q == 1, x).when(q == 2, height - (y + h)).when(q == 3, width - (x + w)).otherwise(y),
        "width": F.when(q % 2 == 1, h).otherwise(w), "height": F.when(q % 2 == 1, w).otherwise(h), "rotation": F.when(q == 0, F.col("rotation")).otherwise(0.0),
    }
    return met.withColumns(new)


def page_boxes(results: DataFrame) -> DataFrame:
    """Results (dpi, x1, y1, x2, y2 in pixels) with their boxes in points."""
    scale = 72.0 / F.col("dpi")
    return results.withColumns({"x": F.col("x1") * scale, "y": F.col("y1") * scale, "width": (F.col("x2") - F.col("x1")) * scale, "height": (F.col("y2") - F.col("y1")) * scale})


def kept_natives(natives: DataFrame, scopes: DataFrame) -> DataFrame:
    """Items that stay beside recognised text: none of a page replaced or garbled as a whole, none of garbled fonts, no unusable
    ones. `scopes` (doc_id, page, scope 'whole' | 'fonts', fonts ARRAY<STRING>) has pages that aren't sound."""
    met = natives.join(scopes, PAGE, "left")
    font = F.coalesce("font_name", F.lit("(none)"))
    gone = (F.col("scope") == "whole") | ((F.col("scope") == "fonts") & F.array_contains("fonts", font))
    return met.filter(~F.coalesce(gone, F.lit(False)) & ~F.col("unusable")).drop("fonts")


def accepted_results(results: DataFrame, natives: DataFrame, scopes: DataFrame) -> DataFrame:
    """Results that count, with their cleaned text: over 0.1 sure, no bits of rules where the page has text of its own, away from
    kept native text (2 points), or, where only some fonts are garbled, covered by it to less than half of their width."""
    sure = page_boxes(results).filter(F.col("confidence") > 0.1)
    real = sure.filter(~(F.col("has_native_text") & is_rule_artifact(F.col("text"), F.col("width"), F.col("height"))))
    real = written(real)
    partial = scopes.filter("scope = 'fonts'").select(*PAGE)
    apart = J.without_native(real.join(partial, PAGE, "left_anti"), natives)
    covered = J.width_covered(real.join(partial, PAGE, "left_semi"), natives).filter("covered < 0.5").drop("covered")
    cleaned = apart.unionByName(covered).withColumn("text", T.clean_recognised(F.col("text")))
    return cleaned.filter(F.coalesce(F.col("text"), F.lit("")) != "").withColumn("confidence", F.round("confidence", 3))


def merge_recognised(natives: DataFrame, results: DataFrame, scopes: DataFrame) -> DataFrame:
    """Items of pages after recognition: (doc_id, page, seq, text, x, y, width, height, font_name, confidence).

    `natives` have doc_id, page, seq, text, box, font_name and unusable; `results` doc_id, page, seq, dpi, text, pixel box,
    confidence and has_native_text. Pages without results stay as they are. Accepted results follow the native items, their
    font is 'OCR'. On pages of which only some fonts are garbled, native items with their centre in an accepted result go.
    """
    asked = results.select(*PAGE).distinct()
    untouched = natives.join(asked, PAGE, "left_anti")
    kept = written(kept_natives(natives.join(asked, PAGE, "left_semi"), scopes))  # met three times
    added = written(accepted_results(results, kept, scopes))
    areas = added.select(*PAGE, F.col("seq").alias("area"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("width").alias("aw"), F.col("height").alias("ah"))
    superseded = J.centred_in(kept.filter("scope = 'fonts'"), areas).select(*PAGE, "seq").distinct()
    columns = [*PAGE, "seq", "text", "x", "y", "width", "height", "font_name"]
    stays = untouched.select(*columns).unionByName(kept.join(superseded, [*PAGE, "seq"], "left_anti").select(*columns)).withColumn("confidence", F.lit(None).cast("double"))
    last = natives.groupBy(*PAGE).agg(F.max("seq").alias("last"))
    new = added.join(last, PAGE, "left").withColumn("seq", F.coalesce("last", F.lit(0)) + 1 + F.col("seq")).withColumn("font_name", F.lit("OCR"))
    return stays.unionByName(new.select(*columns, "confidence"))


def font_size_hint(rotation: Column, width: Column, height: Column, polygon_height: Column) -> Column:
    """Size of recognised text: its height, at most that of its polygon; the width where it runs up or down."""
    side = rotation.isin(90.0, 270.0)
    return F.when(side, F.greatest(width, F.lit(1.0))).when(polygon_height > 0, F.least(polygon_height, height)).otherwise(height)


def canonical_quarter(rotation: Column) -> Column:
    return (F.pmod(F.round(F.pmod(rotation, F.lit(360.0)) / 90), F.lit(4.0)) * 90).cast("int")


