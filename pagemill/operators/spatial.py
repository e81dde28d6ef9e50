"""Joins of boxes on a page. Candidates meet by equal keys (document, page, grid cell); the exact test follows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.runtime import map_groups, written

#: Sides of a grid cell in points, wide and low as lines are, and the cells that coordinates beyond are counted to: a box of any size
#: touches a bounded number.
WIDE, TALL, FIRST, LAST = 306.0, 36.0, -8, 72
PAGE = ("doc_id", "page")
Box = tuple[Column, Column, Column, Column]


def box(*names: str) -> Box:
    """The columns of a box: left, top, width, height."""
    x, y, w, h = (F.col(n) for n in (names or ("x", "y", "width", "height")))
    return x, y, w, h


def _cell(v: Column, side: float) -> Column:
    return F.least(F.greatest(F.floor(v / side), F.lit(FIRST)), F.lit(LAST)).cast("int")


def _number(x: Column, y: Column) -> Column:
    return _cell(x, WIDE) * 1000 + _cell(y, TALL)


def cells(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Numbers of the grid cells that a box touches; null for a box with a null part. A box touches at most 81 x 81."""
    wide, high = F.greatest(w, F.lit(0.0)), F.greatest(h, F.lit(0.0))
    columns, rows = F.sequence(_cell(x, WIDE), _cell(x + wide, WIDE)), F.sequence(_cell(y, TALL), _cell(y + high, TALL))
    return F.flatten(F.transform(columns, lambda c: F.transform(rows, lambda r: c * 1000 + r)))


def pairs(a: DataFrame, b: DataFrame, own: Box, other: Box, reach: float = 0.0, keys: Sequence[str] = PAGE) -> DataFrame:
    """Rows of `a` beside rows of `b` of the same page whose boxes touch or lie within `reach` of each other, each pair once.

    The columns of the two sides must differ but for the keys. Both sides are spread over the grid cells they touch and meet
    by equal keys; a pair that shares several cells counts in that of its overlap's top left corner. Boxes with nulls meet
    nothing.
    """
    x, y, w, h = own
    u, v, s, t = other
    left, right = ("_x", "_y", "_w", "_h"), ("_u", "_v", "_s", "_t")
    grown = (x - reach, y - reach, F.greatest(w, F.lit(0.0)) + 2 * reach, F.greatest(h, F.lit(0.0)) + 2 * reach)
    spread_a = a.withColumns(dict(zip(left, grown, strict=True)))
    spread_b = b.withColumns(dict(zip(right, (u, v, F.greatest(s, F.lit(0.0)), F.greatest(t, F.lit(0.0))), strict=True)))
    spread_a = spread_a.withColumn("_cell", F.explode(cells(*box(*left))))
    spread_b = spread_b.withColumn("_cell", F.explode(cells(*box(*right))))
    met = spread_a.join(spread_b, [*keys, "_cell"])
    x0, y0 = F.greatest("_x", "_u"), F.greatest("_y", "_v")
    touch = (x0 <= F.least(F.col("_x") + F.col("_w"), F.col("_u") + F.col("_s"))) & (y0 <= F.least(F.col("_y") + F.col("_h"), F.col("_v") + F.col("_t")))
    return met.filter(touch & (F.col("_cell") == _number(x0, y0))).drop("_cell", *left, *right)


def native_boxes(items: DataFrame) -> DataFrame:
    """Items as the other side of a join: (doc_id, page, n_seq, nx, ny, nw, nh)."""
    return items.select(*PAGE, F.col("seq").alias("n_seq"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("width").alias("nw"), F.col("height").alias("nh"))


OTHER = ("nx", "ny", "nw", "nh")


def overlap_dedup(items: DataFrame, share: float = 0.5, ratio: float = 5.0) -> DataFrame:
    """Items without those that a later one of the page overprints.

    Two upright boxes meet if their overlap exceeds `share` of the smaller; if one is over 2.5 times as tall they must also
    share a line; the earlier goes if the texts are equal or the areas differ by at most `ratio`. Drops don't depend on
    each other, so one anti-join is exact. Rows with null geometry or rotation stay.
    """
    boxes = items.filter((F.col("width") > 0) & (F.col("height") > 0) & (G.off_axis(F.coalesce("rotation", F.lit(0.0))) <= 2))
    # texts are only compared: 128 bits of them travel
    t = F.coalesce("text", F.lit(""))
    own = boxes.select(*PAGE, "seq", F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(7), t).alias("b")).alias("t"), "x", "y", "width", "height")
    later = own.select(*PAGE, F.col("seq").alias("n_seq"), F.col("t").alias("nt"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("width").alias("nw"), F.col("height").alias("nh"))
    met = pairs(own, later, box(), box(*OTHER)).filter(F.col("seq") < F.col("n_seq"))
    area_a, area_b = F.col("width") * F.col("height"), F.col("nw") * F.col("nh")
    shared = G.box_overlap(*box(), *box(*OTHER))
    tall, short = F.greatest("height", "nh"), F.least("height", "nh")
    same_line = F.abs((F.col("y") + F.col("height") / 2) - (F.col("ny") + F.col("nh") / 2)) < short
    drop = (shared > share * F.least(area_a, area_b)) & ((tall <= 2.5 * short) | same_line) & ((F.col("t") == F.col("nt")) | (F.greatest(area_a, area_b) <= ratio * F.least(area_a, area_b)))
    return items.join(met.filter(drop).select(*PAGE, "seq").distinct(), [*PAGE, "seq"], "left_anti")


def assign_links(items: DataFrame, links: DataFrame) -> DataFrame:
    """Items with the uri of the first link (doc_id, page, pos, x1, y1, x2, y2, uri) that holds their centre.

    A link taller than 1.8 times the upper median height of what it covers is none.
    """
    centre = (F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2, F.lit(0.0), F.lit(0.0))
    area = (F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    covered = pairs(items, links, centre, area)
    medians = covered.groupBy(*PAGE, "pos").agg(G.upper_median(F.collect_list("height")).alias("typical"))
    good = covered.join(medians, [*PAGE, "pos"]).filter(F.col("y2") - F.col("y1") <= 1.8 * F.col("typical"))
    first = good.groupBy(*PAGE, "seq").agg(F.min_by("uri", "pos").alias("uri"))
    return items.join(first, [*PAGE, "seq"], "left")


def _segment() -> Box:
    return F.col("x1"), F.col("sy"), F.col("x2") - F.col("x1"), F.lit(0.0)


def struck(items: DataFrame, segments: DataFrame) -> DataFrame:
    """Items that a thin horizontal segment (doc_id, page, x1, x2, sy, thickness) strikes: in the middle band, over 60 % of the
    width; blank items and formulas are none."""
    hit = (F.col("thickness") <= 2) & (F.col("sy") >= F.col("y") + 0.2 * F.col("height")) & (F.col("sy") <= F.col("y") + 0.65 * F.col("height"))
    wide = G.overlap(F.col("x"), F.col("x") + F.col("width"), F.col("x1"), F.col("x2")) >= 0.6 * F.col("width")
    found = pairs(items.filter((F.trim("text") != "") & ~F.coalesce("math", F.lit(False))), segments, box(), _segment()).filter(hit & wide)
    return items.join(found.select(*PAGE, "seq").distinct(), [*PAGE, "seq"], "left_semi")


def union_length(intervals: Column) -> Column:
    """Length of the union of an array of structs (a, b), by one fold over the sorted array."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(-1e18).alias("upto"))
    fold = F.aggregate(
        F.array_sort(intervals), start,
        lambda s, i: F.struct((s["total"] + F.greatest(F.lit(0.0), i["b"] - F.greatest(i["a"], s["upto"]))).alias("total"), F.greatest(s["upto"], i["b"]).alias("upto")),
    )
    return fold["total"]


def underlined(items: DataFrame, segments: DataFrame) -> DataFrame:
    """Upright items under which a thin segment (doc_id, page, pos, x1, x2, sy, thickness) runs whose length text covers to 70 %."""
    long = segments.filter((F.col("x2") - F.col("x1") >= 2) & (F.col("x2") - F.col("x1") > 4 * F.col("thickness")))
    low = F.col("y") + F.col("height") + F.greatest(0.25 * F.col("height"), F.lit(2.0))
    near = (F.col("sy") >= F.col("y") + 0.8 * F.col("height")) & (F.col("sy") <= low)
    a, b = F.greatest("x", "x1"), F.least(F.col("x") + F.col("width"), F.col("x2"))
    upright = items.filter(F.pmod(F.coalesce("rotation", F.lit(0.0)), F.lit(360.0)) < 1)
    met = pairs(upright, long, (F.col("x"), F.col("y"), F.col("width"), low - F.col("y")), _segment()).filter(near & (b > a)).withColumn("a", a).withColumn("b", b)
    cover = met.groupBy(*PAGE, "pos", "x1", "x2").agg(union_length(F.collect_list(F.struct("a", "b"))).alias("length")).filter(F.col("length") >= 0.7 * (F.col("x2") - F.col("x1")))
    marked = met.join(cover.select(*PAGE, "pos"), [*PAGE, "pos"], "left_semi").filter(F.col("b") - F.col("a") >= 0.5 * F.col("width"))
    return items.join(marked.select(*PAGE, "seq").distinct(), [*PAGE, "seq"], "left_semi")


def without_native(results: DataFrame, items: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Recognised boxes that come within the tolerance of no native item: an anti-join within pages."""
    t = tolerance
    near = (F.col("x") < F.col("nx") + F.col("nw") + t) & (F.col("x") + F.col("width") > F.col("nx") - t) & (F.col("y") < F.col("ny") + F.col("nh") + t) & (F.col("y") + F.col("height") > F.col("ny") - t)
    met = pairs(results.select(*PAGE, "seq", "x", "y", "width", "height"), native_boxes(items), box(), box(*OTHER), t).filter(near)
    return results.join(met.select(*PAGE, "seq").distinct(), [*PAGE, "seq"], "left_anti")


def width_covered(results: DataFrame, items: DataFrame) -> DataFrame:
    """Share of each recognised box's width that native text on its line covers: the union of the overlaps. On its line is what
    shares over half of the lesser height; a box without width is covered."""
    a, b = F.greatest("x", "nx"), F.least(F.col("x") + F.col("width"), F.col("nx") + F.col("nw"))
    line = F.least(F.col("y") + F.col("height"), F.col("ny") + F.col("nh")) - F.greatest("y", "ny") > 0.5 * F.least("height", "nh")
    met = pairs(results.select(*PAGE, "seq", "x", "y", "width", "height"), native_boxes(items), box(), box(*OTHER)).filter(line & (b > a))
    sums = met.groupBy(*PAGE, "seq").agg(union_length(F.collect_list(F.struct(a.alias("a"), b.alias("b")))).alias("length"))
    share = F.when(F.col("width") <= 0, 1.0).otherwise(F.round(F.coalesce("length", F.lit(0.0)) / F.col("width"), 4))
    return results.join(sums, [*PAGE, "seq"], "left").withColumn("covered", share).drop("length")


def centred_in(items: DataFrame, areas: DataFrame) -> DataFrame:
    """Items beside the areas (doc_id, page, area, ax, ay, aw, ah) that hold their centre, borders included: widgets, superseded
    text, cells."""
    centre = (F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2, F.lit(0.0), F.lit(0.0))
    return pairs(items, areas, centre, box("ax", "ay", "aw", "ah"))


def lines_in_figures(lines: DataFrame, figures: DataFrame, share: float = 0.5, tall: float = 3.0) -> DataFrame:
    """Lines of which a figure (doc_id, page, figure, fx, fy, fw, fh) at least `tall` line heights high covers the share."""
    met = pairs(lines, figures, box(), box("fx", "fy", "fw", "fh"))
    covered = G.box_overlap(*box(), *box("fx", "fy", "fw", "fh")) >= share * F.col("width") * F.col("height")
    found = met.filter(covered & (F.col("width") * F.col("height") > 0) & (F.col("fh") >= tall * F.col("height")))
    return lines.join(found.select(*PAGE, "seq").distinct(), [*PAGE, "seq"], "left_semi")


def uncovered_area(paths: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, page, uncovered): area of filled paths (doc_id, page, path, px, py, pw, ph) that no item's box lies over; what
    overlaps itself counts twice, at most the whole path."""
    met = pairs(paths, native_boxes(items), box("px", "py", "pw", "ph"), box(*OTHER)).groupBy(*PAGE, "path").agg(F.sum(G.box_overlap(*box("px", "py", "pw", "ph"), *box(*OTHER))).alias("over"))
    area = F.col("pw") * F.col("ph")
    left = paths.filter(area > 0).join(met, [*PAGE, "path"], "left").withColumn("left", F.greatest(F.lit(0.0), area - F.coalesce("over", F.lit(0.0))))
    return left.groupBy(*PAGE).agg(F.round(F.sum("left"), 3).alias("uncovered"))


def nearest_track(cells_: DataFrame, tracks: DataFrame, tolerance: float = 6.0) -> DataFrame:
    """Track (doc_id, page, track, lo, hi) of each cell (doc_id, page, seq, x, width): by its centre, else its start, else its end."""
    centre = F.col("x") + F.col("width") / 2
    inside = (centre >= F.col("lo")) & (centre < F.col("hi"))
    start, end = F.abs(F.col("x") - F.col("lo")), F.abs(F.col("x") + F.col("width") - F.col("hi"))
    priority = F.when(inside, 0).when(start <= tolerance, 1).when(end <= tolerance, 2)
    distance = F.when(inside, 0.0).when(start <= tolerance, start).otherwise(end)
    flat, zero = F.lit(0.0), F.lit(0.0)
    met = pairs(cells_, tracks, (F.col("x"), flat, F.col("width"), zero), (F.col("lo"), flat, F.col("hi") - F.col("lo"), zero), tolerance)
    met = met.withColumn("priority", priority).filter(F.col("priority").isNotNull())
    best = met.groupBy(*PAGE, "seq").agg(F.min_by("track", F.struct(F.col("priority"), distance.alias("distance"), F.col("track"))).alias("track"))
    return cells_.join(best, [*PAGE, "seq"], "left")


def components(nodes: DataFrame, edges: DataFrame, most: int = 40) -> DataFrame:
    """Component (least node id) of each node of (node) under edges (a, b), by spreading least labels and halving paths.

    Each round writes its labels to the shared folder. Rounds end when no label changes; more than `most` raise an error.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(nodes.select("node", F.col("node").alias("label")))
    for _ in range(most):
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        told = labels.join(heard, labels["node"] == heard["a"], "left").select("node", F.least("label", F.coalesce("heard", "label")).alias("label"), F.col("label").alias("old"))
        root = told.select(F.col("node").alias("root"), F.col("label").alias("above"))
        jumped = told.join(root, F.col("label") == F.col("root"), "left").select("node", F.least("label", F.coalesce("above", "label")).alias("label"), "old")
        jumped = written(jumped)
        if jumped.filter("label <> old").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")
    raise RuntimeError("labels still change; allow more rounds")


def page_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, page, seq, component): components of a page's boxes (seq) under edges (seq, n_seq), named by their least seq.

    A page's graph is small: its edges come to one call, where a forest of parents joins them.
    """
    all_ = nodes.select(*PAGE, "seq", F.col("seq").alias("n_seq")).unionAll(edges.select(*PAGE, "seq", "n_seq"))

    def join(own: dict[str, list]) -> list[tuple]:
        parent: dict[int, int] = {}

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for a, b in zip(own["seq"], own["n_seq"], strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            r, s = root(a), root(b)
            parent[max(r, s)] = min(r, s)
        return [(own["doc_id"][0], own["page"][0], i, root(i)) for i in sorted(parent)]

    return map_groups(all_, PAGE, ["seq", "n_seq"], join, "doc_id long, page int, seq int, component int")


def figure_clusters(shapes: DataFrame, items: DataFrame, gap: float = 10.0, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """(doc_id, page, figure, fx, fy, fw, fh): boxes of shapes (doc_id, page, seq, x, y, width, height) that lie within `gap` of
    each other, in clusters that look like figures: large and not the whole page, not linear, several shapes or a large
    one, and hardly over text.

    Long thin horizontal rules are left out before. Text over a cluster counts by the boxes of its lines.
    """
    drawn = shapes.filter(~((F.col("width") >= 0.3 * width) & (F.col("height") <= 2.0)) & F.col("x").isNotNull() & F.col("y").isNotNull())
    own = drawn.select(*PAGE, "seq", "x", "y", "width", "height")
    edges = pairs(own, native_boxes(drawn), box(), box(*OTHER), gap).filter(F.col("seq") < F.col("n_seq")).select(*PAGE, "seq", "n_seq")
    named = own.join(page_components(own, edges), [*PAGE, "seq"])
    right, bottom = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    clusters = named.groupBy(*PAGE, F.col("component").alias("figure")).agg(
        F.min("x").alias("fx"), F.min("y").alias("fy"), (F.max(right) - F.min("x")).alias("fw"), (F.max(bottom) - F.min("y")).alias("fh"), F.count("*").alias("shapes")
    )
    area, long, short = F.col("fw") * F.col("fh"), F.greatest("fw", "fh"), F.least("fw", "fh")
    shaped = clusters.filter(
        (short >= FIGURE["extent"]) & (area >= FIGURE["area"]) & ~((F.col("fw") >= FIGURE["page"] * width) & (F.col("fh") >= FIGURE["page"] * height))
        & (long / F.greatest(short, F.lit(0.01)) <= FIGURE["aspect"]) & ((F.col("shapes") >= 2) | (area >= FIGURE["solo"]))
    )
    kept = shaped.join(_text_share(shaped, items), [*PAGE, "figure"], "left").filter(F.coalesce("share", F.lit(0.0)) <= FIGURE["text"])
    return kept.select(*PAGE, "figure", "fx", "fy", "fw", "fh")


#: Least extent and area of a figure, share of the page's sides that makes it the page, greatest aspect, least area
#: of a single shape, share of text that makes it a background of text.
FIGURE = {"extent": 30.0, "area": 1500.0, "page": 0.95, "aspect": 15.0, "solo": 5000.0, "text": 0.55}


def _text_share(clusters: DataFrame, items: DataFrame) -> DataFrame:
    """Share of each cluster that the boxes of its text lines cover; items whose middles lie within half a median height of the
    open line's make it grow."""
    met = pairs(clusters.select(*PAGE, "figure", "fx", "fy", "fw", "fh"), native_boxes(items), box("fx", "fy", "fw", "fh"), box(*OTHER))
    x0, y0 = F.greatest("nx", "fx"), F.greatest("ny", "fy")
    x1, y1 = F.least(F.col("nx") + F.col("nw"), F.col("fx") + F.col("fw")), F.least(F.col("ny") + F.col("nh"), F.col("fy") + F.col("fh"))
    inside = met.select(*PAGE, "figure", (F.col("fw") * F.col("fh")).alias("area"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), "nh", "n_seq").filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))

    def fold(own: dict[str, list]) -> list[tuple]:
        heights = sorted(h for h in (max(n, b - a) for n, a, b in zip(own["nh"], own["y0"], own["y1"], strict=True)) if h > 0.5)
        half = 0.5 * (max(heights[len(heights) // 2], 4.0) if heights else 8.0)
        parts = sorted(zip(own["x0"], own["y0"], own["x1"], own["y1"], strict=True), key=lambda p: (p[1] + p[3], p))
        open_, covered = parts[0], 0.0
        for p in parts[1:]:
            if abs(p[1] + p[3] - open_[1] - open_[3]) / 2 <= half:
                open_ = (min(open_[0], p[0]), min(open_[1], p[1]), max(open_[2], p[2]), max(open_[3], p[3]))
            else:
                covered += (open_[2] - open_[0]) * (open_[3] - open_[1])
                open_ = p
        covered += (open_[2] - open_[0]) * (open_[3] - open_[1])
        return [(own["doc_id"][0], own["page"][0], own["figure"][0], min(1.0, covered / own["area"][0]))]

    return map_groups(inside, [*PAGE, "figure"], ["n_seq"], fold, "doc_id long, page int, figure int, share double")


def rule_bands(rules: DataFrame, verticals: DataFrame | None = None, height: float = 792.0) -> DataFrame:
    """Bands between neighbouring horizontal rules (doc_id, page, y, x1, x2): 10 points to half a page apart, 60 % of the shorter
    shared, and no vertical rule (doc_id, page, vx, v1, v2) between them."""
    w = Window.partitionBy(*PAGE).orderBy("y", "x1")
    near = rules.withColumn("y2", F.lead("y").over(w)).withColumn("n1", F.lead("x1").over(w)).withColumn("n2", F.lead("x2").over(w))
    shared = G.overlap(F.col("x1"), F.col("x2"), F.col("n1"), F.col("n2"))
    good = (F.col("y2") - F.col("y")).between(10, height / 2) & (shared >= 0.6 * F.least(F.col("x2") - F.col("x1"), F.col("n2") - F.col("n1")))
    bands = near.filter(good).select(*PAGE, F.col("y").alias("top"), F.col("y2").alias("bottom"), F.greatest("x1", "n1").alias("b1"), F.least("x2", "n2").alias("b2"))
    if verticals is not None:
        area = (F.col("b1"), F.col("top"), F.col("b2") - F.col("b1"), F.col("bottom") - F.col("top"))
        crossed = pairs(bands, verticals, area, (F.col("vx"), F.col("v1"), F.lit(0.0), F.col("v2") - F.col("v1"))).filter((F.col("v1") < F.col("bottom")) & (F.col("v2") > F.col("top")))
        bands = bands.join(crossed.select(*PAGE, "top", "bottom").distinct(), [*PAGE, "top", "bottom"], "left_anti")
    return bands.select(*PAGE, "top", "bottom")


def rule_grids(horizontals: DataFrame, verticals: DataFrame, snap: float = 3.0) -> DataFrame:
    """(doc_id, page, axis, rule, component): horizontal (rule, y, x1, x2) and vertical (rule, vx, v1, v2) rules that cross
    within `snap` points form a grid; a rule that crosses none is alone."""
    hs = horizontals.select(*PAGE, F.col("rule").alias("h"), "y", "x1", "x2")
    vs = verticals.select(*PAGE, F.col("rule").alias("v"), "vx", "v1", "v2")
    crossed = pairs(hs, vs, (F.col("x1"), F.col("y"), F.col("x2") - F.col("x1"), F.lit(0.0)), (F.col("vx"), F.col("v1"), F.lit(0.0), F.col("v2") - F.col("v1")), snap)
    nodes = hs.select(*PAGE, (F.col("h") * 2).cast("int").alias("seq")).unionAll(vs.select(*PAGE, (F.col("v") * 2 + 1).cast("int").alias("seq")))
    edges = crossed.select(*PAGE, (F.col("h") * 2).cast("int").alias("seq"), (F.col("v") * 2 + 1).cast("int").alias("n_seq"))
    named = page_components(nodes, edges)
    return named.select(*PAGE, F.when(F.col("seq") % 2 == 0, "h").otherwise("v").alias("axis"), F.floor(F.col("seq") / 2).cast("int").alias("rule"), "component")


def canonical_images(images: DataFrame) -> DataFrame:
    """Images (doc_id, page, seq, content) with duplicate_of: the first image of the document with the same bytes, null for it."""
    hashed = images.withColumn("digest", F.sha2("content", 256))
    w = Window.partitionBy("doc_id", "digest").orderBy("page", "seq")
    first = F.first(F.concat_ws("/", F.col("page").cast("string"), F.col("seq").cast("string"))).over(w)
    own = F.concat_ws("/", F.col("page").cast("string"), F.col("seq").cast("string"))
    return hashed.withColumn("duplicate_of", F.when(first != own, first)).drop("content")
