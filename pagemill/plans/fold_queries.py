"""Queries of operators with growing state: lines, reading order, grids, tables, lists, blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import blocks as K
from pagemill.operators import folds
from pagemill.operators import projection as P
from pagemill.operators import tables as Q
from pagemill.operators import triage as R
from pagemill.plans import derived as D
from pagemill.plans import sql as S
from pagemill.plans.page_queries import IT, KEYS, own_sql
from pagemill.sources.tables import items

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_NUM = "coalesce(CASE WHEN isnan({0}) THEN NULL ELSE {0} END, 0.0)"
_PLACED = f"""pl AS (SELECT doc_id, page, seq, text, x, y, {_NUM.format('width')} width, {_NUM.format('height')} height, row_number() OVER (PARTITION BY doc_id, page ORDER BY y, x, seq) rn FROM it WHERE x IS NOT NULL AND y IS NOT NULL)"""
_SIZE, _BREAKS = "least(greatest(n.height, 1), 24)", "abs(n.y - r.top) >= least(r.tall, least(greatest(n.height, 1), 24)) * CASE WHEN n.height > 24 AND n.height > 2 * r.tall THEN 0.3 ELSE 0.5 END"


@query(f"""{IT.replace("WITH", "WITH RECURSIVE", 1)}, {_PLACED}, r AS (SELECT doc_id, page, seq, rn, 1 AS line, y AS top, {_SIZE.replace('n.', '')} AS tall FROM pl WHERE rn = 1
  UNION ALL SELECT n.doc_id, n.page, n.seq, n.rn, CASE WHEN {_BREAKS} THEN r.line + 1 ELSE r.line END, CASE WHEN {_BREAKS} THEN n.y ELSE least(r.top, n.y) END, CASE WHEN {_BREAKS} THEN {_SIZE} ELSE greatest(r.tall, {_SIZE}) END
    FROM r JOIN pl n ON n.doc_id = r.doc_id AND n.page = r.page AND n.rn = r.rn + 1) SELECT doc_id, page, seq, line FROM r""")
def y_band_lines(spark, d):
    """Grouping whose band grows with its members: a fold within each page."""
    return folds.band_lines(items(spark, d))


_MERGES = "abs(n.y - r.y0) < 0.5 * greatest(n.height, 1) AND n.x - (r.x0 + r.w0) BETWEEN -2.0 AND 400.0"


@query(f"""{IT.replace("WITH", "WITH RECURSIVE", 1)}, {_PLACED}, r AS (SELECT doc_id, page, rn, 1 AS grp, seq AS first, text AS t, x AS x0, y AS y0, width AS w0, 1 AS members FROM pl WHERE rn = 1
  UNION ALL SELECT n.doc_id, n.page, n.rn, CASE WHEN {_MERGES} THEN r.grp ELSE r.grp + 1 END, CASE WHEN {_MERGES} THEN r.first ELSE n.seq END, CASE WHEN {_MERGES} THEN coalesce(r.t, '') || coalesce(n.text, '') ELSE n.text END, CASE WHEN {_MERGES} THEN r.x0 ELSE n.x END,
    CASE WHEN {_MERGES} THEN r.y0 ELSE n.y END, CASE WHEN {_MERGES} THEN greatest(r.x0 + r.w0, n.x + n.width) - r.x0 ELSE n.width END, CASE WHEN {_MERGES} THEN r.members + 1 ELSE 1 END FROM r JOIN pl n ON n.doc_id = r.doc_id AND n.page = r.page AND n.rn = r.rn + 1),
  z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, grp ORDER BY rn DESC) k FROM r) SELECT doc_id, page, first AS seq, t AS text, x0 AS x, round(w0, 6) AS width, members FROM z WHERE k = 1""")
def merged_items(spark, d):
    """A gap of up to 400 points merges, as the data have one item a line and few stand side by side."""
    return folds.merge_adjacent(items(spark, d), 400.0).withColumn("width", F.round("width", 6))


@query()
def xy_cut_order(spark, d):
    return folds.reading_order(items(spark, d))


@query()
def column_counts(spark, d):
    return R.column_counts(folds.reading_order(items(spark, d)))


@query()
def layout_complexity(spark, d):
    own = items(spark, d)
    figures = D.derived(spark, d, "shapes").select("doc_id", "page", (F.col("width") * 4).alias("fw"), (F.col("height") * 4).alias("fh"))
    tables = Q.find_tables(own).select("doc_id", "page", "table", "kind").distinct()
    return R.layout_complexity(own, R.column_counts(folds.reading_order(own)), tables, figures)


@query()
def search_phrase(spark, d):
    return folds.search(items(spark, d), "in the first quarter")


_LISTED = "li AS (SELECT doc_id, page, seq AS line_no, CASE doc_id % 3 WHEN 0 THEN concat(CAST(1 + (seq - 1) % 6 AS VARCHAR(9)), '. ', text) WHEN 1 THEN concat(chr(CAST(97 + (seq - 1) % 5 AS INT)), ') ', text) ELSE text END AS line, x FROM it WHERE text <> '')"


@query()
def ordered_list_runs(spark, d):
    """Over items with numbers and letters put before them in two of three documents."""
    return folds.list_runs(own_sql(spark, d, _LISTED, "li"))


_WEDGED = f"len(list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '\\p{{Cc}}', ' ', 'g'), '{S._SPACE}'), lambda t: regexp_matches(t, '\\p{{L}}[!%*]\\p{{L}}')))"


@query(f"{IT} SELECT doc_id, page, CAST(sum(len({S.judged(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')})) AS BIGINT) AS judged, CAST(sum({S.malformed(S.judged('coalesce(text, ' + chr(39) * 2 + ')'))}) AS BIGINT) AS malformed, CAST(sum({_WEDGED}) AS BIGINT) AS misread FROM it GROUP BY doc_id, page")
def malformed_tokens(spark, d):
    return folds.token_faults(items(spark, d))


@query()
def block_kinds(spark, d):
    return folds.classify_blocks(items(spark, d))


_ROWED = "ro AS (SELECT *, CAST(floor(y / 30) AS INT) AS line FROM it WHERE x IS NOT NULL AND y IS NOT NULL)"
_BOLD = "(coalesce(font_weight >= 600, false) OR regexp_matches(lower(coalesce(font_name, '')), 'bold|black|heavy'))"
_MONO = "regexp_matches(lower(coalesce(font_name, '')), 'mono|courier|consol')"


def _mode(c: str) -> str:
    return f"(SELECT doc_id, page, line, max((w, {c}))[2] AS m_{c} FROM (SELECT doc_id, page, line, {c}, sum(n) w FROM q WHERE {c} IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"


@query(f"""{IT}, {_ROWED}, q AS (SELECT * REPLACE (CASE WHEN isnan(font_size) THEN NULL ELSE font_size END AS font_size), greatest(length(coalesce(text, '')), 1) n FROM ro),
  g AS (SELECT doc_id, page, line, coalesce(string_agg(text, ' ' ORDER BY x, seq), '') text, min(x) x, min(y) y, max(x + width) r, max(y + height) b, sum(n) n, sum(CASE WHEN {_BOLD} THEN n ELSE 0 END) bo, sum(CASE WHEN {_MONO} THEN n ELSE 0 END) mo, sum(CASE WHEN confidence IS NOT NULL THEN n ELSE 0 END) rd FROM q GROUP BY 1, 2, 3)
  SELECT g.doc_id, g.page, g.line, text, x, y, r - x AS width, b - y AS height, CASE WHEN coalesce(m_font_size <= 1.5, true) THEN m_height ELSE m_font_size END AS font_size, coalesce(m_font_size <= 1.5, true) OR 2 * rd > n AS estimated, m_font_name AS font_name, 2 * bo > n AS all_bold, 2 * mo > n AS all_mono
  FROM g LEFT JOIN {_mode('font_size')} a USING (doc_id, page, line) LEFT JOIN {_mode('height')} h USING (doc_id, page, line) LEFT JOIN {_mode('font_name')} f USING (doc_id, page, line)""")
def line_aggregates(spark, d):
    own = items(spark, d).filter("x IS NOT NULL AND y IS NOT NULL").withColumns({"line": F.floor(F.col("y") / 30).cast("int"), "font_size": F.nanvl("font_size", F.lit(None).cast("double"))})
    return P.line_aggregates(own).drop("rtl")


@query(f"{IT} SELECT doc_id, page, round(median(width / nullif(length(text), 0)), 4) AS char_width, round(median(height), 4) AS char_height FROM it WHERE width > 0 AND height > 0 GROUP BY doc_id, page")
def textbox_medians(spark, d):
    return P.textbox_medians(items(spark, d))


_EMPTY = "er AS (SELECT doc_id, page, seq AS row, coalesce(text, '') = '' OR seq % 7 IN (3, 4) OR (doc_id + page) % 9 = 0 AS empty FROM it)"


@query(f"""{IT}, {_EMPTY}, l AS (SELECT *, coalesce(lag(empty) OVER w, false) AND empty AS e2 FROM er WINDOW w AS (PARTITION BY doc_id, page ORDER BY row)),
  p AS (SELECT *, coalesce(sum(CAST(e2 AS INT)) OVER (PARTITION BY doc_id, page ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) part, min(CAST(empty AS INT)) OVER v = 1 AS nothing, min(row) OVER v fr, max(row) OVER v up FROM l WINDOW v AS (PARTITION BY doc_id, page)),
  g AS (SELECT doc_id, page, part, min(CASE WHEN NOT empty THEN row END) f, max(row) la, any_value(nothing) no, any_value(fr) fr, any_value(up) up FROM p GROUP BY 1, 2, 3)
  SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY part) AS INT) AS segment, coalesce(f, fr) AS first, CASE WHEN no THEN up ELSE la END AS last FROM g WHERE f IS NOT NULL OR (no AND part = 0)""")
def blank_segments(spark, d):
    return P.blank_segments(own_sql(spark, d, _EMPTY, "er"))


_ANCHORS = "an AS (SELECT doc_id, page, seq, y, CAST(round(x * 4) AS INT) AS anchor FROM it WHERE x IS NOT NULL), ad AS (SELECT * FROM (SELECT *, least(y - lag(y) OVER w, lead(y) OVER w - y) nr FROM an WINDOW w AS (PARTITION BY doc_id, page, anchor ORDER BY y, seq)) WHERE nr < 0.05 * 792)"


@query(f"{IT}, {_ANCHORS} SELECT doc_id, page, seq, anchor FROM ad")
def anchored_items(spark, d):
    return P.anchored(items(spark, d)).select(*KEYS, "anchor")


@query(f"""{IT}, {_ANCHORS}, sp AS (SELECT *, lead(y) OVER (PARTITION BY doc_id, page, anchor ORDER BY y, seq) below FROM ad), pr AS (SELECT * FROM sp WHERE below IS NOT NULL),
  cl AS (SELECT DISTINCT doc_id, page, anchor FROM pr p WHERE NOT EXISTS (SELECT 1 FROM it n WHERE n.doc_id = p.doc_id AND n.page = p.page AND n.seq % 2 = 0 AND n.y > p.y AND n.y < p.below AND n.x - 30 < p.anchor / 4.0 AND n.x - 30 + n.width > p.anchor / 4.0))
  SELECT doc_id, page, seq, anchor FROM ad WHERE (doc_id, page, anchor) NOT IN (SELECT (doc_id, page, anchor) FROM pr) OR (doc_id, page, anchor) IN (SELECT (doc_id, page, anchor) FROM cl)""")
def clear_anchors(spark, d):
    own = items(spark, d)
    other = own.filter("seq % 2 = 0").withColumn("x", F.col("x") - 30)
    return P.clear_anchors(P.anchored(own), other).select(*KEYS, "anchor")


@query(f"""{IT}, {_ANCHORS}, a AS (SELECT DISTINCT doc_id, page, CAST(floor(y / 30) AS INT) AS line, anchor FROM ad), fl AS (SELECT doc_id, page, CAST(floor(y / 30) AS INT) AS line, seq, x + 1.5 * (seq % 4) AS x FROM it WHERE y IS NOT NULL AND seq % 2 = 1),
  m AS (SELECT fl.doc_id, fl.page, fl.seq, min((abs(anchor / 4.0 - x), fl.line - a.line <> 1, anchor)) b FROM fl JOIN a ON a.doc_id = fl.doc_id AND a.page = fl.page AND abs(a.line - fl.line) = 1 AND abs(anchor / 4.0 - x) <= 4 GROUP BY 1, 2, 3) SELECT fl.doc_id, fl.page, fl.seq, b[3] AS anchor FROM fl LEFT JOIN m USING (doc_id, page, seq)""")
def aligned_floating(spark, d):
    own = items(spark, d)
    line = F.floor(F.col("y") / 30).cast("int")
    floating = own.filter("y IS NOT NULL AND seq % 2 = 1").select("doc_id", "page", line.alias("line"), "seq", (F.col("x") + 1.5 * (F.col("seq") % 4)).alias("x"))
    return P.aligned_floating(floating, P.anchored(own).select("doc_id", "page", line.alias("line"), "anchor")).select(*KEYS, "anchor")


_GUTTER = "gu AS (SELECT doc_id, page, seq, CASE WHEN doc_id % 2 = 0 AND seq % 3 = 0 THEN CASE WHEN seq % 2 = 0 THEN concat(CAST(seq % 90 AS VARCHAR(9)), 'O') ELSE concat(' ', CAST(seq % 90 AS VARCHAR(9)), ' ') END ELSE text END AS text, CASE WHEN doc_id % 2 = 0 AND seq % 3 = 0 THEN 302.0 ELSE x END AS x, y, CASE WHEN doc_id % 2 = 0 AND seq % 3 = 0 THEN 9.0 ELSE width END AS width, height FROM it)"


@query(f"""{IT}, {_GUTTER}, m AS (SELECT *, coalesce(regexp_matches(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), '^[0-9]{{1,2}}O?$') AND x + width / 2 > 301 AND x + width / 2 < 326 AND width < 15, false) nu, CAST(round(y) AS INT) ro FROM gu),
  c AS (SELECT doc_id, page, count(DISTINCT ro) FILTER (WHERE nu) rows, max(y) FILTER (WHERE NOT nu) low FROM m GROUP BY 1, 2), l AS (SELECT doc_id, page, ro, bool_and(nu) alone FROM m GROUP BY 1, 2, 3)
  SELECT m.doc_id, m.page, m.seq FROM m JOIN c USING (doc_id, page) LEFT JOIN l ON l.doc_id = m.doc_id AND l.page = m.page AND l.ro IS NOT DISTINCT FROM m.ro WHERE NOT (nu AND alone AND rows >= 3 AND NOT coalesce(y > low, true))""")
def gutter_numbers_dropped(spark, d):
    return P.without_gutter_numbers(own_sql(spark, d, _GUTTER, "gu")).select(*KEYS)


@query()
def script_items(spark, d):
    """Over items of which every fifth is made small and moved up or down beside the one before."""
    own = items(spark, d).filter("x IS NOT NULL AND y IS NOT NULL").withColumn("line", F.floor(F.col("seq") / 5).cast("int"))
    small = F.col("seq") % 5 == 1
    moved = {"text": F.when(small, F.substring("text", 1, 2)).otherwise(F.col("text")), "y": F.when(small, 100.0 + F.when(F.col("page") % 2 == 0, 9.0).otherwise(-2.0)).otherwise(100.0), "height": F.when(small, 5.0).otherwise(10.0),
             "x": F.when(small, 62.0).otherwise(70.0 + 100.0 * (F.col("seq") % 5)), "width": F.when(small, 6.0).otherwise(90.0)}
    return P.scripts(own.withColumns(moved))


@query()
def grid_pages(spark, d):
    return P.grid_pages(items(spark, d))


#: Items of a third of the documents set in a grid of four columns, with short texts in most of its cells.
_GRID = """gr AS (SELECT doc_id, page, seq, CASE WHEN doc_id % 3 = 0 THEN substring(coalesce(text, 'none'), 1, 12) ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN 60.0 + 130.0 * ((seq - 1) % 4) ELSE x END AS x,
  CASE WHEN doc_id % 3 = 0 THEN 80.0 + 20.0 * floor((seq - 1) / 4) ELSE y END AS y, CASE WHEN doc_id % 3 = 0 THEN 60.0 ELSE width END AS width, CASE WHEN doc_id % 3 = 0 THEN 10.0 ELSE height END AS height, CASE WHEN doc_id % 3 = 0 THEN 10.0 ELSE font_size END AS font_size
  FROM it WHERE NOT (doc_id % 3 = 0 AND seq % 11 = 6))"""
_LINES = "hl AS (SELECT DISTINCT doc_id, page, 76.0 + 20.0 * (seq - 1) AS y, 55.0 AS x1, 580.0 AS x2 FROM it WHERE doc_id % 3 = 0 AND page % 2 = 0 AND seq <= 6), vl AS (SELECT DISTINCT doc_id, page, 55.0 + 130.0 * (seq - 1) AS vx, 76.0 AS v1, 176.0 AS v2 FROM it WHERE doc_id % 3 = 0 AND page % 2 = 0 AND seq <= 5)"


def _found(spark, d):
    return Q.find_tables(own_sql(spark, d, _GRID, "gr"), own_sql(spark, d, _LINES, "hl"), own_sql(spark, d, _LINES, "vl"))


@query()
def page_tables(spark, d):
    return _found(spark, d)


@query()
def table_parts(spark, d):
    return K.split_tables(_found(spark, d))


_EDGES = "c AS (SELECT DISTINCT doc_id, page, CAST(seq AS INT) AS n, 50.0 + 130.0 * (seq - 1) AS lo, 50.0 + 130.0 * seq AS hi FROM it WHERE seq <= 4), w AS (SELECT DISTINCT doc_id, page, CAST(seq AS INT) AS n, 60.0 + 60.0 * (seq - 1) AS lo, 60.0 + 60.0 * seq AS hi FROM it WHERE seq <= 9)"


@query(f"""{IT}, {_EDGES} SELECT it.doc_id, it.page, w.n AS row, c.n AS col, string_agg(text, ' ' ORDER BY y, x, seq) AS text FROM it JOIN c ON c.doc_id = it.doc_id AND c.page = it.page AND x + width / 2 >= c.lo AND x + width / 2 < c.hi JOIN w ON w.doc_id = it.doc_id AND w.page = it.page AND y + height / 2 >= w.lo AND y + height / 2 < w.hi WHERE text IS NOT NULL GROUP BY 1, 2, 3, 4""")
def grid_cells(spark, d):
    return Q.grid_cells(items(spark, d), own_sql(spark, d, _EDGES, "c"), own_sql(spark, d, _EDGES, "w"))


@query()
def fused_regions(spark, d):
    """Regions are the four columns of the grid documents, and the pages' thirds elsewhere."""
    own = own_sql(spark, d, _GRID, "gr").filter("x IS NOT NULL AND y IS NOT NULL AND width IS NOT NULL")
    region = F.when(F.col("doc_id") % 3 == 0, (F.col("seq") - 1) % 4).otherwise(F.floor(F.col("y") / 264))
    return Q.fused_regions(own.select("doc_id", "page", region.cast("int").alias("region"), F.col("x").alias("x0"), (F.col("x") + F.col("width")).alias("x1"), F.col("y").alias("y0"), F.char_length(F.coalesce("text", F.lit(""))).alias("chars")))


_BLOCKS = """bl AS (SELECT doc_id, page, seq AS block, CASE WHEN seq % 8 = 3 THEN 'figure' WHEN seq % 8 IN (5, 6) OR (doc_id + page) % 10 = 0 THEN 'rule' ELSE 'paragraph' END AS kind, CASE WHEN seq % 4 = 1 THEN concat(text, '-') WHEN seq % 4 = 2 THEN lower(text) ELSE text END AS text,
  seq % 9 = 0 AS bold, false AS italic FROM it)"""


@query()
def spliced_blocks(spark, d):
    return K.splice_blocks(own_sql(spark, d, _BLOCKS, "bl"))


@query(f"""{IT}, {_BLOCKS}, m AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id, page ORDER BY block) old, min(CASE WHEN kind <> 'rule' THEN block END) OVER v f, max(CASE WHEN kind <> 'rule' THEN block END) OVER v l FROM bl WINDOW v AS (PARTITION BY doc_id, page))
  SELECT doc_id, page, block, kind FROM m WHERE kind <> 'rule' OR (block > f AND block < l AND coalesce(old, '') <> 'rule')""")
def rules_once(spark, d):
    return K.without_repeated_rules(own_sql(spark, d, _BLOCKS, "bl")).select("doc_id", "page", "block", "kind")


@query(f"""{IT}, {_BLOCKS}, c AS (SELECT * FROM bl WHERE page % 2 = 1), k AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY page) n FROM c) SELECT doc_id, page, block FROM k WHERE n <= 2""")
def kept_pages(spark, d):
    own = own_sql(spark, d, _BLOCKS, "bl")
    return K.kept_pages(own, own.filter("page % 2 = 1"), 2).select("doc_id", "page", "block")


_INDEXED = "ix AS (SELECT doc_id, page, CAST(floor(seq / 3) AS INT) AS block, seq FROM it)"


@query(f"""{IT}, {_INDEXED} SELECT ix.doc_id, ix.page, ix.block, list(ix.seq ORDER BY ix.seq) AS item_indices, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM ix JOIN it USING (doc_id, page, seq) GROUP BY 1, 2, 3""")
def remapped_boxes(spark, d):
    own = own_sql(spark, d, _INDEXED, "ix").groupBy("doc_id", "page", "block").agg(F.array_sort(F.collect_list("seq")).alias("s"))
    twice = own.select("doc_id", "page", "block", F.concat("s", "s").alias("item_indices"))
    return K.remapped_boxes(twice, items(spark, d))
