"""Queries of recognition, heading and direction operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import bidi as B
from pagemill.functions import text as T
from pagemill.operators import headings as H
from pagemill.operators import layout as L
from pagemill.operators import recognition as O
from pagemill.plans import derived as D
from pagemill.plans import sql as S
from pagemill.runtime import table, written
from pagemill.sources.tables import items

QUERIES, SQL = {}, {}
KEYS = ["doc_id", "page", "seq"]
IT = f"WITH {S.ITEMS}"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def own_sql(spark, d, ctes: str, name: str):
    """A derived table by SQL that both engines read."""
    return spark.sql(f"{IT.replace('FROM text_items', 'FROM {text_items}')}, {ctes} SELECT * FROM {name}", text_items=table(spark, d, "text_items").repartition("doc_id", "page"))


_PARTS = """nt AS (SELECT doc_id, page, seq, text, x, y, width, height, coalesce(font_name, '(none)') AS font_name, seq % 29 = 1 AS unusable FROM it WHERE seq % 3 <> 0),
  rs AS (SELECT doc_id, page, seq, 144.0 AS dpi, CASE WHEN seq % 21 = 0 THEN '|' WHEN seq % 15 = 0 THEN '[1,234)' ELSE text END AS text, 2 * (x + width * 0.7 * (seq % 2)) AS x1, 2 * (y + height * 0.45 * (seq % 5)) AS y1,
    2 * (x + width * 0.7 * (seq % 2) + CASE WHEN seq % 21 = 0 THEN 1.0 ELSE width END) AS x2, 2 * (y + height * 0.45 * (seq % 5) + height) AS y2, CASE WHEN seq % 18 = 0 THEN 0.1 ELSE 0.61239 END AS confidence, (doc_id + page) % 4 <> 0 AS has_native_text
    FROM it WHERE seq % 3 = 0 AND page % 5 <> 2)"""
_SCOPES = "so AS (SELECT DISTINCT doc_id, page, CASE (doc_id + page) % 6 WHEN 1 THEN 'whole' ELSE 'fonts' END AS scope FROM it WHERE (doc_id + page) % 6 IN (1, 2, 3))"
#: Fonts that are taken as garbled on pages of scope 'fonts'.
_FONTS = ("Helvetica", "Times-Roman", "(none)")


@query(f"""{IT}, {_PARTS}, {_SCOPES}, asked AS (SELECT DISTINCT doc_id, page FROM rs),
  kept AS (SELECT nt.*, so.scope FROM nt LEFT JOIN so USING (doc_id, page) WHERE (doc_id, page) IN (SELECT (doc_id, page) FROM asked) AND NOT unusable AND NOT coalesce(scope = 'whole' OR (scope = 'fonts' AND font_name IN {_FONTS}), false)),
  b AS (SELECT *, x1 * 0.5 AS x, y1 * 0.5 AS y, (x2 - x1) * 0.5 AS width, (y2 - y1) * 0.5 AS height, regexp_replace(text, '^[\\s\\x{{0085}}\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+|[\\s\\x{{0085}}\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+$', '', 'g') tt FROM rs WHERE confidence > 0.1),
  re AS (SELECT b.*, so.scope FROM b LEFT JOIN so USING (doc_id, page) WHERE NOT (has_native_text AND coalesce(NOT regexp_matches(tt, '[\\p{{L}}\\p{{N}}]') OR (regexp_matches(tt, '^[|Il1!ij\\[\\](){{}}/\\\\]$') AND height > 0 AND width < 0.35 * height), true))),
  ap AS (SELECT * FROM re r WHERE coalesce(scope, '') <> 'fonts' AND NOT EXISTS (SELECT 1 FROM kept n WHERE n.doc_id = r.doc_id AND n.page = r.page AND r.x < n.x + n.width + 2 AND r.x + r.width > n.x - 2 AND r.y < n.y + n.height + 2 AND r.y + r.height > n.y - 2)),
  m AS (SELECT r.doc_id, r.page, r.seq, greatest(r.x, n.x) a, least(r.x + r.width, n.x + n.width) e FROM re r JOIN kept n ON n.doc_id = r.doc_id AND n.page = r.page AND r.scope = 'fonts' WHERE least(r.y + r.height, n.y + n.height) - greatest(r.y, n.y) > 0.5 * least(r.height, n.height) AND least(r.x + r.width, n.x + n.width) > greatest(r.x, n.x)),
  u AS (SELECT doc_id, page, seq, sum(greatest(0, e - greatest(a, coalesce(upto, -1e18)))) AS length FROM (SELECT *, max(e) OVER (PARTITION BY doc_id, page, seq ORDER BY a, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) upto FROM m) GROUP BY 1, 2, 3),
  co AS (SELECT re.* FROM re LEFT JOIN u USING (doc_id, page, seq) WHERE scope = 'fonts' AND CASE WHEN width <= 0 THEN 1.0 ELSE round(coalesce(length, 0) / width, 4) END < 0.5),
  c0 AS (SELECT * FROM ap UNION ALL SELECT * FROM co), c1 AS (SELECT *, trim(text, ' ') s, regexp_replace(regexp_replace(trim(text, ' '), '^[|\\[\\]{{}}\\s]+', ''), '[|\\[\\]{{}}\\s]+$', '') o FROM c0),
  c2 AS (SELECT *, regexp_replace(regexp_replace(o, '^[|\\[\\](){{}}\\s]+', ''), '[|\\[\\](){{}}\\s]+$', '') core FROM c1),
  ac AS (SELECT *, CASE WHEN regexp_matches(core, '^[0-9,.% +*/-]*[0-9][0-9,.% +*/-]*$|^N/A$|^Z$|^-$') THEN CASE WHEN o LIKE '(%' AND o LIKE '%)' THEN '(' || core || ')' ELSE core END ELSE s END AS cleaned FROM c2),
  ok AS (SELECT * FROM ac WHERE coalesce(cleaned, '') <> ''), la AS (SELECT doc_id, page, max(seq) l FROM nt GROUP BY 1, 2),
  gone AS (SELECT DISTINCT n.doc_id, n.page, n.seq FROM kept n JOIN ok r ON n.doc_id = r.doc_id AND n.page = r.page AND n.scope = 'fonts' AND n.x + n.width / 2 BETWEEN r.x AND r.x + r.width AND n.y + n.height / 2 BETWEEN r.y AND r.y + r.height)
  SELECT doc_id, page, seq, text, font_name, CAST(NULL AS DOUBLE) AS confidence FROM nt WHERE (doc_id, page) NOT IN (SELECT (doc_id, page) FROM asked)
  UNION ALL SELECT doc_id, page, seq, text, font_name, NULL FROM kept WHERE (doc_id, page, seq) NOT IN (SELECT (doc_id, page, seq) FROM gone)
  UNION ALL SELECT doc_id, page, coalesce(l, 0) + 1 + seq, cleaned, 'OCR', round(confidence, 3) FROM ok LEFT JOIN la USING (doc_id, page)""")
def ocr_merge(spark, d):
    scopes = own_sql(spark, d, _SCOPES, "so").withColumn("fonts", F.array(*[F.lit(f) for f in _FONTS]))
    merged = O.merge_recognised(own_sql(spark, d, _PARTS, "nt"), own_sql(spark, d, _PARTS, "rs"), scopes)
    return merged.select(*KEYS, "text", "font_name", "confidence")


_CORNERS = "co AS (SELECT doc_id, page, seq, x AS px1, y AS py1, x + width AS px2, y + width * 0.01 * ((doc_id + page) % 5 + seq % 2) AS py2, x AS px4, y + height * 0.5 AS py4 FROM it WHERE x IS NOT NULL AND y IS NOT NULL)"
_SKEW = """sl AS (SELECT doc_id, page, degrees(atan2(py2 - py1, px2 - px1)) angle, sqrt((px2 - px1) * (px2 - px1) + (py2 - py1) * (py2 - py1)) size, sqrt((px4 - px1) * (px4 - px1) + (py4 - py1) * (py4 - py1)) tall FROM co),
  sw AS (SELECT *, count(*) OVER w n, sum(size) OVER w / 2 half, sum(size) OVER (PARTITION BY doc_id, page ORDER BY angle, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) upto FROM sl WHERE size >= 4 * tall AND size > 0 AND abs(angle) <= 45 WINDOW w AS (PARTITION BY doc_id, page)),
  sk AS (SELECT doc_id, page, min_by(angle, (angle, size)) middle FROM sw WHERE n >= 3 AND upto >= half GROUP BY 1, 2), sn AS (SELECT doc_id, page, CASE WHEN abs(middle) BETWEEN 0.3 AND 10 THEN round(middle, 6) END AS skew FROM sk)"""


@query(f"{IT}, {_CORNERS}, {_SKEW} SELECT doc_id, page, round(skew, 3) AS skew FROM sn")
def page_skew(spark, d):
    return O.page_skew(own_sql(spark, d, _CORNERS, "co")).withColumn("skew", F.round("skew", 3))


@query(f"""{IT}, sn AS (SELECT DISTINCT doc_id, page, CASE WHEN page % 3 = 0 THEN 2.5 WHEN page % 3 = 1 THEN -1.0 END AS skew FROM it), t AS (SELECT it.*, skew, x + width / 2 - 306 dx, y + height / 2 - 396 dy, radians(-skew) a FROM it LEFT JOIN sn USING (doc_id, page))
  SELECT doc_id, page, seq, round(CASE WHEN skew IS NULL THEN x ELSE 306 + dx * cos(a) - dy * sin(a) - width / 2 END, 3) AS x, round(CASE WHEN skew IS NULL THEN y ELSE 396 + dx * sin(a) + dy * cos(a) - height / 2 END, 3) AS y FROM t""")
def deskewed(spark, d):
    own = items(spark, d)
    skews = own.select("doc_id", "page").distinct().withColumn("skew", F.when(F.col("page") % 3 == 0, 2.5).when(F.col("page") % 3 == 1, -1.0))
    return O.deskewed(own, skews).select(*KEYS, F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


_TURNED = "tu AS (SELECT * REPLACE (CASE WHEN page % 4 = 0 THEN coalesce(rotation, 0) + 90 * (doc_id % 4) WHEN seq % 9 = 0 THEN 180.0 ELSE rotation END AS rotation) FROM it)"


@query(f"""{IT}, {_TURNED}, q AS (SELECT *, CAST(round((((coalesce(rotation, 0) % 360) + 360) % 360) / 90) AS INT) % 4 q FROM tu), c AS (SELECT doc_id, page, q, sum(length(coalesce(text, ''))) n FROM q GROUP BY 1, 2, 3),
  v AS (SELECT doc_id, page, max_by(q, (n, q)) tq, max(n) tn, sum(n) total FROM c GROUP BY 1, 2), z AS (SELECT tu.*, coalesce(CASE WHEN tq <> 0 AND total >= 20 AND tn * 10 >= total * 7 THEN tq END, 0) k FROM tu JOIN v USING (doc_id, page))
  SELECT doc_id, page, seq, k AS turn, CASE k WHEN 1 THEN 792 - (y + height) WHEN 2 THEN 612 - (x + width) WHEN 3 THEN y ELSE x END AS x, CASE k WHEN 1 THEN x WHEN 2 THEN 792 - (y + height) WHEN 3 THEN 612 - (x + width) ELSE y END AS y,
  CASE WHEN k % 2 = 1 THEN height ELSE width END AS width, CASE WHEN k = 0 THEN rotation ELSE 0 END AS rotation FROM z""")
def upright_scans(spark, d):
    own = items(spark, d)
    turned = F.when(F.col("page") % 4 == 0, F.coalesce("rotation", F.lit(0.0)) + 90.0 * (F.col("doc_id") % 4)).when(F.col("seq") % 9 == 0, 180.0).otherwise(F.col("rotation"))
    return O.upright_scans(own.withColumn("rotation", turned)).select(*KEYS, "turn", "x", "y", "width", "rotation")


@query(f"""{IT} SELECT doc_id, page, seq FROM it WHERE coalesce(NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]') OR (regexp_matches(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '^[|Il1!ij\\[\\](){{}}/\\\\]$') AND height > 0 AND width < 0.35 * height), true)""")
def rule_artifacts(spark, d):
    return items(spark, d).filter(O.is_rule_artifact(F.col("text"), F.col("width"), F.col("height"))).select(*KEYS)


_PAGES = "pg AS (SELECT DISTINCT doc_id, page, 612.0 + 900.0 * (page % 3) AS page_width, 792.0 + 3000.0 * (page % 2) AS page_height FROM it)"
_NEED = "td AS (SELECT doc_id, page, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS text_length, CASE page % 3 WHEN 0 THEN '' WHEN 1 THEN 'scanned' ELSE 'sparse-text,invisible-text-layer' END AS reasons, page % 3 <> 0 AS needs_ocr FROM it GROUP BY doc_id, page)"


@query(f"""{IT}, {_PAGES}, {_NEED} SELECT td.doc_id, td.page, CAST(row_number() OVER (PARTITION BY td.doc_id ORDER BY td.page) AS INT) AS seq, round(least(150, 4096.0 * 72 / greatest(page_width, page_height)), 4) AS dpi, text_length > 0 AS has_native_text,
  reasons LIKE '%invisible%' AS replace_native FROM td JOIN pg USING (doc_id, page) WHERE needs_ocr""")
def recognition_tasks(spark, d):
    return O.recognition_tasks(own_sql(spark, d, _NEED, "td"), own_sql(spark, d, _PAGES, "pg"))


_SUPPLIED = "im AS (SELECT DISTINCT doc_id, page, concat('p', CAST(page AS VARCHAR(9)), '.png') AS path, 612.0 AS page_width, 792.0 AS page_height, 1275.0 + 40.0 * (doc_id % 3) AS pixel_width, 1650.0 AS pixel_height FROM it WHERE page % 2 = 0)"


@query(f"""{IT}, {_SUPPLIED}, ta AS (SELECT DISTINCT doc_id, page, 150.0 AS dpi FROM it), g AS (SELECT *, pixel_width * 72 / page_width a, pixel_height * 72 / page_height b FROM im), k AS (SELECT doc_id, page, path, round(CASE WHEN page_width >= page_height THEN a ELSE b END, 4) own FROM g WHERE abs(a - b) <= 0.02 * greatest(a, b))
  SELECT ta.doc_id, ta.page, coalesce(own, dpi) AS dpi, path FROM ta LEFT JOIN k USING (doc_id, page)""")
def supplied_images(spark, d):
    tasks = items(spark, d).select("doc_id", "page").distinct().withColumn("dpi", F.lit(150.0))
    return O.supplied_images(tasks, own_sql(spark, d, _SUPPLIED, "im"))


@query(f"{IT} SELECT DISTINCT doc_id, page, seq, seq % 2 = 0 AS failed FROM it")
def outcome_pages(spark, d):
    own = items(spark, d)
    return O.matched_outcomes(own.select(*KEYS, (F.col("seq") % 2 == 0).alias("failed")), own)


@query(f"{D.sql('tags')}, m AS (SELECT doc_id, page, pos, CAST(regexp_extract(trim(role, ' '), '^[Hh]([1-6])$', 1) AS INT) lv, unnest([m1, m2]) mcid FROM tags WHERE regexp_matches(trim(role, ' '), '^[Hh][1-6]$')), f AS (SELECT doc_id, page, mcid, min_by(lv, pos) AS tag_level FROM m WHERE mcid IS NOT NULL GROUP BY 1, 2, 3) SELECT it.doc_id, it.page, it.seq, tag_level FROM it LEFT JOIN f USING (doc_id, page, mcid)")
def tag_levels(spark, d):
    tags = D.derived(spark, d, "tags").withColumn("mcids", F.array("m1", "m2"))
    return H.tag_levels(items(spark, d), tags).select(*KEYS, "tag_level")


@query(f"""{D.sql("outline")}, o AS (SELECT doc_id, page, pos, level, lower({S.collapse('title')}) t, y_pdf FROM outline), l AS (SELECT doc_id, page, seq, lower({S.collapse('text')}) n, y, height FROM it),
  m AS (SELECT l.doc_id, l.page, l.seq, pos, least(level, 6) lv FROM l JOIN o ON l.doc_id = o.doc_id AND l.page = o.page WHERE t <> '' AND n <> '' AND (y_pdf IS NULL OR 792 - y_pdf < 0 OR 792 - y_pdf > 792 OR abs(792 - y_pdf - y) <= 1.5 * greatest(height, 1))
    AND length(n) <= greatest(length(t) * 3, 120) AND (length(n) - length(replace(n, '. ', ''))) / 2 < 2 AND NOT ((length(n) - length(replace(n, '. ', ''))) / 2 >= 1 AND length(n) > length(t) + 15) AND (starts_with(n, t) OR starts_with(t, n))),
  f AS (SELECT doc_id, page, seq, min_by(lv, pos) AS outline_level FROM m GROUP BY 1, 2, 3) SELECT it.doc_id, it.page, it.seq, outline_level FROM it LEFT JOIN f USING (doc_id, page, seq)""")
def outline_levels(spark, d):
    own = written(items(spark, d).select(*KEYS, "text", "y", "height"))
    return H.outline_levels(own, D.derived(spark, d, "outline")).select(*KEYS, "outline_level")


_SIDE = "CASE WHEN (doc_id + page) % 5 = 0 AND seq % 3 <> 0 THEN 90.0 WHEN seq % 10 = 7 THEN 270.0 ELSE rotation END"
_IS_SIDE = "NOT (abs(coalesce(rotation, 0)) % 360 < 5 OR abs(coalesce(rotation, 0)) % 360 BETWEEN 175 AND 185 OR abs(coalesce(rotation, 0)) % 360 >= 355)"
_N = f"length(regexp_replace(coalesce(text, ''), '{S._SPACE}', '', 'g'))"


@query(f"""{IT}, s AS (SELECT * REPLACE ({_SIDE} AS rotation) FROM it), w AS (SELECT *, {_IS_SIDE} sd, sum(CASE WHEN {_IS_SIDE} THEN {_N} ELSE 0 END) OVER p * 10 >= 3 * sum({_N}) OVER p AND sum({_N}) OVER p > 0 ct FROM s WINDOW p AS (PARTITION BY doc_id, page)) SELECT doc_id, page, seq FROM w WHERE NOT sd OR ct""")
def sideways_lines(spark, d):
    return H.without_furniture(items(spark, d).withColumn("rotation", F.expr(_SIDE))).select(*KEYS)


@query(f"""{IT}, s AS (SELECT * REPLACE ({_SIDE} AS rotation), CAST(floor(y / 40) AS INT) AS line FROM it), w AS (SELECT *, {_IS_SIDE} sd, sum(CASE WHEN {_IS_SIDE} THEN {_N} ELSE 0 END) OVER p < sum(CASE WHEN {_IS_SIDE} THEN 0 ELSE {_N} END) OVER p st FROM s WINDOW p AS (PARTITION BY doc_id, page, line)) SELECT doc_id, page, seq FROM w WHERE NOT sd OR NOT st""")
def stray_sideways(spark, d):
    own = items(spark, d).withColumn("rotation", F.expr(_SIDE)).withColumn("line", F.floor(F.col("y") / 40).cast("int"))
    return H.without_stray(own).select(*KEYS)


_W = "PARTITION BY doc_id, page ORDER BY seq"
_CONT = lambda a, b: f"coalesce(abs({a}.sz - {b}.sz) <= 0.5 AND {a}.bo = {b}.bo AND {b}.x - {a}.x <= 6 AND {b}.y - ({a}.y + {a}.height) <= 1.5 * greatest({a}.height, {b}.height), false)"


@query(rf"""{IT}, f AS (SELECT *, coalesce(CASE WHEN isnan(font_size) THEN NULL ELSE font_size END, height) sz, coalesce(font_weight >= 600, false) bo, trim(text, ' ') t, row_number() OVER ({_W}) rn FROM it),
  r AS (SELECT *, regexp_extract(t, '^(.*?)(?:\. |: )(.*)$', 1) hd, trim(regexp_extract(t, '^(.*?)(?:\. |: )(.*)$', 2), ' ') rs FROM f), q AS (SELECT *, len(list_filter(string_split_regex(rs, '\s+'), lambda x: x <> '')) wc FROM r)
  SELECT c.doc_id, c.page, c.seq FROM q c LEFT JOIN f p ON p.doc_id = c.doc_id AND p.page = c.page AND p.rn = c.rn - 1 LEFT JOIN f n ON n.doc_id = c.doc_id AND n.page = c.page AND n.rn = c.rn + 1
  WHERE c.t <> '' AND length(c.t) <= 80 AND NOT regexp_matches(c.t, '{T.CAPTION}') AND NOT regexp_matches(c.t, '{T.ATTRIBUTION}') AND c.bo AND c.t NOT LIKE '%.' AND NOT (rs <> '' AND NOT regexp_matches(hd, '^(?:(?:Sec|Section|Ch|Chapter|Part|§)\.?\s+)?[0-9]+(?:\.[0-9]+)*$')
    AND regexp_matches(rs, '^[A-Z]') AND ((wc >= 2 AND c.t LIKE '%-') OR (wc >= 3 AND length(c.t) > 50))) AND NOT regexp_matches(c.t, '^\p{{Ll}}') AND length(regexp_replace(c.t, '[^\p{{L}}]', '', 'g')) / nullif(length(regexp_replace(c.t, '{S._SPACE}', '', 'g')), 0) >= 0.5
    AND NOT regexp_matches(c.t, '\S {{2,}}\S.* {{2,}}\S') AND (p.seq IS NULL OR NOT {_CONT("p", "c")}) AND (n.seq IS NULL OR NOT {_CONT("c", "n")} OR n.bo)""")
def bold_headings(spark, d):
    return H.bold_headings(items(spark, d).withColumn("font_size", F.nanvl("font_size", F.lit(None)))).select(*KEYS)


@query()
def wrapped_headings(spark, d):
    own = items(spark, d).withColumn("level", F.when(F.col("font_weight") >= 600, 1 + F.col("page") % 2).cast("int"))
    return H.wrapped_headings(own)


_MIXED = "concat(CASE seq % 4 WHEN 0 THEN 'كتاب جديد ' WHEN 1 THEN 'ספר ישן על המדף ' ELSE '' END, CASE WHEN seq % 3 = 0 THEN substring(text, 1, 4) ELSE text END)"
_RTL_SQL, _LTR_SQL = S.matches("t", f"[{B.RTL}]"), f"length(regexp_replace(t, '[^\\p{{L}}]|[{B.RTL}]', '', 'g'))"


@query(f"{IT}, x AS (SELECT doc_id, page, seq, {_MIXED} AS t FROM it WHERE text IS NOT NULL) SELECT doc_id, page, seq, {_RTL_SQL} AS rtl, {_LTR_SQL} AS ltr, {_RTL_SQL} > {_LTR_SQL} AS runs_left, CASE WHEN regexp_matches(substr(t, 1, 1), '[{B.RTL}]') THEN 'R' WHEN regexp_matches(substr(t, 1, 1), '\\p{{L}}') THEN 'L' ELSE 'N' END AS first FROM x")
def text_direction(spark, d):
    c = F.col("t")
    own = items(spark, d).filter("text IS NOT NULL").select(*KEYS, F.expr(_MIXED).alias("t"))
    return own.select(*KEYS, B.rtl_count(c).alias("rtl"), B.ltr_count(c).alias("ltr"), B.is_rtl(c).alias("runs_left"), B.bidi_class(c).alias("first"))


@query(f"""{IT}, x AS (SELECT doc_id, page, CAST(floor(seq / 4) AS INT) AS line, seq, {_MIXED} AS p FROM it WHERE text IS NOT NULL), g AS (SELECT doc_id, page, line, string_agg(p, '' ORDER BY seq) t, list(p ORDER BY seq) ps FROM x GROUP BY 1, 2, 3)
  SELECT doc_id, page, line, array_to_string(CASE WHEN {_RTL_SQL} > {_LTR_SQL} THEN list_reverse(ps) ELSE ps END, ' ') AS text FROM g""")
def joined_pieces(spark, d):
    own = items(spark, d).filter("text IS NOT NULL").select("doc_id", "page", F.floor(F.col("seq") / 4).cast("int").alias("line"), "seq", F.expr(_MIXED).alias("p"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "p"))), lambda s: s["p"])
    return own.groupBy("doc_id", "page", "line").agg(ordered.alias("ps")).select("doc_id", "page", "line", B.joined(F.col("ps")).alias("text"))


@query(f"{IT}, p AS (SELECT DISTINCT doc_id, page FROM it) SELECT doc_id, page, CAST(floor((dense_rank() OVER (PARTITION BY doc_id ORDER BY page) - 1) / 4) AS INT) + 1 AS batch FROM p")
def page_batches(spark, d):
    return L.page_batches(items(spark, d).select("doc_id", "page").distinct(), 4)


@query(f"{IT}, p AS (SELECT doc_id, unnest(range(1, page_count + 1)) AS page FROM documents WHERE page_count >= 1), s AS (SELECT doc_id, page, count(*) n FROM it GROUP BY 1, 2) SELECT p.doc_id, CAST(p.page AS INT) AS page, n FROM p LEFT JOIN s ON s.doc_id = p.doc_id AND s.page = p.page")
def attached_stats(spark, d):
    pages = table(spark, d, "documents").filter("page_count >= 1").select("doc_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page"))
    return L.attached(pages, items(spark, d).groupBy("doc_id", "page").agg(F.count("*").alias("n")))


@query("SELECT doc_id, page, seq, text, x, y, width, height, fill_color, stroke_color, mcid, count(*) AS n FROM text_items GROUP BY ALL")
def chosen_features(spark, d):
    own = L.with_features(table(spark, d, "text_items"), "tags", "colour")
    return own.groupBy(*own.columns).agg(F.count("*").alias("n"))
