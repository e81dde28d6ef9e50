"""Queries of spatial, recognition, evaluation and rendering operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import text as T
from pagemill.operators import evaluation as E
from pagemill.operators import folds
from pagemill.operators import layout as L
from pagemill.operators import render as R
from pagemill.operators import spatial as J
from pagemill.plans import derived as D
from pagemill.plans import sql as S
from pagemill.runtime import table, written
from pagemill.sources.tables import document_lines, items

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


IT = f"WITH {S.ITEMS}"
KEYS = ["doc_id", "page", "seq"]


def on(a: str, b: str) -> str:
    return f"{a}.doc_id = {b}.doc_id AND {a}.page = {b}.page"


_OVER = "greatest(0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y))"


@query(f"""{D.sql("it2")}, u AS (SELECT *, coalesce(text, '') t FROM it2 WHERE width > 0 AND height > 0 AND abs(coalesce(rotation, 0) - round(coalesce(rotation, 0) / 90) * 90) <= 2),
  gone AS (SELECT DISTINCT a.doc_id, a.page, a.seq FROM u a JOIN u b ON {on("a", "b")} AND a.seq < b.seq WHERE {_OVER} > 0.5 * least(a.width * a.height, b.width * b.height)
    AND (greatest(a.height, b.height) <= 2.5 * least(a.height, b.height) OR abs((a.y + a.height / 2) - (b.y + b.height / 2)) < least(a.height, b.height))
    AND (a.t = b.t OR greatest(a.width * a.height, b.width * b.height) <= 5 * least(a.width * a.height, b.width * b.height)))
  SELECT doc_id, page, seq FROM it2 WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE {on("g", "it2")} AND g.seq = it2.seq)""")
def overlap_dedup(spark, d):
    columns = ["doc_id", "page", "seq", "text", "x", "y", "width", "height", "rotation"]
    return J.overlap_dedup(written(D.derived(spark, d, "it2").select(*columns))).select(*KEYS)


@query(f"""{D.sql("links")}, c AS (SELECT it.doc_id, it.page, it.seq, it.height, l.pos, l.uri, y2 - y1 lh FROM it JOIN links l ON {on("it", "l")} AND x + width / 2 BETWEEN x1 AND x2 AND y + height / 2 BETWEEN y1 AND y2),
  m AS (SELECT doc_id, page, pos, (list_sort(list(height)))[CAST(floor(count(*) / 2) AS BIGINT) + 1] typical FROM c GROUP BY 1, 2, 3),
  f AS (SELECT c.doc_id, c.page, c.seq, min_by(uri, c.pos) uri FROM c JOIN m ON {on("c", "m")} AND c.pos = m.pos WHERE lh <= 1.8 * typical GROUP BY 1, 2, 3)
  SELECT it.doc_id, it.page, it.seq, f.uri FROM it LEFT JOIN f ON {on("it", "f")} AND it.seq = f.seq""")
def link_assign(spark, d):
    return J.assign_links(items(spark, d), D.derived(spark, d, "links")).select(*KEYS, "uri")


@query(f"""{D.sql("segments")} SELECT DISTINCT it.doc_id, it.page, it.seq FROM it JOIN segments s ON {on("it", "s")} WHERE thickness <= 2 AND sy >= y + 0.2 * height AND sy <= y + 0.65 * height
  AND greatest(0, least(x + width, x2) - greatest(x, x1)) >= 0.6 * width AND trim(text, ' ') <> '' AND NOT coalesce(math, false)""")
def strike_assign(spark, d):
    return J.struck(items(spark, d), D.derived(spark, d, "segments")).select(*KEYS)


_UNION = "SELECT {k}, sum(greatest(0, e - greatest(a, coalesce(upto, -1e18)))) AS length FROM (SELECT *, max(e) OVER (PARTITION BY {k} ORDER BY a, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) upto FROM m) GROUP BY {k}"


@query(f"""{D.sql("segments")}, m AS (SELECT it.doc_id, it.page, it.seq, it.width, s.pos, x1, x2, greatest(x, x1) a, least(x + width, x2) e FROM it JOIN segments s ON {on("it", "s")}
  WHERE x2 - x1 >= 2 AND x2 - x1 > 4 * thickness AND sy >= y + 0.8 * height AND sy <= y + height + greatest(0.25 * height, 2) AND least(x + width, x2) > greatest(x, x1) AND ((coalesce(rotation, 0) % 360) + 360) % 360 < 1),
  c AS ({_UNION.format(k="doc_id, page, pos, x1, x2")}) SELECT DISTINCT m.doc_id, m.page, m.seq FROM m JOIN c ON {on("m", "c")} AND m.pos = c.pos WHERE length >= 0.7 * (c.x2 - c.x1) AND e - a >= 0.5 * width""")
def underline_assign(spark, d):
    return J.underlined(items(spark, d), D.derived(spark, d, "segments")).select(*KEYS)


def _recognised(spark, d):
    return D.derived(spark, d, "recognised"), D.derived(spark, d, "native")


_RN = D.sql("recognised", "native")


@query(f"""{_RN} SELECT doc_id, page, seq FROM recognised r WHERE NOT EXISTS (SELECT 1 FROM native b WHERE {on("b", "r")} AND r.x < b.x + b.width + 2 AND r.x + r.width > b.x - 2 AND r.y < b.y + b.height + 2 AND r.y + r.height > b.y - 2)""")
def ocr_anti_join(spark, d):
    return J.without_native(*_recognised(spark, d)).select(*KEYS)


@query(f"""{_RN}, m AS (SELECT r.doc_id, r.page, r.seq, greatest(r.x, b.x) a, least(r.x + r.width, b.x + b.width) e FROM recognised r JOIN native b ON {on("b", "r")}
    WHERE least(r.y + r.height, b.y + b.height) - greatest(r.y, b.y) > 0.5 * least(r.height, b.height) AND least(r.x + r.width, b.x + b.width) > greatest(r.x, b.x)), c AS ({_UNION.format(k="doc_id, page, seq")})
  SELECT r.doc_id, r.page, r.seq, CASE WHEN width <= 0 THEN 1.0 ELSE round(coalesce(length, 0) / width, 4) END AS covered FROM recognised r LEFT JOIN c ON {on("c", "r")} AND c.seq = r.seq""")
def ocr_coverage(spark, d):
    return J.width_covered(*_recognised(spark, d)).select(*KEYS, "covered")


@query(f"""{_RN} SELECT b.doc_id, b.page, b.seq, r.seq AS area FROM native b JOIN recognised r ON {on("b", "r")} AND b.x + b.width / 2 BETWEEN r.x AND r.x + r.width AND b.y + b.height / 2 BETWEEN r.y AND r.y + r.height""")
def centre_containment(spark, d):
    found, native = _recognised(spark, d)
    areas = found.select("doc_id", "page", F.col("seq").alias("area"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("width").alias("aw"), F.col("height").alias("ah"))
    return J.centred_in(native, areas).select(*KEYS, "area")


@query(f"""{IT}, v AS (SELECT doc_id, page, x v, count(*) n FROM it WHERE x IS NOT NULL GROUP BY 1, 2, 3),
  s AS (SELECT *, sum(st) OVER (PARTITION BY doc_id, page ORDER BY v) c FROM (SELECT *, CASE WHEN coalesce(v - lag(v) OVER (PARTITION BY doc_id, page ORDER BY v) > 6, true) THEN 1 ELSE 0 END st FROM v)),
  k AS (SELECT doc_id, page, round(avg(v), 3) - 6.0 AS lo FROM s GROUP BY doc_id, page, c), t AS (SELECT *, row_number() OVER w AS track, coalesce(lead(lo) OVER w, 612.0) AS hi FROM k WINDOW w AS (PARTITION BY doc_id, page ORDER BY lo)),
  m AS (SELECT it.doc_id, it.page, it.seq, track, CASE WHEN x + width / 2 >= lo AND x + width / 2 < hi THEN 0 WHEN abs(x - lo) <= 6 THEN 1 WHEN abs(x + width - hi) <= 6 THEN 2 END p,
    CASE WHEN x + width / 2 >= lo AND x + width / 2 < hi THEN 0 WHEN abs(x - lo) <= 6 THEN abs(x - lo) ELSE abs(x + width - hi) END dist FROM it JOIN t ON {on("it", "t")}),
  b AS (SELECT doc_id, page, seq, min_by(track, (p, dist, track)) AS track FROM m WHERE p IS NOT NULL GROUP BY 1, 2, 3)
  SELECT it.doc_id, it.page, it.seq, CAST(b.track AS INT) AS track FROM it LEFT JOIN b ON {on("it", "b")} AND it.seq = b.seq""")
def cell_tracks(spark, d):
    """Tracks of a page reach from each cluster of item starts to the next, the last one to the right edge."""
    own = written(items(spark, d).select(*KEYS, "x", "width"))
    w = Window.partitionBy("doc_id", "page").orderBy("center")
    lo = F.col("center") - 6.0
    tracks = L.cluster_positions(own, "x", 6.0).select("doc_id", "page", F.row_number().over(w).alias("track"), lo.alias("lo"), F.coalesce(F.lead(lo).over(w), F.lit(612.0)).alias("hi"))
    return J.nearest_track(own, tracks).select(*KEYS, "track")


@query(f"""{D.sql("horizontals", "verticals")}, p AS (SELECT *, lead(y) OVER w y2, lead(x1) OVER w n1, lead(x2) OVER w n2 FROM horizontals WINDOW w AS (PARTITION BY doc_id, page ORDER BY y, x1)),
  b AS (SELECT doc_id, page, y AS top, y2 AS bottom, greatest(x1, n1) b1, least(x2, n2) b2 FROM p WHERE y2 - y BETWEEN 10 AND 396 AND greatest(0, least(x2, n2) - greatest(x1, n1)) >= 0.6 * least(x2 - x1, n2 - n1))
  SELECT doc_id, page, top, bottom FROM b WHERE NOT EXISTS (SELECT 1 FROM verticals v WHERE {on("v", "b")} AND vx BETWEEN b1 AND b2 AND v1 < bottom AND v2 > top)""")
def rule_bands(spark, d):
    return J.rule_bands(D.derived(spark, d, "horizontals"), D.derived(spark, d, "verticals"))


_REACH = """ r AS (SELECT doc_id, page, seq, seq AS other FROM nodes UNION SELECT r.doc_id, r.page, r.seq, e.b FROM r JOIN e ON e.doc_id = r.doc_id AND e.page = r.page AND e.a = r.other)"""


@query(f"""{D.sql("horizontals", "verticals").replace("WITH", "WITH RECURSIVE", 1)}, e0 AS (SELECT h.doc_id, h.page, h.rule * 2 a, v.rule * 2 + 1 b FROM horizontals h JOIN verticals v ON {on("h", "v")} AND vx BETWEEN x1 - 3 AND x2 + 3 AND h.y BETWEEN v1 - 3 AND v2 + 3),
  e AS (SELECT doc_id, page, a, b FROM e0 UNION SELECT doc_id, page, b, a FROM e0), nodes AS (SELECT doc_id, page, rule * 2 AS seq FROM horizontals UNION SELECT doc_id, page, rule * 2 + 1 FROM verticals),{_REACH}
  SELECT doc_id, page, CASE WHEN seq % 2 = 0 THEN 'h' ELSE 'v' END AS axis, CAST(floor(seq / 2) AS INT) AS rule, min(other) AS component FROM r GROUP BY doc_id, page, seq""")
def rule_grids(spark, d):
    return J.rule_grids(D.derived(spark, d, "horizontals"), D.derived(spark, d, "verticals"))


_EDGE = "greatest(a.x - (b.x + b.width), b.x - (a.x + a.width)) <= 10 AND greatest(a.y - (b.y + b.height), b.y - (a.y + a.height)) <= 10"


@query(f"""{D.sql("shapes").replace("WITH", "WITH RECURSIVE", 1)}, nodes AS (SELECT * FROM shapes WHERE x IS NOT NULL AND y IS NOT NULL), e AS (SELECT a.doc_id, a.page, a.seq a, b.seq b FROM nodes a JOIN nodes b ON {on("a", "b")} AND a.seq <> b.seq AND {_EDGE}),{_REACH}
  SELECT doc_id, page, seq, min(other) AS component FROM r GROUP BY doc_id, page, seq""")
def figure_components(spark, d):
    own = D.derived(spark, d, "shapes").filter("x IS NOT NULL AND y IS NOT NULL")
    edges = J.pairs(own, J.native_boxes(own), J.box(), J.box(*J.OTHER), 10.0).filter("seq < n_seq").select(*KEYS, "n_seq")
    return J.page_components(own, edges)


@query()
def figure_clusters(spark, d):
    return J.figure_clusters(D.derived(spark, d, "shapes"), items(spark, d).filter("seq % 4 = 1"))


@query(f"""{D.sql("shapes")}, f AS (SELECT doc_id, page, seq AS figure, x fx, y fy, width fw, height * 2 fh FROM shapes) SELECT DISTINCT it.doc_id, it.page, it.seq FROM it JOIN f ON {on("it", "f")}
  WHERE greatest(0, least(x + width, fx + fw) - greatest(x, fx)) * greatest(0, least(y + height, fy + fh) - greatest(y, fy)) >= 0.5 * width * height AND width * height > 0 AND fh >= 3 * height""")
def lines_in_figures(spark, d):
    figures = D.derived(spark, d, "shapes").select("doc_id", "page", F.col("seq").alias("figure"), F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("width").alias("fw"), (F.col("height") * 2).alias("fh"))
    return J.lines_in_figures(items(spark, d), figures).select(*KEYS)


@query(f"""{D.sql("paths")}, c AS (SELECT p.doc_id, p.page, p.path, sum(greatest(0, least(px + pw, x + width) - greatest(px, x)) * greatest(0, least(py + ph, y + height) - greatest(py, y))) o FROM paths p JOIN it ON {on("p", "it")}
    WHERE px <= x + greatest(width, 0) AND px + pw >= x AND py <= y + greatest(height, 0) AND py + ph >= y GROUP BY 1, 2, 3)
  SELECT p.doc_id, p.page, round(sum(greatest(0, pw * ph - coalesce(o, 0))), 3) AS uncovered FROM paths p LEFT JOIN c ON {on("p", "c")} AND p.path = c.path WHERE pw * ph > 0 GROUP BY 1, 2""")
def uncovered_vector_area(spark, d):
    return J.uncovered_area(D.derived(spark, d, "paths"), items(spark, d))


@query("""WITH RECURSIVE n AS (SELECT DISTINCT doc_id node FROM documents WHERE doc_id IS NOT NULL), e0 AS (SELECT a.node a, b.node b FROM n a JOIN n b ON b.node = a.node + 7 WHERE a.node % 5 <> 0),
  e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), r AS (SELECT node, node other FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other) SELECT node, min(other) AS label FROM r GROUP BY node""")
def graph_components(spark, d):
    """Chains of documents whose numbers differ by seven, broken at each multiple of five."""
    nodes = table(spark, d, "documents").filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("node")).distinct()
    later = nodes.select(F.col("node").alias("b"), (F.col("node") - 7).alias("a"))
    return J.components(nodes, nodes.select(F.col("node").alias("a")).filter("a % 5 <> 0").join(later, "a"))


@query("""SELECT doc_id, 1 AS page, doc_id AS seq, CASE WHEN doc_id <> f THEN '1/' || f END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY source, text) f FROM documents WHERE text IS NOT NULL)""")
def image_duplicates(spark, d):
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull())
    images = docs.select(F.col("source").alias("doc_id"), F.lit(1).alias("page"), F.col("doc_id").alias("seq"), F.encode("text", "UTF-8").alias("content"))
    return J.canonical_images(images).select(F.col("seq").alias("doc_id"), "page", "seq", "duplicate_of")


_LAT = "CASE WHEN isnan(parse_latency_seconds) THEN NULL ELSE parse_latency_seconds END"


@query(f"""SELECT provider, count(*) AS runs, round(sum(v), 3) AS total, round(avg(v), 4) AS mean, min(v) AS least, max(v) AS greatest, round(coalesce(stddev_pop(v), 0), 4) AS deviation
  FROM (SELECT DISTINCT eval_id, provider, {_LAT} v FROM qa_eval_results) WHERE v IS NOT NULL GROUP BY provider""")
def latency_summary(spark, d):
    runs = table(spark, d, "qa_eval_results").select("eval_id", "provider", "parse_latency_seconds").distinct()
    return E.latency_summary(runs, ["provider"], "parse_latency_seconds")


@query("""SELECT provider, CAST(sum(total_questions) AS BIGINT) AS questions, round(sum(llm_judge_pass_rate * total_questions) / nullif(sum(total_questions), 0), 4) AS rate
  FROM (SELECT DISTINCT eval_id, provider, total_questions, llm_judge_pass_rate FROM qa_eval_results) WHERE total_questions IS NOT NULL AND llm_judge_pass_rate IS NOT NULL AND NOT isnan(llm_judge_pass_rate) GROUP BY ROLLUP (provider)""")
def qa_rollup(spark, d):
    return E.pass_rates(table(spark, d, "qa_eval_results").select("eval_id", "provider", "total_questions", "llm_judge_pass_rate").distinct(), "provider")


@query(f"""WITH r AS (SELECT DISTINCT eval_id, file, provider, {_LAT} v FROM qa_eval_results WHERE file IS NOT NULL AND provider IS NOT NULL)
  SELECT file, provider, count(*) AS runs, round(avg(v), 9) AS mean FROM (SELECT file, provider, v FROM r UNION ALL SELECT 'TOTAL', provider, v FROM r UNION ALL SELECT file, 'AVG', v FROM r UNION ALL SELECT 'TOTAL', 'AVG', v FROM r) GROUP BY 1, 2""")
def provider_pivot(spark, d):
    """Files by providers with totals on both sides, one row for each cell: no list of providers is needed beforehand."""
    runs = table(spark, d, "qa_eval_results").select("eval_id", "file", "provider", "parse_latency_seconds").distinct()
    return E.provider_cells(runs, "file", "provider", "parse_latency_seconds")


_OUT = "o AS (SELECT DISTINCT doc_id, seq, CASE WHEN seq % 2 = 0 OR doc_id % 3 = 0 THEN concat('late ', CAST(seq AS VARCHAR(20))) END AS error, page % 2 = 1 AS sparse FROM text_items)"


@query(f"""WITH {_OUT} SELECT doc_id, count(*) AS tasks, count(error) AS failed, count(error) = count(*) AND bool_or(error IS NOT NULL AND sparse) AS fatal,
  CASE WHEN count(error) = count(*) AND bool_or(error IS NOT NULL AND sparse) THEN min(CASE WHEN error IS NOT NULL THEN (seq, error) END)[2] END AS message FROM o GROUP BY doc_id""")
def ocr_failure_policy(spark, d):
    outcomes = spark.sql(f"WITH {_OUT.replace('FROM text_items', 'FROM {text_items}')} SELECT * FROM o", text_items=table(spark, d, "text_items"))
    return E.recognition_failures(outcomes)


@query(f"""{D.sql("recognised")} SELECT seq % 2 AS shape, doc_id, page, seq, text, confidence, [x, y, x + width, y + height] AS bbox FROM recognised WHERE confidence > 0.1 AND text IS NOT NULL""")
def ocr_responses(spark, d):
    """Boxes written as the bodies of both response shapes of a recognition service, and read again."""
    found = D.derived(spark, d, "recognised").filter("text IS NOT NULL")
    one = F.struct("text", "confidence", F.array("x", "y", F.col("x") + F.col("width"), F.col("y") + F.col("height")).alias("bbox"))
    body = F.when(F.col("seq") % 2 == 0, F.to_json(F.struct(F.array(one).alias("results")))).otherwise(F.to_json(F.struct(F.array(one).alias("lines"))))
    keyed = found.select(F.struct((F.col("seq") % 2).alias("shape"), *KEYS).alias("id"), body.alias("body"))
    return E.parse_recognition(keyed).select("id.*", "text", "confidence", "bbox")


@query("""WITH t AS (SELECT DISTINCT regexp_replace(regexp_extract(file, '([^/]+)$', 1), '\\.[^.]+$', '') stem FROM qa_pairs)
  SELECT doc_id, t.stem IS NOT NULL AS matched FROM documents d LEFT JOIN t ON regexp_replace(regexp_extract(d.file_name, '([^/]+)$', 1), '\\.[^.]+$', '') = t.stem""")
def ground_truth_match(spark, d):
    return E.match_ground_truth(table(spark, d, "documents").select("doc_id", "file_name"), table(spark, d, "qa_pairs").select("file")).select("doc_id", "matched")


@query(f"""{IT}, p AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY seq) t, row_number() OVER (PARTITION BY doc_id ORDER BY page) n FROM it WHERE text IS NOT NULL GROUP BY 1, 2)
  SELECT doc_id, page, md5(CASE WHEN n > 1 THEN chr(10) || chr(10) ELSE '' END || '--- Page ' || page || ' ---' || chr(10) || t) AS digest FROM p""")
def text_render(spark, d):
    return R.document_texts(items(spark, d)).select("doc_id", "page", F.md5("text").alias("digest"))


@query(f"""{IT} SELECT doc_id, page, seq, text, coalesce(CASE WHEN isnan(confidence) THEN NULL ELSE confidence END, 1.0) AS confidence, x FROM it""")
def json_round_trip(spark, d):
    rows = R.item_json(items(spark, d)).select("doc_id", "page", "seq", F.from_json("json", "struct<text:string,x:double,confidence:double>").alias("j"))
    return rows.select("doc_id", "page", "seq", "j.text", "j.confidence", "j.x")


_M = "(1.0 + seq % 5) AS a, 0.5 * (seq % 3) AS b, 0.25 * (page % 4) AS c, 2.0 + page % 3 AS d"
_HALF, _DET = "(a * a + b * b + c * c + d * d) / 2", "(a * d - b * c)"


@query(f"""{IT}, m AS (SELECT DISTINCT {_M} FROM it), n AS (SELECT CAST(a AS DOUBLE) a, CAST(b AS DOUBLE) b, CAST(c AS DOUBLE) c, CAST(d AS DOUBLE) d FROM m)
  SELECT a, b, c, d, round(sqrt({_HALF} + sqrt(greatest(0, {_HALF} * {_HALF} - {_DET} * {_DET}))), 6) AS scale FROM n""")
def matrix_scales(spark, d):
    m = items(spark, d).selectExpr(*_M.split(", ")).selectExpr(*[f"CAST({c} AS DOUBLE) {c}" for c in "abcd"]).distinct()
    return m.withColumn("scale", F.round(G.matrix_scale(*[F.col(c) for c in "abcd"]), 6))


_SIGNS = {k: "(" + " + ".join(f"CAST(contains(text, '{w}') AS INT)" for w in own) + ")" for k, own in {"json": ('{"', '":', "[{"), "cpp": ("#include", "std::", "int main", "->"), "python": ("def ", "import ", "self.", "print(")}.items()}


_STARRED = r"regexp_replace(text, '([*\\])', '\\\1', 'g')"
_INSIDE = r"regexp_replace({}, '([A-Za-z0-9])_([A-Za-z0-9])', '\1' || chr(2) || '\2', 'g')"
_MARKED = f"replace(replace({_INSIDE.format(_INSIDE.format(_STARRED))}, '_', chr(1)), chr(2), '_')"
_JSON, _CPP, _PYTHON = _SIGNS["json"], _SIGNS["cpp"], _SIGNS["python"]


@query(f"""{IT} SELECT doc_id, page, seq, {_MARKED} AS marked, CASE WHEN {_JSON} >= 2 AND {_JSON} >= {_CPP} AND {_JSON} >= {_PYTHON} THEN 'json' WHEN {_CPP} >= 2 AND {_CPP} >= {_PYTHON} THEN 'cpp'
  WHEN {_PYTHON} >= 2 THEN 'python' ELSE '' END AS lang FROM it WHERE text IS NOT NULL""")
def inline_markdown(spark, d):
    """Escaped underscores are shown as U+0001, as the checking engine has no pattern that looks behind."""
    c = F.col("text")
    marked = F.regexp_replace(T.escape_markdown(c), r"\_", "")
    return items(spark, d).filter(c.isNotNull()).select(*KEYS, marked.alias("marked"), T.code_language(c).alias("lang"))


@query()
def markdown_render(spark, d):
    """Pages of the blocks that classify_blocks makes; a heading has the level of its font size in the document."""
    own = items(spark, d).withColumn("font_size", F.nanvl("font_size", F.lit(None)))
    own = written(own.select("doc_id", "page", "seq", "text", "rotation", "font_name", "font_size"))
    levels = L.heading_map(own).select("doc_id", F.round(F.col("size") * 100).cast("long").alias("k"), F.col("level").cast("int").alias("level"))
    blocks = folds.classify_blocks(own, sized=True).withColumn("k", F.when(F.col("kind") == "heading", F.round(F.col("font_size") * 100).cast("long")))
    c = F.col("text")
    list_ = F.col("kind") == "list"
    marker = F.when(list_ & (T.list_marker(c) == "ordered"), F.regexp_extract(c, T.NUMBERED, 1))
    text = F.when(list_, F.coalesce(T.list_body(c), c)).otherwise(c)
    return R.markdown_pages(blocks.join(levels, ["doc_id", "k"], "left").select("doc_id", "page", "block", "kind", text.alias("text"), "level", marker.alias("marker")))


@query()
def table_render(spark, d):
    """Each page as one table of its rows, those of a single cell too."""
    own = items(spark, d).withColumn("font_size", F.nanvl("font_size", F.lit(None)))
    return R.pipe_table(R.row_cells(L.split_cells(own)), ["doc_id", "page"])
