"""Queries of text, triage and layout operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import text as T
from pagemill.operators import layout as L
from pagemill.operators import triage as R
from pagemill.plans import derived as D
from pagemill.plans import sql as S
from pagemill.sources.tables import EXTENSIONS, document_lines, input_kind, items
from pagemill.runtime import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


IT, LN = f"WITH {S.ITEMS}", f"WITH {S.LINES}"
_t = "coalesce(text, '')"
_BAD = f"(coalesce(has_unicode_map_error, false) OR coalesce({S.letters('text')} >= 10 AND {S.vowels('text')} * 10 < {S.letters('text')}, false))"


def _scopes(source: str) -> str:
    """Pieces of SQL for the detectors on pages and fonts of a table of items: sc has the scopes, ms the misread fonts, gp the pages."""
    plain = f"NOT (coalesce(math, false) OR {S.symbol_font('font_name')})"
    sums = {
        "letters": S.letters(_t), "vowels": S.vowels(_t), "script": S.matches(_t, f"[{T.COMPLEX}]"), "script_odd": S.between(_t, T.COMPLEX, "[!-~]"), "alphabetic": f"length(regexp_replace({_t}, '[^\\p{{L}}]', '', 'g'))",
        "symbols": S.between(f"translate({_t}, 'ªº', '¬¬')", "\\p{L}", f"[{T.SYMBOLS}]"), "controls": f"CASE WHEN {plain} THEN {S.matches(_t, S.CONTROL)} ELSE 0 END", "visible": f"CASE WHEN {plain} THEN {S.visible(_t)} ELSE 0 END",
        "judged": f"CASE WHEN {plain} THEN len({S.judged(_t)}) ELSE 0 END", "malformed": f"CASE WHEN {plain} THEN {S.malformed(S.judged(_t))} ELSE 0 END",
    }
    tests = "(script_odd >= 5 AND script_odd * 1000 >= script * 15) OR (symbols >= 20 AND symbols * 100 >= alphabetic * 3) OR (controls >= 5 AND controls * 50 >= visible + controls) OR (malformed >= 10 AND malformed * 5 >= judged)"
    edges = "[.,;:()\\[\\]{}''\"!?«»“”‘’]+"
    toks = f"list_filter(list_transform(string_split_regex(text, '{S._SPACE}'), lambda t: regexp_replace(t, '^{edges}|{edges}$', '', 'g')), lambda t: length(t) >= 3 AND NOT starts_with(t, 'http') AND NOT regexp_matches(t, '[_@\\\\$/]'))"
    lat = "\\p{Latin}\\p{Greek}\\p{Cyrillic}"
    return f"""ga AS (SELECT doc_id, page, coalesce(font_name, '(none)') font_name, {', '.join(f'{v} {k}' for k, v in sums.items())} FROM {source}),
  gs AS (SELECT doc_id, page, font_name, {', '.join(f'CAST(sum({k}) AS BIGINT) {k}' for k in sums)} FROM ga GROUP BY GROUPING SETS ((doc_id, page), (doc_id, page, font_name))),
  gw AS (SELECT *, max(CASE WHEN font_name IS NULL THEN (letters >= 30 AND vowels * 5 < letters) OR {tests} END) OVER w AS own_page, max(CASE WHEN font_name IS NULL THEN letters END) OVER w AS page_letters FROM gs WINDOW w AS (PARTITION BY doc_id, page)),
  sc AS (SELECT doc_id, page, font_name, {', '.join(sums)}, CASE WHEN font_name IS NULL THEN own_page ELSE NOT own_page AND ((letters >= 30 AND vowels * 5 < letters AND letters >= ceil(page_letters * 15 / 100)) OR {tests}) END AS garbled FROM gw),
  mt AS (SELECT doc_id, page, coalesce(regexp_replace(font_name, '^[^+]*\\+', ''), '(none)') base, unnest({toks}) t FROM {source} WHERE text IS NOT NULL AND {plain}),
  mw AS (SELECT *, lower(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) word FROM mt),
  mm AS (SELECT doc_id, page, base, word, word AS tail, unnest(regexp_extract_all(regexp_replace(t, '([{lat}])', '\\1\\1', 'g'), '[{lat}]([!%*])[{lat}]', 1)) ch FROM mw
    UNION ALL SELECT doc_id, page, base, word, regexp_extract(t, '.\\p{{Ll}}(\\p{{Lu}}\\p{{Ll}}{{1,2}})$', 1), substring(regexp_extract(t, '.\\p{{Ll}}(\\p{{Lu}}\\p{{Ll}}{{1,2}})$', 1), 1, 1) FROM mw WHERE regexp_matches(t, '.\\p{{Ll}}\\p{{Lu}}\\p{{Ll}}{{1,2}}$') AND NOT regexp_matches(t, '[0-9]')),
  ms AS (SELECT DISTINCT doc_id, page, base FROM (SELECT doc_id, page, base, ch FROM mm GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT word) >= 3 AND count(DISTINCT tail) >= 2)),
  gp AS (SELECT doc_id, page, bool_or(garbled) OR (doc_id, page) IN (SELECT (doc_id, page) FROM ms) AS garbled FROM sc GROUP BY doc_id, page)"""


#: Items of which some fonts and pages are made unreadable in every way that the detectors know.
_BROKEN = """broken AS (SELECT * REPLACE (CASE WHEN text IS NULL THEN NULL WHEN doc_id % 11 = 1 THEN regexp_replace(text, '[aeiouAEIOU]', 'x', 'g') WHEN doc_id % 11 = 2 AND seq % 2 = 0 THEN regexp_replace(text, '([a-z])([a-z])', '\\1¤\\2', 'g')
  WHEN doc_id % 11 = 3 THEN concat(text, chr(1), chr(2)) WHEN doc_id % 11 = 4 THEN regexp_replace(text, '([a-z])([a-z])([a-z])', '\\1;\\3Ab\\2', 'g') WHEN doc_id % 11 = 5 THEN regexp_replace(text, 't([a-z])', '!\\1', 'g')
  WHEN doc_id % 11 = 6 THEN regexp_replace(text, '([a-z])([a-z])', 'ب\\1م', 'g') WHEN doc_id % 11 = 7 THEN regexp_replace(text, '([a-z]{3})([a-z])([a-z]{2})( |$)', '\\1K\\3\\4', 'g') ELSE text END AS text,
  CASE WHEN seq % 3 = 0 THEN concat('ABCDEF+', coalesce(font_name, 'Body')) WHEN seq % 17 = 0 THEN 'Wingdings' ELSE font_name END AS font_name, coalesce(math, false) OR seq % 19 = 0 AS math, coalesce(has_unicode_map_error, false) OR doc_id % 11 = 8 AS has_unicode_map_error) FROM it)"""


def _broken(spark, d):
    """The same rows by Spark's functions."""
    t, k, n = F.col("text"), F.col("doc_id") % 11, F.col("seq")
    sub = lambda pattern, new: F.regexp_replace(t, pattern, new)
    text = (
        F.when(k == 1, sub("[aeiouAEIOU]", "x")).when((k == 2) & (n % 2 == 0), sub("([a-z])([a-z])", "$1¤$2")).when(k == 3, F.concat(t, F.lit("\x01\x02"))).when(k == 4, sub("([a-z])([a-z])([a-z])", "$1;$3Ab$2"))
        .when(k == 5, sub("t([a-z])", "!$1")).when(k == 6, sub("([a-z])([a-z])", "ب$1م")).when(k == 7, sub("([a-z]{3})([a-z])([a-z]{2})( |$)", "$1K$3$4")).otherwise(t)
    )
    font = F.when(n % 3 == 0, F.concat(F.lit("ABCDEF+"), F.coalesce("font_name", F.lit("Body")))).when(n % 17 == 0, "Wingdings").otherwise(F.col("font_name"))
    unmapped = F.coalesce("has_unicode_map_error", F.lit(False)) | (k == 8)
    return items(spark, d).withColumns({"text": text, "font_name": font, "math": F.coalesce("math", F.lit(False)) | (n % 19 == 0), "has_unicode_map_error": unmapped})


_SUMS = f"""tp AS (SELECT doc_id, page, CAST(coalesce(sum(CASE WHEN NOT {_BAD} THEN strlen(text) END), 0) AS BIGINT) text_length, round(coalesce(sum(CASE WHEN NOT {_BAD} THEN width * height END), 0) / (612.0 * 792.0), 4) coverage,
  sum(CASE WHEN coalesce(has_unicode_map_error, false) THEN {S.visible(_t)} ELSE 0 END) um, sum({S.visible(_t)}) vi FROM src GROUP BY doc_id, page),
  im AS (SELECT doc_id, page, count_if(NOT fp) image_blocks, round(least(coalesce(sum(CASE WHEN NOT fp THEN sh END), 0), 1), 4) image_coverage, round(least(coalesce(max(CASE WHEN NOT fp THEN sh END), 0), 1), 4) largest_coverage, bool_or(fp) full_page
    FROM (SELECT *, width > 0.9 * 612 AND height > 0.9 * 792 fp, width * height / (612.0 * 792.0) sh FROM images WHERE width >= 25 AND height >= 25) GROUP BY 1, 2)"""
_ALL = f"""{D.sql("images", "facts", "paths")}, src AS (SELECT * FROM it), {_scopes("src")}, {_SUMS},
  j AS (SELECT tp.*, coalesce(gp.garbled, false) OR (um >= 30 AND um * 100 >= vi * 15) gb, coalesce(CAST(image_blocks AS INT), 0) image_blocks, coalesce(image_coverage, 0.0) image_coverage, coalesce(largest_coverage, 0.0) largest_coverage, coalesce(full_page, false) full_page,
    annotation_text, invisible_share, hidden_share FROM tp LEFT JOIN gp USING (doc_id, page) LEFT JOIN im USING (doc_id, page) LEFT JOIN facts USING (doc_id, page)),
  r AS (SELECT *, list_filter([CASE WHEN text_length < 20 THEN CASE WHEN full_page THEN 'scanned' ELSE 'no-text' END WHEN text_length < 2000 AND coverage < 0.15 AND (full_page OR text_length < 500) THEN 'sparse-text' END,
    CASE WHEN text_length < 20 AND annotation_text THEN 'annotation-text' END, CASE WHEN image_blocks > 0 THEN 'embedded-images' END, CASE WHEN gb THEN 'garbled' END,
    CASE WHEN full_page AND text_length >= 20 AND (invisible_share >= 0.9 OR hidden_share >= 0.9) THEN 'invisible-text-layer' END], lambda x: x IS NOT NULL) rs FROM j),
  pc AS (SELECT p.doc_id, p.page, p.path, sum(greatest(0, least(px + pw, x + width) - greatest(px, x)) * greatest(0, least(py + ph, y + height) - greatest(py, y))) o FROM paths p JOIN it ON p.doc_id = it.doc_id AND p.page = it.page
    WHERE px <= x + greatest(width, 0) AND px + pw >= x AND py <= y + greatest(height, 0) AND py + ph >= y GROUP BY 1, 2, 3),
  ua AS (SELECT p.doc_id, p.page, round(sum(greatest(0, pw * ph - coalesce(o, 0))), 3) u FROM paths p LEFT JOIN pc USING (doc_id, page, path) WHERE pw * ph > 0 GROUP BY 1, 2),
  z AS (SELECT r.*, CASE WHEN len(rs) = 0 THEN coalesce(u, 0.0) END AS uncovered FROM r LEFT JOIN ua USING (doc_id, page)),
  verdict AS (SELECT doc_id, page, text_length, coverage, image_blocks, image_coverage, largest_coverage, full_page, uncovered, CASE WHEN uncovered >= 400 THEN 'vector-text' ELSE array_to_string(rs, ',') END AS reasons FROM z)"""


def _triage(spark, d):
    return R.page_complexity(items(spark, d), *[D.derived(spark, d, n) for n in ("images", "facts", "paths")])


@query(f"{_ALL} SELECT *, reasons <> '' AS needs_ocr FROM verdict")
def page_triage(spark, d):
    return _triage(spark, d)


@query(f"{_ALL} SELECT reason, count(*) AS pages FROM (SELECT unnest(string_split(reasons, ',')) reason FROM verdict) GROUP BY reason")
def triage_verdicts(spark, d):
    return _triage(spark, d).select(F.explode(F.split("reasons", ",")).alias("reason")).groupBy("reason").agg(F.count("*").alias("pages"))


@query(f"""{D.sql("images")}, src AS (SELECT * FROM it), {_scopes("src")}, {_SUMS}, fc AS (SELECT doc_id, page, round(least(sum(greatest(width, 0) * greatest(height, 0)) / (612.0 * 792.0), 1), 4) fg, count(*) n FROM images GROUP BY 1, 2),
  tb AS (SELECT doc_id, page, CAST(count(*) AS INT) tables FROM it WHERE seq % 12 = 5 GROUP BY 1, 2), cl AS (SELECT doc_id, page, CAST(1 + (doc_id + page) % 3 AS INT) AS columns FROM it GROUP BY 1, 2)
  SELECT tp.doc_id, tp.page, text_length, coverage, array_to_string(list_filter([CASE WHEN text_length < 20 THEN CASE WHEN coalesce(full_page, false) THEN 'scanned' ELSE 'no-text' END WHEN text_length < 2000 AND coverage < 0.15 THEN 'sparse-text' END,
    CASE WHEN coalesce(image_blocks, 0) > 0 THEN 'embedded-images' END, CASE WHEN coalesce(gp.garbled, false) OR (um >= 30 AND um * 100 >= vi * 15) THEN 'garbled' END], lambda x: x IS NOT NULL), ',') AS reasons,
  array_to_string(list_filter([CASE WHEN columns >= 2 THEN 'multi-column' END, CASE WHEN coalesce(tables, 0) > 0 THEN 'table-likely' END, CASE WHEN coalesce(fg, 0) >= 0.2 THEN 'dense-graphics' END], lambda x: x IS NOT NULL), ',') AS layout_reasons, coalesce(CAST(n AS INT), 0) AS figures
  FROM tp LEFT JOIN gp USING (doc_id, page) LEFT JOIN im USING (doc_id, page) LEFT JOIN fc USING (doc_id, page) LEFT JOIN tb USING (doc_id, page) LEFT JOIN cl USING (doc_id, page)""")
def native_triage(spark, d):
    own = items(spark, d)
    tables = own.filter("seq % 12 = 5").groupBy("doc_id", "page").agg(F.count("*").cast("int").alias("tables"))
    columns = own.select("doc_id", "page").distinct().withColumn("columns", (1 + (F.col("doc_id") + F.col("page")) % 3).cast("int"))
    return R.native_page_complexity(own, D.derived(spark, d, "images"), tables, columns)


@query(f"""{IT}, src AS (SELECT * FROM it), {_SUMS.split("im AS (")[0].rstrip(", " + chr(10))} SELECT doc_id, page, text_length < 20 OR coverage < 0.15 AS sparse FROM tp""")
def sparse_pages(spark, d):
    return R.sparse_pages(items(spark, d))


@query(f"{IT}, {_BROKEN}, {_scopes('broken')} SELECT * FROM sc")
def garbled_by_font(spark, d):
    return R.garbled_scopes(_broken(spark, d))


@query(f"{IT}, {_BROKEN}, {_scopes('broken')} SELECT * FROM ms")
def misread_fonts(spark, d):
    return R.misread_fonts(_broken(spark, d))


@query(f"""{IT}, {_BROKEN}, {_scopes('broken')}, b2 AS (SELECT *, coalesce(regexp_replace(font_name, '^[^+]*\\+', ''), '(none)') base FROM broken) SELECT b2.doc_id, b2.page, b2.seq FROM b2
  WHERE NOT EXISTS (SELECT 1 FROM sc WHERE garbled AND sc.doc_id = b2.doc_id AND sc.page = b2.page AND (sc.font_name IS NULL OR sc.font_name = coalesce(b2.font_name, '(none)')))
  AND NOT EXISTS (SELECT 1 FROM ms WHERE ms.doc_id = b2.doc_id AND ms.page = b2.page AND ms.base = b2.base)""")
def garbled_dropped(spark, d):
    return R.drop_garbled(_broken(spark, d)).select("doc_id", "page", "seq")


_GLYPHS = "gl AS (SELECT doc_id, page, seq, i, substr(text, i, 1) AS text, CASE WHEN (doc_id + page) % 3 = 0 THEN CASE WHEN i % 9 = 0 THEN 3 ELSE 0 END WHEN (doc_id + page) % 3 = 1 THEN CASE WHEN seq % 2 = 0 THEN 3 ELSE 0 END ELSE 0 END AS mode FROM (SELECT *, unnest(range(1, length(text) + 1)) i FROM it WHERE text IS NOT NULL))"
_SOLID = "sh AS (SELECT doc_id, page, count_if(mode = 3) h, count(*) n FROM gl WHERE NOT regexp_matches(text, '^[\\p{Cc}\\s]*$') GROUP BY 1, 2)"


def _glyphs(spark, d):
    own = items(spark, d).filter("text <> ''").select("doc_id", "page", "seq", F.posexplode(F.split("text", "")).alias("i", "text")).withColumn("i", F.col("i") + 1)
    k = (F.col("doc_id") + F.col("page")) % 3
    return own.withColumn("mode", F.when((k == 0) & (F.col("i") % 9 == 0), 3).when((k == 1) & (F.col("seq") % 2 == 0), 3).otherwise(0))


@query(f"{IT}, {_GLYPHS}, {_SOLID} SELECT doc_id, page, round(h / n, 4) AS invisible_share, h > 0 AND h / n < 0.3 AS skip FROM sh")
def invisible_shares(spark, d):
    return R.invisible_shares(_glyphs(spark, d))


@query(f"{IT}, {_GLYPHS}, {_SOLID} SELECT doc_id, page, seq, count(*) AS glyphs FROM gl WHERE NOT (mode = 3 AND (doc_id, page) IN (SELECT (doc_id, page) FROM sh WHERE h > 0 AND h / n < 0.3)) GROUP BY 1, 2, 3")
def invisible_dropped(spark, d):
    return R.drop_invisible(_glyphs(spark, d)).groupBy("doc_id", "page", "seq").agg(F.count("*").alias("glyphs"))


_OBJECTS = "ob AS (SELECT doc_id, page, seq, CASE WHEN seq % 8 = 6 AND doc_id % 2 = 0 THEN 'image' ELSE 'text' END AS kind, CASE WHEN seq % 8 = 6 THEN 590.0 ELSE width END AS width, CASE WHEN seq % 8 = 6 THEN 760.0 ELSE height END AS height FROM it)"


@query(f"{IT}, {_OBJECTS}, f AS (SELECT *, min(CASE WHEN kind = 'image' AND width > 0.9 * 612 AND height > 0.9 * 792 THEN seq END) OVER (PARTITION BY doc_id, page) fs FROM ob) SELECT doc_id, page, round(coalesce(count_if(seq < coalesce(fs, -1)), 0) / count(*), 4) AS hidden_share FROM f WHERE kind = 'text' GROUP BY 1, 2")
def hidden_shares(spark, d):
    objects = spark.sql(f"{IT.replace('FROM text_items', 'FROM {text_items}')}, {_OBJECTS} SELECT * FROM ob", text_items=table(spark, d, "text_items"))
    return R.hidden_shares(objects)


@query(f"""{IT} SELECT font_name, CAST(sum({S.matches(_t, S.CONTROL)} + {S.matches(_t, S.PRIVATE)}) AS BIGINT) odd, CAST(sum(length({_t})) AS BIGINT) chars,
  sum({S.matches(_t, S.CONTROL)} + {S.matches(_t, S.PRIVATE)}) >= 5 AND sum({S.matches(_t, S.CONTROL)} + {S.matches(_t, S.PRIVATE)}) >= 0.3 * sum(length({_t})) AS garbage FROM it GROUP BY font_name""")
def garbage_fonts(spark, d):
    return R.garbage_fonts(items(spark, d))


@query(f"SELECT lang, count(*) n, CAST(sum({S.letters('text')}) AS BIGINT) letters, CAST(sum({S.vowels('text')}) AS BIGINT) vowels, CAST(sum(strlen(text)) AS BIGINT) bytes FROM documents WHERE text IS NOT NULL GROUP BY lang")
def letters_by_language(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").filter(t.isNotNull()).groupBy("lang").agg(F.count("*").alias("n"), F.sum(T.letter_count(t)).alias("letters"), F.sum(T.vowel_count(t)).alias("vowels"), F.sum(F.octet_length(t)).alias("bytes"))


@query(rf"SELECT doc_id, {S.matches('text', S.CONTROL)} controls, {S.matches('text', S.PRIVATE)} private_use, {S.matches('text', '[' + chr(92) + 'x{0300}-' + chr(92) + 'x{036F}]')} combining, {S.matches('text', S.RTL)} rtl FROM documents WHERE text IS NOT NULL")
def code_point_classes(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").filter(t.isNotNull()).select("doc_id", T.control_count(t).alias("controls"), T.private_use_count(t).alias("private_use"), T.combining_count(t).alias("combining"), T.rtl_count(t).alias("rtl"))


@query(f"{LN} SELECT {S.norm('line')} AS norm, count(DISTINCT doc_id) AS docs FROM ln WHERE {S.norm('line')} <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2")
def repeated_lines(spark, d):
    lines = document_lines(spark, d).select("doc_id", T.normalize_for_repetition(F.col("line")).alias("norm")).filter("norm <> ''")
    return lines.groupBy("norm").agg(F.countDistinct("doc_id").alias("docs")).filter("docs >= 2")


@query(f"{IT} SELECT doc_id, page, seq FROM it WHERE {S.chrome('text')}")
def chrome_lines(spark, d):
    return items(spark, d).filter(T.is_chrome(F.col("text"))).select("doc_id", "page", "seq")


@query(f"""{IT} SELECT doc_id, page, seq, CASE WHEN regexp_matches(text, '\\p{{L}}-$') THEN 'soft' WHEN regexp_matches(text, '-\\s*$') THEN 'open' ELSE 'none' END AS hyphen,
  regexp_matches(text, '[.!?:]["”’)\\]]*\\s*$') AS ends FROM it WHERE text IS NOT NULL""")
def line_ends(spark, d):
    return items(spark, d).filter("text IS NOT NULL").select("doc_id", "page", "seq", T.hyphen_kind(F.col("text")).alias("hyphen"), T.ends_sentence(F.col("text")).alias("ends"))


@query(f"""{IT}, a AS (SELECT doc_id, page, seq, regexp_replace(text, '\\s+$', '') l, regexp_replace(lead(text) OVER (PARTITION BY doc_id, page ORDER BY seq), '^\\s+', '') r FROM it WHERE text IS NOT NULL)
  SELECT doc_id, page, seq, CASE WHEN regexp_matches(l, '\\p{{L}}-$') AND regexp_matches(r, '^\\p{{Ll}}') THEN regexp_replace(l, '-$', '') || r WHEN regexp_matches(l, '-$') THEN l || r ELSE l || ' ' || r END AS joined FROM a WHERE r IS NOT NULL""")
def dehyphenated_pairs(spark, d):
    from pyspark.sql import Window

    lines = items(spark, d).filter("text IS NOT NULL").withColumn("r", F.lead("text").over(Window.partitionBy("doc_id", "page").orderBy("seq"))).filter("r IS NOT NULL")
    return lines.select("doc_id", "page", "seq", T.dehyphenate_join(F.col("text"), F.col("r")).alias("joined"))


def _sql_line_shapes(source: str, column: str) -> str:
    bullet, numbered = r"^\s*([•◦▪‣∙·*–-])\s+(\S.*)$", r"^\s*([0-9]{1,3}[.)])\s+(\S.*)$"
    toc = r"^(.*[^0-9\s].*?)[\s.]*\s([0-9]{1,4})$"
    c = column
    return f"""SELECT {c} AS line, CASE WHEN regexp_matches({c}, '{bullet}') THEN 'bullet' WHEN regexp_matches({c}, '{numbered}') THEN 'ordered' END AS marker,
      CASE WHEN regexp_matches({c}, '{bullet}') THEN regexp_extract({c}, '{bullet}', 2) WHEN regexp_matches({c}, '{numbered}') THEN regexp_extract({c}, '{numbered}', 2) END AS body,
      regexp_extract({c}, '{T.SECTION}', 1) AS section, regexp_matches({c}, '{T.CAPTION}') AS caption,
      CASE WHEN regexp_matches({c}, '{toc}') AND length(regexp_replace(regexp_extract({c}, '{toc}', 1), '[^\\p{{L}}]', '', 'g')) >= 8 THEN CAST(regexp_extract({c}, '{toc}', 2) AS INTEGER) END AS toc_page FROM {source}"""


def _shapes(df, column):
    c = F.col(column)
    return df.select(c.alias("line"), T.list_marker(c).alias("marker"), T.list_body(c).alias("body"), T.section_number(c).alias("section"), T.is_caption(c).alias("caption"), T.toc_page(c).alias("toc_page"))


_LINES = "l AS (SELECT DISTINCT unnest(string_split_regex(text, '\r\n|\r|\n')) AS line FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {_LINES} " + _sql_line_shapes("l", "line"))
def document_line_shapes(spark, d):
    """Every line of the documents, of any length and with any line end."""
    return _shapes(document_lines(spark, d, r"\r\n|\r|\n").select("line").distinct(), "line")


@query(f"""{IT} SELECT doc_id, page, seq, CASE WHEN regexp_matches(core, '^[0-9,.% +*/-]*[0-9][0-9,.% +*/-]*$|^N/A$|^Z$|^-$') THEN CASE WHEN o LIKE '(%' AND o LIKE '%)' THEN '(' || core || ')' ELSE core END ELSE s END AS cleaned,
  CASE WHEN regexp_matches(s, '^[-+(]?[$€£]?[0-9][0-9.,]*%?\\)?$') THEN 'number' WHEN regexp_matches(s, '^(p|pp|page|S)\\.? ?[0-9]+$') THEN 'page-ref' WHEN regexp_matches(s, '^[•◦▪‣∙·*–-]$') THEN 'bullet'
    WHEN regexp_matches(s, '^\\([0-9]+(\\.[0-9]+)*\\)$') THEN 'equation' WHEN regexp_matches(s, ':$') THEN 'label' ELSE 'text' END AS shape,
  CASE WHEN regexp_matches(s, '^[-_=*~─━—–.•]+$') THEN CASE WHEN length(s) >= 3 THEN 'rule' ELSE 'drop' END END AS divider
  FROM (SELECT doc_id, page, seq, cell, trim(cell, ' ') s, regexp_replace(regexp_replace(trim(cell, ' '), '^[|\\[\\]{{}}\\s]+', ''), '[|\\[\\]{{}}\\s]+$', '') o,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(cell, ' '), '^[|\\[\\]{{}}\\s]+', ''), '[|\\[\\]{{}}\\s]+$', ''), '^[|\\[\\](){{}}\\s]+', ''), '[|\\[\\](){{}}\\s]+$', '') core FROM (SELECT doc_id, page, seq, text AS cell FROM it WHERE text IS NOT NULL)) q""")
def cell_cleanup(spark, d):
    c = F.col("text")
    return items(spark, d).filter(c.isNotNull()).select("doc_id", "page", "seq", T.clean_recognised(c).alias("cleaned"), T.value_shape(c).alias("shape"), T.divider_kind(c).alias("divider"))


@query(r"SELECT doc_id, length(regexp_replace(regexp_replace(text, '```[a-z]*|-----', '', 'g'), '[\s\x{000B}]', '', 'g')) AS content_chars FROM documents WHERE text IS NOT NULL")
def content_lengths(spark, d):
    return table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", T.content_length(F.col("text")).alias("content_chars"))


@query(f"""{IT} SELECT font_name, font_weight, font_flags, count(*) n, coalesce(font_weight, 0) >= 600 OR (coalesce(font_flags, 0) & 262144) <> 0 OR regexp_matches(lower(coalesce(font_name, '')), 'bold|black|heavy') AS bold,
  (coalesce(font_flags, 0) & 64) <> 0 OR regexp_matches(lower(coalesce(font_name, '')), 'italic|oblique') AS italic, (coalesce(font_flags, 0) & 1) <> 0 OR regexp_matches(lower(coalesce(font_name, '')), 'mono|courier|consol') AS mono,
  regexp_matches(lower(coalesce(font_name, '')), 'symbol|wingding|dingbat|cmsy|cmmi|cmex') AS symbol, regexp_matches(coalesce(font_name, ''), '^[A-Z]{{6}}\\+') AS subset FROM it GROUP BY font_name, font_weight, font_flags""")
def font_predicates(spark, d):
    counted = items(spark, d).groupBy("font_name", "font_weight", "font_flags").agg(F.count("*").alias("n"))
    return counted.select("*", T.font_style(F.col("font_name"), F.col("font_weight"), F.col("font_flags")).alias("s")).select("font_name", "font_weight", "font_flags", "n", "s.bold", "s.italic", "s.mono", "s.symbol", "s.subset")


_SPEC = "CASE doc_id % 7 WHEN 0 THEN concat(CAST(page_count + 1 AS VARCHAR(9)), '-2') WHEN 1 THEN 'x' WHEN 2 THEN '1-3000000000' WHEN 3 THEN concat(' 1 , ', CAST(page_count AS VARCHAR(9)), ' - ', CAST(page_count + 2 AS VARCHAR(9))) ELSE concat('3,1-', CAST(page_count AS VARCHAR(9)), ',2') END"


@query(f"""WITH s AS (SELECT doc_id, page_count n, {_SPEC} AS spec FROM documents WHERE page_count >= 1)
  SELECT doc_id, spec, CASE WHEN doc_id % 7 IN (1, 2) THEN NULL WHEN doc_id % 7 = 0 THEN CASE WHEN n + 1 <= 2 THEN range(n + 1, 3) END WHEN doc_id % 7 = 3 THEN list_sort(list_distinct(list_concat([1::BIGINT], range(n, n + 3))))
    ELSE list_sort(list_distinct(list_concat([3::BIGINT, 2::BIGINT], range(1, n + 1)))) END AS pages FROM s""")
def page_selection(spark, d):
    specs = table(spark, d, "documents").filter("page_count >= 1").selectExpr("doc_id", f"{_SPEC} AS spec")
    return L.target_pages(specs)


@query(f"{IT}, p AS (SELECT DISTINCT doc_id, page FROM it) SELECT doc_id, page FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) r FROM p) WHERE r <= 3")
def page_cap(spark, d):
    return L.cap_pages(items(spark, d).select("doc_id", "page").distinct(), 3)


@query(f"{IT} SELECT doc_id, page, seq FROM it WHERE x >= 61.2 AND x + width <= 612 * 0.9 AND y >= 79.2 AND y + height <= 792 * 0.9")
def crop_filter(spark, d):
    return L.crop(items(spark, d), 0.1, 0.1, 0.1, 0.1).select("doc_id", "page", "seq")


@query(f"{D.sql('it2')} SELECT doc_id, page, seq FROM it2 WHERE abs(coalesce(rotation, 0) - round(coalesce(rotation, 0) / 90) * 90) <= 2")
def diagonal_filter(spark, d):
    return L.drop_diagonal(D.derived(spark, d, "it2")).select("doc_id", "page", "seq")


@query(f"""{D.sql('it2')}, p AS (SELECT *, ((rotation % 360) + 360) % 360 pm FROM it2) SELECT doc_id, page, seq, round(CASE WHEN abs(pm - round(pm / 90) * 90) <= 2 THEN (round(pm / 90) * 90) % 360 ELSE pm END, 6) AS canonical FROM p""")
def rotations(spark, d):
    return D.derived(spark, d, "it2").select("doc_id", "page", "seq", F.round(G.canonical_rotation(F.col("rotation")), 6).alias("canonical"))


_BODY = f"""{IT}, w AS (SELECT doc_id, CAST(round(font_size * 100) AS BIGINT) k, sum(greatest(length(text), 1)) w FROM it WHERE font_size IS NOT NULL AND NOT isnan(font_size) AND text IS NOT NULL GROUP BY 1, 2),
  m AS (SELECT *, max(w) OVER (PARTITION BY doc_id) mw FROM w), body AS (SELECT doc_id, max(k) / 100 AS body_size FROM m WHERE w >= floor(mw * 0.5) GROUP BY doc_id)"""


def _sized(spark, d):
    return items(spark, d).withColumn("font_size", F.nanvl("font_size", F.lit(None)))


@query(f"{_BODY} SELECT * FROM body")
def body_sizes(spark, d):
    return L.body_size(_sized(spark, d))


@query(f"""{_BODY}, c AS (SELECT it.*, lower({S.collapse('text')}) nt FROM it JOIN body USING (doc_id) WHERE coalesce(rotation, 0) = 0 AND font_size > body_size + 0.5 AND NOT isnan(font_size) AND NOT regexp_matches(text, '{T.CAPTION}')),
  s AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, nt) times FROM c) WHERE times < 3),
  z AS (SELECT doc_id, CAST(round(font_size * 100) AS BIGINT) k, sum(length(regexp_replace(text, '\\s', '', 'g'))) ch, sum(length(text)) le, count(*) n, sum(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))) al FROM s GROUP BY 1, 2)
  SELECT * FROM (SELECT doc_id, k / 100 AS size, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS INTEGER) AS level FROM z WHERE ch >= 10 AND le >= 8 * n AND le <= 200 * n AND al * 2 >= ch) WHERE level <= 6""")
def heading_levels(spark, d):
    return L.heading_map(_sized(spark, d))


_CHROME = f"""{IT}, b AS (SELECT *, {S.norm('text')} norm FROM (SELECT *, 'h' band FROM it WHERE y <= 0.12 * 792 UNION ALL SELECT *, 'f' FROM it WHERE y + height >= 0.88 * 792) WHERE text IS NOT NULL),
  t AS (SELECT doc_id, count(DISTINCT page) total FROM it GROUP BY doc_id HAVING count(DISTINCT page) >= 2),
  k AS (SELECT doc_id, band, norm, count(DISTINCT page) pages, bool_or({S.chrome('text')}) pat FROM b GROUP BY 1, 2, 3),
  u AS (SELECT *, sum(CASE WHEN pat THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, band) plain FROM k JOIN t USING (doc_id) WHERE pages >= 2 AND pages * 2 >= total AND norm <> ''),
  keys AS (SELECT doc_id, band, norm, pages FROM u WHERE plain <= 3 OR pat)"""


@query(f"{_CHROME} SELECT * FROM keys")
def chrome_set(spark, d):
    return L.chrome_keys(items(spark, d))


@query(f"{_CHROME} SELECT doc_id, page, seq FROM it WHERE NOT EXISTS (SELECT 1 FROM b JOIN keys ON b.doc_id = keys.doc_id AND b.band = keys.band AND b.norm = keys.norm WHERE b.doc_id = it.doc_id AND b.page = it.page AND b.seq = it.seq)")
def chrome_strip(spark, d):
    return L.strip_chrome(items(spark, d)).select("doc_id", "page", "seq")


@query(f"""{IT}, f AS (SELECT *, coalesce({S.chrome('text')} AND length(text) <= 200, false) pat, y + height bot FROM it),
  n AS (SELECT *, min(CASE WHEN NOT pat THEN y END) OVER (PARTITION BY doc_id, page ORDER BY y, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) nb,
  max(CASE WHEN NOT pat THEN bot END) OVER (PARTITION BY doc_id, page ORDER BY y, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) lb FROM f)
  SELECT doc_id, page, seq FROM n WHERE pat AND ((bot <= 0.15 * 792 AND coalesce(nb - bot >= height, true)) OR (y >= 0.85 * 792 AND coalesce(y - lb >= height, true)))""")
def single_page_chrome(spark, d):
    return L.single_page_chrome(items(spark, d)).select("doc_id", "page", "seq")


@query(f"""{IT}, f AS (SELECT *, coalesce(CASE WHEN isnan(font_size) THEN NULL ELSE font_size END, height) sz, coalesce(font_weight >= 600, false) bo, y + height bot FROM it),
  l AS (SELECT *, lag(seq) OVER w ps, lag(sz) OVER w psz, lag(bo) OVER w pb, lag(x) OVER w px, lag(bot) OVER w pbot, lag(height) OVER w ph FROM f WINDOW w AS (PARTITION BY doc_id, page ORDER BY seq)),
  k AS (SELECT *, CASE WHEN coalesce(ps IS NULL OR abs(sz - psz) > 0.5 OR bo <> pb OR x - px > 6 OR y - pbot > 1.5 * greatest(height, ph), false) THEN 1 ELSE 0 END br FROM l)
  SELECT doc_id, page, seq, CAST(sum(br) OVER (PARTITION BY doc_id, page ORDER BY seq) AS BIGINT) AS paragraph FROM k""")
def paragraph_islands(spark, d):
    return L.paragraph_ids(_sized(spark, d)).select("doc_id", "page", "seq", "paragraph")


@query(f"""{IT}, r AS (SELECT *, CAST(round(y) AS INTEGER) row_y, coalesce(CASE WHEN isnan(font_size) THEN NULL ELSE font_size END, height) sz FROM it),
  l AS (SELECT *, CASE WHEN coalesce(x - lag(x + width) OVER w > sz, lag(seq) OVER w IS NULL, false) THEN 1 ELSE 0 END st FROM r WINDOW w AS (PARTITION BY doc_id, page, row_y ORDER BY x, seq))
  SELECT doc_id, page, seq, CAST(sum(st) OVER (PARTITION BY doc_id, page, row_y ORDER BY x, seq) AS BIGINT) AS cell FROM l""")
def cell_split(spark, d):
    return L.split_cells(_sized(spark, d)).select("doc_id", "page", "seq", "cell")


@query(f"""{IT}, v AS (SELECT doc_id, page, x v, count(*) n FROM it WHERE x IS NOT NULL GROUP BY 1, 2, 3),
  s AS (SELECT *, sum(st) OVER (PARTITION BY doc_id, page ORDER BY v) c FROM (SELECT *, CASE WHEN coalesce(v - lag(v) OVER (PARTITION BY doc_id, page ORDER BY v) > 6, true) THEN 1 ELSE 0 END st FROM v))
  SELECT doc_id, page, round(avg(v), 3) AS center, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY doc_id, page, c""")
def track_clusters(spark, d):
    return L.cluster_positions(items(spark, d), "x", 6.0)


@query(f"""{IT}, g AS (SELECT *, y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y, seq) gap,
  (CASE WHEN abs(pm - round(pm / 90) * 90) <= 2 THEN (round(pm / 90) * 90) % 360 ELSE pm END) <> 0 turned FROM (SELECT *, ((coalesce(rotation, 0) % 360) + 360) % 360 pm FROM it))
  SELECT doc_id, page, count(*) AS lines, round(median(height), 3) AS median_height, round(CASE WHEN count(*) >= 3 THEN coalesce(stddev_pop(gap) / nullif(avg(gap), 0), 0) ELSE 0 END, 4) AS spacing_cv,
  round(avg(CASE WHEN turned THEN 1.0 ELSE 0.0 END), 4) AS turned_share FROM g GROUP BY doc_id, page""")
def page_line_stats(spark, d):
    return L.page_line_stats(items(spark, d))


@query(f"""{IT}, b AS (SELECT doc_id, page, unnest(range(CAST(floor(x / 2) AS BIGINT), CAST(floor((x + width) / 2) AS BIGINT) + 1)) bucket, length(text) n FROM it WHERE width > 0 AND text IS NOT NULL)
  SELECT doc_id, page, bucket, CAST(sum(n) AS BIGINT) AS weight FROM b GROUP BY 1, 2, 3""")
def axis_density(spark, d):
    return L.density(items(spark, d))


def _sql_mode(column: str, name: str) -> str:
    return f"(SELECT doc_id, page, max_by({column}, (w, {column})) AS {name} FROM (SELECT doc_id, page, {column}, sum(length(text)) w FROM i2 WHERE {column} IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)"


@query(f"""{IT}, i2 AS (SELECT * REPLACE (CASE WHEN isnan(font_size) THEN NULL ELSE font_size END AS font_size) FROM it),
  b AS (SELECT doc_id, page, 2 * sum(CASE WHEN font_weight >= 600 THEN length(text) ELSE 0 END) > sum(length(text)) AS all_bold FROM i2 WHERE text IS NOT NULL GROUP BY 1, 2)
  SELECT * FROM b LEFT JOIN {_sql_mode('font_size', 'dominant_size')} USING (doc_id, page) LEFT JOIN {_sql_mode('font_name', 'dominant_font')} USING (doc_id, page)""")
def line_modes(spark, d):
    return L.font_modes(_sized(spark, d))


_TOC_SQL = r"""l AS (SELECT *, regexp_matches(text, '^(.*[^0-9\s].*?)[\s.]*\s([0-9]{1,4})$') AND length(regexp_replace(regexp_extract(text, '^(.*[^0-9\s].*?)[\s.]*\s([0-9]{1,4})$', 1), '[^\p{L}]', '', 'g')) >= 8 ar,
    trim(text, ' ') tt FROM src WHERE text IS NOT NULL),
  e AS (SELECT *, CASE WHEN ar THEN CAST(regexp_extract(text, '^(.*[^0-9\s].*?)[\s.]*\s([0-9]{1,4})$', 2) AS INTEGER) END tgt FROM l WHERE ar OR (regexp_matches(tt, '^(.*?)[\s.]*\s[\s.]*[ivxlcdmIVXLCDM]{2,6}$')
    AND length(regexp_replace(regexp_extract(tt, '^(.*?)[\s.]*\s[\s.]*[ivxlcdmIVXLCDM]{2,6}$', 1), '[^\p{L}]', '', 'g')) >= 5)),
  b AS (SELECT *, last_value(tgt IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pt FROM e),
  f AS (SELECT doc_id, page, count(*) AS entries, count(tgt) AS arabic, avg(CASE WHEN tgt >= pt THEN 1.0 WHEN tgt < pt THEN 0.0 END) AS share FROM b GROUP BY 1, 2)"""
_TOC_LINES = "src AS (SELECT doc_id, page, seq, CASE WHEN doc_id % 2 = 0 AND seq % 9 = 4 THEN concat(text, ' ... xiv') WHEN doc_id % 2 = 0 THEN concat(text, ' .... ', CAST(CASE WHEN seq % 6 = 0 THEN 3 ELSE seq + 5 END AS VARCHAR(9))) ELSE text END AS text FROM it)"


@query(f"{IT}, {_TOC_LINES}, {_TOC_SQL} SELECT doc_id, page, entries, round(share, 4) AS forward_share FROM f WHERE entries >= 4 AND arabic >= 3 AND share >= 0.7")
def toc_pages(spark, d):
    """Over items that have page numbers put behind them in every second document, as the data have no contents."""
    source = spark.sql(f"{IT.replace('FROM text_items', 'FROM {text_items}')}, {_TOC_LINES} SELECT * FROM src", text_items=table(spark, d, "text_items"))
    return L.toc_pages(source)


@query(f"{IT} SELECT doc_id, page, seq, round(greatest(0, x - min(x) OVER (PARTITION BY doc_id, page)), 4) AS indent FROM it")
def leaf_indents(spark, d):
    return L.relative_indents(items(spark, d)).select("doc_id", "page", "seq", F.round("indent", 4).alias("indent"))


_ENDINGS = [e for own in EXTENSIONS.values() for e in own]
_KINDS = " ".join(f"WHEN e IN ({', '.join(repr(x) for x in own)}) THEN '{k}'" for k, own in EXTENSIONS.items())
#: File names with every known ending, and some unknown ones, spread over the documents.
_NAMES = f"concat(file_name, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('.', element_at(array({', '.join(repr(e.upper() if i % 4 == 0 else e) for i, e in enumerate([*_ENDINGS, 'exe', 'zip']))}), CAST(1 + doc_id % {len(_ENDINGS) + 2} AS INT))) END)"
_NAMES_SQL = _NAMES.replace("element_at(array(", "list_extract(list_value(")


@query(f"""SELECT CASE {_KINDS} END AS kind, count(*) AS files FROM (SELECT lower(regexp_extract({_NAMES_SQL}, '\\.([^.\\\\/]+)$', 1)) e FROM documents WHERE file_name IS NOT NULL) GROUP BY 1""")
def input_kinds(spark, d):
    names = table(spark, d, "documents").filter("file_name IS NOT NULL").selectExpr(f"{_NAMES} AS name")
    return names.groupBy(input_kind("name").alias("kind")).agg(F.count("*").alias("files"))


@query("SELECT doc_id, CAST(unnest(range(1, page_count + 1)) AS INTEGER) AS page FROM documents WHERE page_count >= 1")
def page_scan(spark, d):
    return table(spark, d, "documents").filter("page_count >= 1").select("doc_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page"))
