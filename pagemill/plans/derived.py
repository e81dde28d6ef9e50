"""Tables that the tests data lacks (links, rules, pictures, recognised text), derived from all of text_items.

Each is a piece of SQL that Spark and the checking engine read alike; the rules are invented and deterministic, so that every
join has rows that meet, nearly meet and do not, in many documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.plans.sql import ITEMS
from pagemill.runtime import table

#: Items, some printed again a little aside, some tilted.
PRINTED = """it2 AS (SELECT doc_id, page, seq, text, x, y, width, height, CASE WHEN seq % 13 = 4 THEN coalesce(rotation, 0.0) + 37.0 WHEN seq % 13 = 5 THEN -1.5 ELSE rotation END AS rotation,
  font_name, font_size, font_weight, font_flags, has_unicode_map_error, confidence, math FROM it
  UNION ALL SELECT doc_id, page, seq + 100000, CASE WHEN seq % 3 = 0 THEN 'overprint' ELSE text END, x + width * 0.25, y + height * 0.2, width * (1.0 + seq % 4), height * (1.0 + seq % 3), rotation,
  font_name, font_size, font_weight, font_flags, has_unicode_map_error, confidence, math FROM it WHERE seq % 7 = 3)"""
LINKS = """links AS (SELECT doc_id, page, seq AS pos, x - 2.0 AS x1, y - 2.0 AS y1, x + width + 30.0 AS x2, y + height + CASE WHEN seq % 3 = 0 THEN 60.0 ELSE 4.0 END AS y2,
  concat('https://example.org/', CAST(seq AS VARCHAR(20))) AS uri FROM it WHERE seq % 4 = 1)"""
SEGMENTS = """segments AS (SELECT doc_id, page, seq AS pos, x - 3.0 AS x1, x + width * CASE WHEN seq % 5 = 0 THEN 0.3 ELSE 1.2 END AS x2,
  y + height * CASE seq % 4 WHEN 0 THEN 0.4 WHEN 1 THEN 0.9 WHEN 2 THEN 1.1 ELSE 0.1 END AS sy, CASE WHEN seq % 6 = 0 THEN 3.0 ELSE 0.8 END AS thickness FROM it WHERE seq % 2 = 0 AND x IS NOT NULL AND y IS NOT NULL)"""
#: What a file holds, and what was recognised beside or over it.
NATIVE = "native AS (SELECT doc_id, page, seq, text, x, y, width, height FROM it WHERE seq % 3 <> 0)"
RECOGNISED = """recognised AS (SELECT doc_id, page, seq, text, x + width * 0.7 * (seq % 2) AS x, y + height * 0.45 * (seq % 5) AS y, width * (1.0 + seq % 2) AS width, height,
  CASE WHEN seq % 17 = 0 THEN 0.05 ELSE 0.6 + (seq % 4) * 0.1 END AS confidence FROM it WHERE seq % 3 = 0 AND x IS NOT NULL)"""
SHAPES = "shapes AS (SELECT doc_id, page, seq, x + 250.0 * (page % 2) + 3.0 * (seq % 5) AS x, y AS y, 20.0 + 15.0 * (seq % 4) AS width, CASE WHEN seq % 9 = 0 THEN 1.0 ELSE 18.0 + 4.0 * (seq % 6) END AS height FROM it WHERE seq % 2 = 0)"
PATHS = "paths AS (SELECT doc_id, page, seq AS path, x + 5.0 AS px, y + 2.0 AS py, 40.0 AS pw, 10.0 * (seq % 3) AS ph FROM it WHERE seq % 5 = 2)"
HORIZONTALS = "horizontals AS (SELECT doc_id, page, seq AS rule, y - 2.0 AS y, 60.0 + 20.0 * (seq % 5) AS x1, 300.0 + 30.0 * (seq % 7) AS x2 FROM it WHERE seq % 3 = 0 AND y IS NOT NULL)"
VERTICALS = "verticals AS (SELECT doc_id, page, seq AS rule, 50.0 + 40.0 * (seq % 9) AS vx, y - 30.0 AS v1, y + 45.0 AS v2 FROM it WHERE seq % 8 = 1 AND y IS NOT NULL)"
#: Pictures of pages; some fill the page, some are too small to count.
IMAGES = """images AS (SELECT doc_id, page, seq, CASE WHEN seq % 10 = 0 THEN 0.0 ELSE x END AS x, CASE WHEN seq % 10 = 0 THEN 0.0 ELSE y END AS y,
  CASE WHEN seq % 10 = 0 THEN 600.0 WHEN seq % 10 = 5 THEN 12.0 ELSE 90.0 END AS width, CASE WHEN seq % 10 = 0 THEN 780.0 ELSE 60.0 END AS height FROM it WHERE seq % 5 = 0 AND (doc_id + page) % 3 = 0 AND x IS NOT NULL AND y IS NOT NULL)"""
#: Facts of pages that the items don't have: annotations that paint text, shares of invisible and covered text.
FACTS = """facts AS (SELECT DISTINCT doc_id, page, (doc_id + page) % 4 = 0 AS annotation_text, CASE WHEN (doc_id + page) % 5 = 0 THEN 0.95 ELSE 0.1 END AS invisible_share,
  CASE WHEN (doc_id + 2 * page) % 7 = 0 THEN 0.9 ELSE 0.0 END AS hidden_share FROM it)"""
OUTLINE = "outline AS (SELECT doc_id, page, seq AS pos, CAST(1 + seq % 8 AS INT) AS level, substring(text, 1, 24) AS title, CASE WHEN seq % 3 = 0 THEN NULL ELSE 792.0 - y + 4.0 * (seq % 6) END AS y_pdf FROM it WHERE seq % 6 = 2 AND text IS NOT NULL)"
TAGS = "tags AS (SELECT doc_id, page, seq AS pos, CASE seq % 5 WHEN 0 THEN 'H1' WHEN 1 THEN 'P' WHEN 2 THEN 'h3' WHEN 3 THEN 'H9' ELSE 'Span' END AS role, mcid AS m1, mcid + 1 AS m2 FROM it WHERE mcid IS NOT NULL AND seq % 2 = 0)"
ALL = {
    "it": "", "it2": PRINTED, "links": LINKS, "segments": SEGMENTS, "native": NATIVE, "recognised": RECOGNISED, "shapes": SHAPES, "paths": PATHS, "horizontals": HORIZONTALS, "verticals": VERTICALS,
    "images": IMAGES, "facts": FACTS, "outline": OUTLINE, "tags": TAGS,
}


def sql(*names: str) -> str:
    """The beginning of a query over the named tables, for the checking engine."""
    return "WITH " + ", ".join([ITEMS, *(ALL[n] for n in names if ALL[n])])


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name in Spark, from the same SQL."""
    text = sql(name).replace("FROM text_items", "FROM {text_items}")
    return spark.sql(f"{text} SELECT * FROM {name}", text_items=table(spark, sf_dir, "text_items").repartition("doc_id", "page"))
