"""Queries of the general data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.operators.snapshots import snapshot_changes, snapshot_values
from pagemill.runtime import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "regression"), "snap", ["document", "page"], ["output_text"])


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_values(table(spark, sf_dir, "regression"), "snap", ["document", "page"], ["output_text"])


P5_SQL = """
WITH r AS (SELECT DISTINCT snap, document, page, output_text FROM regression),
b AS (SELECT min(snap) AS lo, max(snap) AS hi FROM r),
n AS (SELECT * FROM r), o AS (SELECT snap + 1 AS snap, document, page, output_text FROM r)
SELECT CAST(coalesce(n.snap, o.snap) AS INTEGER) AS snap, coalesce(n.document, o.document) AS document, coalesce(n.page, o.page) AS page,
  CASE WHEN o.snap IS NULL THEN 'added' WHEN n.snap IS NULL THEN 'removed' ELSE 'changed' END AS change_type
FROM n FULL JOIN o ON n.snap = o.snap AND n.document = o.document AND n.page = o.page, b
WHERE coalesce(n.snap, o.snap) > lo AND coalesce(n.snap, o.snap) <= hi
  AND (n.snap IS NULL OR o.snap IS NULL OR n.output_text IS DISTINCT FROM o.output_text)
"""

VALUES_SQL = P5_SQL.replace("END AS change_type\n", "END AS change_type, o.output_text AS old_output_text, n.output_text AS new_output_text\n", 1)

QUERIES = {"p5_found": p5_found, "p5_values": p5_values}
SQL = {"p5_found": P5_SQL, "p5_values": VALUES_SQL}
