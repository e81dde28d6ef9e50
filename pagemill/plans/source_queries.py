"""Queries of sources, sinks and whole pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from pagemill.operators import render as R
from pagemill.plans import pipeline
from pagemill.plans.page_queries import IT
from pagemill.runtime import map_arrow, table, written
from pagemill.sources import pdf
from pagemill.sources.convert import page_points, text_pdf
from pagemill.sources.tables import EXTENSIONS, ROUTES, items, resolve_inputs

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _files(spark, d):
    """Every document as a PDF file of its lines; letters and digits beyond ASCII are '#'."""
    import pyarrow as pa

    own = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7e\n]", "#").alias("text"))
    own = own.repartition(4 * spark.sparkContext.defaultParallelism)  # a file of texts is small beside the work on it

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_pdf(t) for t in b.column(1).to_pylist()], pa.binary())], ["path", "content"])

    return map_arrow(own, run, "path string, content binary")


_BARE = "regexp_replace(coalesce(text, ''), '[^\\x20-\\x7e\\n]', '#', 'g')"


@query(f"SELECT doc_id, count(*) AS items, md5(string_agg(replace(line, ' ', ''), '|' ORDER BY i)) AS digest FROM (SELECT doc_id, unnest(string_split({_BARE}, chr(10))) line, generate_subscripts(string_split({_BARE}, chr(10)), 1) i FROM documents) WHERE trim(line, ' ') <> '' GROUP BY doc_id")
def pdf_items(spark, d):
    """Documents written as PDF files and read again: their lines come back as items (blanks aside), page by page."""
    found = pdf.part(pdf.read_pdf(_files(spark, d)), "item")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("page", "seq", F.replace("text", F.lit(" "), F.lit("")).alias("t")))), lambda s: s["t"])
    return found.groupBy(F.col("path").cast("bigint").alias("doc_id")).agg(F.count("*").alias("items"), F.md5(F.array_join(lines, "|")).alias("digest"))


@query(f"SELECT doc_id, CAST(ceil(len(string_split({_BARE}, chr(10))) / 50.0) AS BIGINT) AS pages, '1.4' AS version, 1 AS eof_marks FROM documents")
def pdf_pages(spark, d):
    parts = written(pdf.read_pdf(_files(spark, d)))
    pages = pdf.part(parts, "page").groupBy("path").agg(F.count("*").alias("pages"))
    facts = pdf.part(parts, "metadata").select("path", "version", "eof_marks")
    return pages.join(facts, "path").select(F.col("path").cast("bigint").alias("doc_id"), "pages", "version", "eof_marks")


_CASES = " ".join(f"WHEN e IN ({', '.join(repr(x) for x in own)}) THEN '{k}'" for k, own in EXTENSIONS.items())
_ROUTE = " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in ROUTES.items())
_NAMED = "CASE doc_id % 5 WHEN 0 THEN file_name WHEN 1 THEN concat(file_name, '.docx') WHEN 2 THEN concat(file_name, '.md') WHEN 3 THEN concat(file_name, '.tiff') ELSE 'unnamed' END"


@query(f"""SELECT doc_id, kind, CASE kind {_ROUTE} ELSE 'unknown' END AS route FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'pdf' ELSE coalesce(CASE {_CASES} END, CASE WHEN doc_id % 7 = 1 THEN 'image' WHEN doc_id % 7 = 2 THEN 'office' END) END AS kind
  FROM (SELECT doc_id, lower(regexp_extract({_NAMED}, '\\.([^.\\\\/]+)$', 1)) e FROM documents))""")
def input_routes(spark, d):
    """Documents under names of several kinds, with contents that begin as PDF, PNG, ZIP or plain text."""
    head = F.when(F.col("doc_id") % 7 == 0, "25504446").when(F.col("doc_id") % 7 == 1, "89504E470D0A").when(F.col("doc_id") % 7 == 2, "504B0304").otherwise("686921")
    files = table(spark, d, "documents").select("doc_id", F.expr(_NAMED).alias("path"), F.unhex(head).cast(BinaryType()).alias("content"))
    return resolve_inputs(files).select("doc_id", "kind", "route")


@query("SELECT doc_id, round((500 + doc_id % 2000) * 72 / coalesce(nullif(CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE 300.0 END, 0), 150.0), 6) AS points FROM documents")
def picture_points(spark, d):
    sized = table(spark, d, "documents").select("doc_id", (500 + F.col("doc_id") % 2000).alias("px"), F.when(F.col("doc_id") % 3 == 1, 0.0).when(F.col("doc_id") % 3 == 2, 300.0).alias("dpi"))
    return sized.select("doc_id", F.round(page_points("px", "dpi"), 6).alias("points"))


@query(f"""{IT} SELECT doc_id, page, count(*) AS items, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY seq)) AS digest, sum(CASE WHEN confidence IS NULL OR isnan(confidence) OR confidence = 1 THEN 1 ELSE 0 END) AS unsure FROM it GROUP BY doc_id, page""")
def page_json(spark, d):
    """Pages written as JSON objects and read again."""
    schema = "struct<page_number:int,text:string,text_items:array<struct<text:string,confidence:double>>>"
    read = R.document_json(items(spark, d)).select("doc_id", "page", F.from_json("json", schema).alias("j"))
    unsure = F.size(F.filter("j.text_items", lambda i: i["confidence"] == 1.0))
    return read.select("doc_id", "page", F.size("j.text_items").cast("long").alias("items"), F.md5("j.text").alias("digest"), unsure.cast("long").alias("unsure"))


_CELLS = "ce AS (SELECT doc_id, page, seq AS row, 1 + seq % 3 AS col, replace(text, '&', '<&>') AS text, CASE WHEN seq % 5 = 0 THEN 2 END AS colspan, CASE WHEN seq % 7 = 0 THEN 3 ELSE 1 END AS rowspan, seq <= 2 AS is_header FROM it)"
_TEXT = "replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_TAG = "CASE WHEN is_header THEN 'th' ELSE 'td' END"


@query(f"""{IT}, {_CELLS} SELECT doc_id, page, md5('<table>' || chr(10) || string_agg('<tr><' || {_TAG} || CASE WHEN coalesce(colspan, 1) > 1 THEN ' colspan="' || colspan || '"' ELSE '' END || CASE WHEN rowspan > 1 THEN ' rowspan="' || rowspan || '"' ELSE '' END || '>' || {_TEXT} || '</' || {_TAG} || '></tr>', chr(10) ORDER BY row) || chr(10) || '</table>') AS digest FROM ce GROUP BY doc_id, page""")
def table_html(spark, d):
    cells = spark.sql(f"{IT.replace('FROM text_items', 'FROM {text_items}')}, {_CELLS} SELECT * FROM ce", text_items=table(spark, d, "text_items"))
    return R.html_tables(cells, ["doc_id", "page"]).select("doc_id", "page", F.md5("html").alias("digest"))


@query()
def parsed_pages(spark, d):
    """All stages from items to Markdown."""
    return pipeline.parse_items(items(spark, d))


@query("SELECT 'out/' || regexp_replace(substring('in/' || file_name, 4), '\\.[^./]*$', '') || '.md' AS out, count(*) AS n FROM documents WHERE file_name IS NOT NULL GROUP BY 1")
def batch_outputs(spark, d):
    files = table(spark, d, "documents").filter("file_name IS NOT NULL").select(F.concat(F.lit("in/"), "file_name").alias("path"))
    return R.output_paths(files, "in", "out", "md").groupBy("out").agg(F.count("*").alias("n"))


