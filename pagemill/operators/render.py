"""Rendering of pages and blocks to text, JSON, Markdown and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T


def page_texts(lines: DataFrame) -> DataFrame:
    """Text of each page: its lines in order, one below the other; null texts are left out."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return lines.filter(F.col("text").isNotNull()).groupBy("doc_id", "page").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("text"))


def document_texts(lines: DataFrame) -> DataFrame:
    """(doc_id, page, text): pages under a header line, apart from the one before by a blank line. One after the other they are the text of
    the document, which can be too large for one row."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    head = F.concat(F.when(nth > 1, "\n\n").otherwise(""), F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"))
    return page_texts(lines).select("doc_id", "page", F.concat(head, F.col("text")).alias("text"))


def item_json(items: DataFrame, metadata: bool = False) -> DataFrame:
    """One JSON object for each item; absent fields are left out, a missing confidence is 1.0, rotation comes with metadata only."""
    fields = ["text", "x", "y", "width", "height", F.coalesce(F.nanvl("confidence", F.lit(None)), F.lit(1.0)).alias("confidence")]
    if metadata:
        fields += ["rotation", "font_name"]
    return items.select("doc_id", "page", "seq", F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("json"))


def markdown_block(kind: Column, text: Column, level: Column, marker: Column) -> Column:
    t = T.escape_markdown(text)
    indent = F.repeat(F.lit("  "), F.least(F.coalesce(level, F.lit(0)), F.lit(6)))
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce(level, F.lit(1))), F.lit(" "), t))
        .when(kind == "list", F.concat(indent, F.coalesce(marker, F.lit("-")), F.lit(" "), t))
        .when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(kind == "rule", F.lit("---"))
        .otherwise(t)
    )


def markdown_pages(blocks: DataFrame) -> DataFrame:
    """Markdown of each page of blocks (doc_id, page, block, kind, text, level, marker): blank lines between blocks, single
    line ends between neighbouring list items; leading, trailing and repeated rules are left out."""
    w = Window.partitionBy("doc_id", "page").orderBy("block")
    full = Window.partitionBy("doc_id", "page")
    content = F.when(F.col("kind") != "rule", F.col("block"))
    kept = blocks.withColumn("old", F.lag("kind").over(w)).withColumn("first", F.min(content).over(full)).withColumn("last", F.max(content).over(full))
    kept = kept.filter((F.col("kind") != "rule") | ((F.col("block") > F.col("first")) & (F.col("block") < F.col("last")) & (F.coalesce("old", F.lit("")) != "rule")))
    kept = kept.withColumn("before", F.lag("kind").over(w))
    glue = F.when(F.col("before").isNull(), "").when((F.col("before") == "list") & (F.col("kind") == "list"), "\n").otherwise("\n\n")
    drawn = kept.withColumn("piece", F.concat(glue, markdown_block(F.col("kind"), F.col("text"), F.col("level"), F.col("marker"))))
    return drawn.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda s: s["piece"]), "").alias("markdown"))


def pipe_table(cells: DataFrame, keys: Sequence[str] = ("table",)) -> DataFrame:
    """Pipe table of cells (*`keys`, row, col, text): the first row is the header."""
    rows = cells.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", F.regexp_replace("text", r"\|", r"\\|").alias("t")))).alias("c"))
    line = F.concat(F.lit("| "), F.array_join(F.transform("c", lambda s: s["t"]), " | "), F.lit(" |"))
    rule = F.concat(F.lit("\n|"), F.array_join(F.transform("c", lambda s: F.lit(" --- ")), "|"), F.lit("|"))
    drawn = rows.withColumn("line", F.when(F.col("row") == F.min("row").over(Window.partitionBy(*keys)), F.concat(line, rule)).otherwise(line))
    return drawn.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda s: s["line"]), "\n").alias("markdown"))


def row_cells(items: DataFrame) -> DataFrame:
    """Cells (doc_id, page, row, col, text) of items with (row_y, cell): items of a cell stand side by side, null texts are
    left out."""
    own = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("x", "seq", "text"))))
    cells = items.filter(F.col("row_y").isNotNull()).groupBy("doc_id", "page", F.col("row_y").alias("row"), F.col("cell").alias("col"))
    return cells.agg(F.array_join(F.transform(own, lambda s: s["text"]), " ").alias("text"))


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, one file for each task."""
    df.write.mode("errorifexists").json(path)


def html_tables(cells: DataFrame, keys: Sequence[str] = ("table",)) -> DataFrame:
    """HTML of tables whose cells (*`keys`, row, col, text, colspan, rowspan, is_header) can span others; null spans are 1."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    tag = F.when(F.coalesce("is_header", F.lit(False)), "th").otherwise("td")
    span = lambda c: F.when(F.coalesce(F.col(c), F.lit(1)) > 1, F.concat(F.lit(f' {c}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("")
    cell = F.concat(F.lit("<"), tag, span("colspan"), span("rowspan"), F.lit(">"), t, F.lit("</"), tag, F.lit(">"))
    rows = cells.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", cell.alias("t")))).alias("c"))
    line = F.concat(F.lit("<tr>"), F.array_join(F.transform("c", lambda s: s["t"]), ""), F.lit("</tr>"))
    return rows.groupBy(*keys).agg(F.concat(F.lit("<table>\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", line.alias("t")))), lambda s: s["t"]), "\n"), F.lit("\n</table>")).alias("html"))


def document_json(items: DataFrame, metadata: bool = False) -> DataFrame:
    """(doc_id, page, json): an object for each page with its number, text and items; absent fields are left out, a missing confidence is
    1.0, rotation and font come with `metadata` only. A document is its pages' objects in order: these stay rows, as a document can
    be of any size."""
    fields = ["text", "x", "y", "width", "height", F.coalesce(F.nanvl("confidence", F.lit(None)), F.lit(1.0)).alias("confidence")]
    fields += ["rotation", "font_name"] if metadata else []
    own = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(*fields).alias("item")))), lambda s: s["item"])
    pages = items.groupBy("doc_id", "page").agg(own.alias("text_items")).withColumn("text", F.array_join(F.transform("text_items", lambda i: F.coalesce(i["text"], F.lit(""))), "\n"))
    return pages.select("doc_id", "page", F.to_json(F.struct(F.col("page").alias("page_number"), "text", "text_items"), {"ignoreNullFields": "true"}).alias("json"))


def document_markdown(pages: DataFrame, separator: str = "-----") -> DataFrame:
    """(doc_id, page, markdown) with the separator line before each page of a document but its first: written one after the other they
    are the document. `pages` have doc_id, page, markdown and text; a page without blocks is its text in a fence."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    own = F.when(F.coalesce("markdown", F.lit("")) != "", F.col("markdown")).otherwise(F.concat(F.lit("```\n"), F.coalesce("text", F.lit("")), F.lit("\n```")))
    return pages.withColumn("nth", nth).select("doc_id", "page", F.concat(F.when(F.col("nth") > 1, f"\n\n{separator}\n\n").otherwise(""), own).alias("markdown"))


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """Writes the canonical pictures of (doc_id, page, seq, content) as one table of files in the shared folder and gives the reference of
    every picture: (doc_id, page, seq, target); a duplicate points at the file of its canonical one."""
    from pagemill.operators.spatial import canonical_images

    named = canonical_images(images)
    own = F.concat_ws("/", F.col("page").cast("string"), F.col("seq").cast("string"))
    targets = named.withColumn("target", F.concat_ws("/", F.col("doc_id").cast("string"), F.coalesce("duplicate_of", own)))
    firsts = targets.filter(F.col("duplicate_of").isNull()).select("doc_id", "page", "seq", "target")
    images.join(firsts, ["doc_id", "page", "seq"]).select("target", "content").write.mode("errorifexists").parquet(folder)
    return targets.select("doc_id", "page", "seq", "target")


def rewritten(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """Pages (doc_id, page, markdown) whose references ![...](image:page/seq) point at the pictures' targets."""
    refs = targets.select("doc_id", "page", F.struct(F.concat(F.lit("(image:"), F.col("page").cast("string"), F.lit("/"), F.col("seq").cast("string"), F.lit(")")).alias("old"), F.concat(F.lit("("), F.col("target"), F.lit(")")).alias("new")).alias("r"))
    own = refs.groupBy("doc_id", "page").agg(F.collect_list("r").alias("refs"))
    met = pages.join(own, ["doc_id", "page"], "left")
    return met.withColumn("markdown", F.aggregate(F.coalesce("refs", F.array().cast("array<struct<old:string,new:string>>")), F.col("markdown"), lambda t, r: F.replace(t, r["old"], r["new"]))).drop("refs")


def batch_report(results: DataFrame) -> DataFrame:
    """(files, failed, ok) of parsed files (path, error): one row, ok only if none failed."""
    return results.groupBy().agg(F.countDistinct("path").alias("files"), F.count_if(F.col("error").isNotNull()).alias("failed"), (F.count_if(F.col("error").isNotNull()) == 0).alias("ok"))


def output_paths(files: DataFrame, source: str, target: str, extension: str) -> DataFrame:
    """Files with `out`: their path below `source` under `target`, with the new extension."""
    inner = F.substring(F.col("path"), F.length(F.lit(source.rstrip("/"))) + 2, 1 << 20)
    return files.withColumn("out", F.concat(F.lit(target.rstrip("/") + "/"), F.regexp_replace(inner, r"\.[^./]*$", ""), F.lit("." + extension)))
