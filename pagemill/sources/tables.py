"""Tables as the operators take them: items with double geometry, lines of documents, inline fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.runtime import table

_GEOMETRY = ("x", "y", "width", "height", "rotation", "font_size", "confidence")
_KEPT = ("doc_id", "page", "seq", "text", "x", "y", "width", "height", "rotation", "font_name", "font_size", "font_weight", "font_flags", "has_unicode_map_error", "confidence", "link", "strike", "underline", "mcid", "math")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of page text, repeated rows once.

    They are brought together by page first: the comparison of rows, windows over a page and groups of it share that exchange.
    """
    columns = [F.col(c).cast("double").alias(c) if c in _GEOMETRY else F.col(c) for c in _KEPT]
    return table(spark, sf_dir, "text_items").select(*columns).repartition("doc_id", "page").distinct()


def document_lines(spark: SparkSession, sf_dir: str, ends: str = "\n") -> DataFrame:
    """(doc_id, line_no, line) of documents, split at newlines or what else the pattern `ends` has."""
    docs = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return docs.select("doc_id", F.posexplode(F.split("text", ends)).alias("at", "line")).select("doc_id", (F.col("at") + 1).alias("line_no"), "line")


#: Extensions by kind of input.
EXTENSIONS = {
    "office": ("doc", "docx", "docm", "dot", "dotm", "dotx", "odt", "ott", "rtf", "pages"),
    "presentation": ("ppt", "pptx", "pptm", "pot", "potm", "potx", "odp", "otp", "key"),
    "spreadsheet": ("xls", "xlsx", "xlsm", "xlsb", "ods", "ots", "csv", "tsv", "numbers"),
    "image": ("jpg", "jpeg", "png", "gif", "bmp", "tiff", "tif", "webp", "svg"),
    "text": ("txt", "md", "markdown", "log"),
    "pdf": ("pdf",),
}


def input_kind(name: str):
    """Kind of input by the extension of a file name; null for an unknown one."""
    extension = F.lower(F.regexp_extract(F.col(name), r"\.([^.\\/]+)$", 1))
    kind = F.lit(None).cast("string")
    for k, own in EXTENSIONS.items():
        kind = F.when(extension.isin(*own), k).otherwise(kind)
    return kind


#: First bytes of formats, in hexadecimal.
MAGIC = {"25504446": "pdf", "89504E47": "png", "FFD8FF": "jpeg", "47494638": "gif", "504B0304": "zip", "D0CF11E0": "ole", "49492A00": "tiff", "4D4D002A": "tiff", "424D": "bmp"}


def sniff(content: str):
    """Format by the first bytes of a binary column; null for an unknown one."""
    head = F.hex(F.substring(F.col(content), 1, 8))
    kind = F.lit(None).cast("string")
    for prefix, k in MAGIC.items():
        kind = F.when(head.startswith(prefix), k).otherwise(kind)
    return kind


#: What happens to an input of each kind: text has no pages to draw.
ROUTES = {"pdf": "open", "office": "convert", "presentation": "convert", "spreadsheet": "convert", "image": "wrap", "text": "reject"}


def resolve_inputs(files: DataFrame) -> DataFrame:
    """Files (path, content) with `kind` and `route`: 'open', 'convert', 'wrap' (a picture becomes a page), 'reject' or 'unknown'.

    The first bytes decide between a PDF and the rest; else the extension does, and for a name without a known one again the
    first bytes. Null contents go by their name, null names by their bytes.
    """
    head = sniff("content")
    by_bytes = F.when(head == "pdf", "pdf").when(head.isin("png", "jpeg", "gif", "tiff", "bmp"), "image").when(head.isin("zip", "ole"), "office")
    kind = F.when(head == "pdf", "pdf").otherwise(F.coalesce(input_kind("path"), by_bytes))
    route = F.lit("unknown")
    for k, r in ROUTES.items():
        route = F.when(F.col("kind") == k, r).otherwise(route)
    return files.withColumn("kind", kind).withColumn("route", route)


def from_bytes(spark: SparkSession, contents: dict[str, bytes]) -> DataFrame:
    """Documents that are at hand as bytes (a standard input, a message) as files (path, length, content)."""
    return spark.createDataFrame([(k, len(v), bytearray(v)) for k, v in contents.items()], "path string, length bigint, content binary")


def scan_folder(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """Files of a folder (and those below it) in the order of their paths: (path, length, content), read where they are needed."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "length", "content").orderBy("path")
