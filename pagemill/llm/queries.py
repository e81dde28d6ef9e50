"""Queries of the llm operators over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.garbled import restore_texts
from pagemill.llm.leaks import find_leaks, remove_leaks
from pagemill.llm.lookalikes import look_alike_statistics, normalize_texts
from pagemill.llm.pairs import find_defects
from pagemill.llm.pieces import split_texts
from pagemill.llm.quantiles import daily_latency_sketches, latency_percentiles
from pagemill.llm.scans import examine
from pagemill.llm.tokens import decode_texts, encode_texts
from pagemill.runtime import table, written


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "qa_pairs").select(F.lit("qa_pairs").alias("origin"), F.col("pair_id").alias("row_id"), "question", "answer")
    results = table(spark, sf_dir, "qa_results").select(F.lit("qa_results").alias("origin"), F.col("result_id").alias("row_id"), "question", F.col("predicted").alias("answer"))
    return find_defects(pairs.unionAll(results))


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore_texts(table(spark, sf_dir, "text_items"), ["doc_id", "page", "seq"], "text", "char_codes", buggy="font_is_buggy").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_restored(spark, sf_dir).select("doc_id", "page", "seq").distinct()


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = daily_latency_sketches(table(spark, sf_dir, "qa_eval_results"), table(spark, sf_dir, "page_annotations"))
    return latency_percentiles(daily)


def row_key(*columns: str) -> Column:
    """Key values joined with slashes; a null is an empty part."""
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def _scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examined pages of both tables; a page of text_items is scanned if one of its items has a confidence.

    The same page of several snapshots is examined once; every pass reads one written table.
    """
    regression = table(spark, sf_dir, "regression").filter(F.col("output_text").isNotNull())
    same = regression.groupBy("document", "page", F.xxhash64("output_text").alias("h"), "output_text").agg(F.collect_set("snap").alias("snaps"))
    pages = same.select(
        F.concat(F.lit("regression:"), F.coalesce("document", F.lit(""))).alias("doc"),
        F.transform("snaps", lambda n: F.concat(F.lit("regression:"), n.cast("string"), F.lit("/"), row_key("document", "page"))).alias("bases"),
        "page",
        F.split("output_text", "\n").alias("texts"),
    )
    pages = pages.withColumn("nos", F.sequence(F.lit(1), F.size("texts")))
    items = table(spark, sf_dir, "text_items").select("doc_id", "page", "seq", "text", "confidence")
    # texts of native pages stay where they are, if Spark finds the scanned pages' keys few enough to broadcast
    keys = items.filter(F.col("confidence").isNotNull()).select(F.col("doc_id").alias("d"), F.col("page").alias("p")).distinct()
    scanned = items.join(keys, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("page").eqNullSafe(F.col("p")), "left_semi")
    grouped = scanned.groupBy("doc_id", "page").agg(F.array_sort(F.collect_set(F.struct("seq", "text"))).alias("lines")).select(
        F.concat(F.lit("text_items:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("doc"),
        F.array(F.concat(F.lit("text_items:"), row_key("doc_id", "page"))).alias("bases"),
        "page",
        F.transform("lines", lambda x: x["text"]).alias("texts"),
        F.transform("lines", lambda x: x["seq"]).alias("nos"),
    )
    return examine(written(pages.unionByName(grouped)))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scanned_pages(spark, sf_dir).filter(F.size("nos") > 0).select(F.explode("bases").alias("base"), "nos", "kinds")
    found = found.select("base", F.explode(F.arrays_zip("nos", "kinds")).alias("f"))
    origin = F.substring_index("base", ":", 1)
    key = F.expr("substring(base, instr(base, ':') + 1)")
    item = origin == "text_items"
    rows = found.select(
        origin.alias("origin"),
        F.when(item, F.concat(key, F.lit("/"), F.coalesce(F.col("f.nos").cast("string"), F.lit("")))).otherwise(key).alias("row_key"),
        F.when(item, F.lit(1)).otherwise(F.col("f.nos")).alias("line_no"),
        F.col("f.kinds").alias("kind"),
    )
    return rows.distinct()


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scanned_pages(spark, sf_dir).select(F.explode("bases").alias("base"), "repaired").select("base", F.posexplode("repaired").alias("at", "paragraph"))
    return found.select(F.substring_index("base", ":", 1).alias("origin"), F.expr("substring(base, instr(base, ':') + 1)").alias("page_key"), (F.col("at") + 1).alias("paragraph_no"), "paragraph")


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "text_items").select(F.lit("text_items").alias("origin"), row_key("doc_id", "page", "seq").alias("row_key"), "text")
    pages = table(spark, sf_dir, "regression").select(F.lit("regression").alias("origin"), row_key("snap", "document", "page").alias("row_key"), F.col("output_text").alias("text"))
    statistics = look_alike_statistics([(items, "text"), (pages, "text")])
    return normalize_texts(items.unionAll(pages), ["origin", "row_key"], "text", statistics).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_forms(spark, sf_dir).select("origin", "row_key").distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids decoded again: every text as it was, null as empty."""
    return decode_texts(p7_ids(spark, sf_dir), "doc_id", "ids")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_passages"), "item_id", "passage")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_leaks(table(spark, sf_dir, "documents"), "doc_id", p8_leaks(spark, sf_dir)).select("doc_id")


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text is over the limit exactly when it has a second piece."""
    return p9_pieces(spark, sf_dir).filter(F.col("piece") == 2).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p2_found, p2_restored, p3_percentiles, p4_found, p4_paragraphs, p6_found, p6_forms, p7_ids, p7_texts, p8_found, p8_leaks, p8_clean, p9_found, p9_pieces)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """What SQL can say: the other results are tested against brute force, round trips, public libraries and held ranks."""
    return {"p7_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
