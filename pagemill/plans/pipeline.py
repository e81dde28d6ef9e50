"""The stages of a document put together: each takes a table and gives one, so that a caller can stop, store or go on anywhere."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import blocks as K
from pagemill.operators import folds
from pagemill.operators import layout as L
from pagemill.operators import projection as P
from pagemill.operators import render as R
from pagemill.operators import spatial as J
from pagemill.operators import triage
from pagemill.runtime import written


@dataclass(frozen=True)
class Config:
    """What a caller can choose."""

    most_pages: int | None = None
    pages: str | None = None
    crop: tuple[float, float, float, float] | None = None
    keep_diagonal: bool = False
    dedup: bool = True
    drop_garbled: bool = True
    strip_chrome: bool = True
    width: float = 612.0
    height: float = 792.0


def filtered(items: DataFrame, config: Config) -> DataFrame:
    """Items of the chosen pages and area, upright and once."""
    own = items
    if config.pages is not None:
        chosen = L.target_pages(own.sparkSession.createDataFrame([(config.pages,)], "spec string")).first().pages
        if chosen is None:
            raise ValueError(f"no pages: {config.pages}")
        own = own.join(F.broadcast(own.sparkSession.createDataFrame([(p,) for p in chosen], "page int")), "page", "left_semi")
    if config.most_pages is not None:
        first = L.cap_pages(own.select("doc_id", "page").distinct(), config.most_pages)
        own = own.join(first, ["doc_id", "page"], "left_semi")
    own = own if config.keep_diagonal else L.drop_diagonal(own)
    own = J.overlap_dedup(own) if config.dedup else own
    own = triage.drop_garbled(own) if config.drop_garbled else own
    return L.crop(own, *config.crop, config.width, config.height) if config.crop else own


def lined(items: DataFrame, config: Config) -> DataFrame:
    """Lines of the items with their aggregates, seq being their number on the page."""
    own = items.join(folds.band_lines(items), ["doc_id", "page", "seq"])
    lines = P.line_aggregates(own).withColumn("seq", F.col("line"))
    lines = lines.withColumns({"rotation": F.lit(0.0), "font_weight": F.when(F.col("all_bold"), 700).otherwise(400)})
    return L.strip_chrome(lines, config.height) if config.strip_chrome else lines


def blocked(lines: DataFrame, config: Config) -> DataFrame:
    """Blocks of lines with the heading levels of the whole document."""
    sizes = L.heading_map(lines).select("doc_id", F.round(F.col("size") * 100).cast("long").alias("k"), F.col("level").cast("int").alias("level"))
    kinds = folds.classify_blocks(lines, sized=True).withColumn("k", F.when(F.col("kind") == "heading", F.round(F.col("font_size") * 100).cast("long")))
    c = F.col("text")
    list_ = F.col("kind") == "list"
    marker = F.when(list_ & (T.list_marker(c) == "ordered"), F.regexp_extract(c, T.NUMBERED, 1))
    text = F.when(list_, F.coalesce(T.list_body(c), c)).otherwise(c)
    return K.without_repeated_rules(kinds).join(sizes, ["doc_id", "k"], "left").select("doc_id", "page", "block", "kind", text.alias("text"), "level", marker.alias("marker"))


def rendered(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Markdown of the pages that have lines."""
    pages = R.page_texts(lines).join(R.markdown_pages(blocks), ["doc_id", "page"], "left")
    return R.document_markdown(pages)


def parse_items(items: DataFrame, config: Config = Config()) -> DataFrame:
    """Pages of caller-made items as Markdown: all stages one after the other, their items and lines stored once as tables."""
    lines = written(lined(written(filtered(written(items), config)), config))
    return rendered(blocked(lines, config), lines)


def parse_blocks(blocks: DataFrame, pages: DataFrame | None = None, most_pages: int | None = None) -> DataFrame:
    """Pages of caller-made blocks (doc_id, page, block, kind, text, level, marker) as Markdown: nothing is classified."""
    return R.markdown_pages(K.kept_pages(blocks, pages, most_pages))
