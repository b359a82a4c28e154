"""Page layout: from spans and page items to headings, captions and reading order.

spans: doc_id, page (from 0), block, line, span, text, size. items: doc_id, page, pos, kind (text, image), text, size, x0, y0, and for
images xref, width, height. toc: doc_id, pos, level, title. pages: doc_id, page_count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

# Thresholds of the layout rules.
HEADING_RATIO = 1.15
MAX_HEADING_CHARS = 200
FURNITURE_PART = 0.5
FURNITURE_PAGES = 3
LINE_TOLERANCE = 3.0
SAMPLE_PAGES = 50
MIN_PIXELS = 10_000


def sized_spans(spans: DataFrame) -> DataFrame:
    """Spans with text on the first pages, sizes to one decimal."""
    clean = T.stripped(F.col("text"))
    return spans.filter((F.col("page") < SAMPLE_PAGES) & (clean != "")).select("doc_id", "page", "block", "line", "span", F.bround("size", 1).alias("size"), F.length(clean).alias("chars"))


def body_sizes(spans: DataFrame) -> DataFrame:
    """doc_id, body_size: the size with most characters; of equals the one seen first."""
    per = sized_spans(spans).groupBy("doc_id", "size").agg(F.sum("chars").alias("chars"), F.min(F.struct("page", "block", "line", "span")).alias("first"))
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("chars"), "first"))
    return per.withColumn("_n", best).filter("_n = 1").select("doc_id", F.col("size").alias("body_size"))


def heading_sizes(spans: DataFrame, bodies: DataFrame) -> DataFrame:
    """doc_id, size, level: distinct sizes well above the body's, the largest first; six levels."""
    sizes = sized_spans(spans).select("doc_id", "size").distinct().join(bodies, "doc_id").filter((F.col("body_size") > 0) & (F.col("size") >= F.col("body_size") * F.lit(HEADING_RATIO)))
    return sizes.select("doc_id", "size", F.least(F.lit(6), F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size")))).alias("level"))


def toc_levels(toc: DataFrame) -> DataFrame:
    """doc_id, key, level: outline titles, normalized; the first of a title counts."""
    keyed = toc.select("doc_id", "pos", T.normalized(F.col("title")).alias("key"), F.greatest(F.lit(1), F.least(F.lit(6), F.col("level"))).alias("level")).filter("key <> ''")
    return keyed.groupBy("doc_id", "key").agg(F.min_by("level", "pos").alias("level"))


def furniture(items: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, xref: images on half of the pages, of three pages at least."""
    seen = items.filter("kind = 'image' and xref > 0").groupBy("doc_id", "xref").agg(F.count_distinct("page").alias("n"))
    enough = F.greatest(F.lit(FURNITURE_PAGES), F.floor(F.col("page_count") * FURNITURE_PART))
    return seen.join(pages, "doc_id").filter((F.col("page_count") >= FURNITURE_PAGES) & (F.col("n") >= enough)).select("doc_id", "xref")


def content_items(items: DataFrame, pages: DataFrame, min_pixels: int = MIN_PIXELS) -> DataFrame:
    """items without page furniture and small images."""
    seen = items.filter((F.col("kind") == "text") | (F.col("width") * F.col("height") >= min_pixels))
    return seen.join(furniture(items, pages), ["doc_id", "xref"], "left_anti").select(*items.columns)


def reading_order(items: DataFrame) -> DataFrame:
    """items with at (from 1 on each page): by line, then from the left; rounding is half to even."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.rint(F.col("y0") / LINE_TOLERANCE), "x0", "pos")
    return items.withColumn("at", F.row_number().over(w))


def captioned(items: DataFrame) -> DataFrame:
    """items (with at) with caption on images, without the texts that became captions.

    An image takes the text after it, else the one before, if it reads like a caption. A text between two
    images belongs to the first, whose next it is.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("at")
    fits = (F.col("kind") == "text") & F.col("text").rlike(T.CAPTION_START)
    rows = items.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    for n in (1, 2):
        rows = rows.withColumn(f"_kind{n}", F.lag("kind", n).over(w))
    rows = rows.withColumn("_next", F.lead("_fits").over(w)).withColumn("_next_text", F.lead("text").over(w)).withColumn("_prev", F.lag("_fits").over(w)).withColumn("_prev_text", F.lag("text").over(w))
    image = F.col("kind") == "image"
    takes_next = image & F.coalesce("_next", F.lit(False))
    takes_prev = image & ~takes_next & F.coalesce("_prev", F.lit(False)) & (F.coalesce("_kind2", F.lit("")) != "image")
    rows = rows.withColumn("_takes_next", takes_next).withColumn("_takes_prev", takes_prev)
    used = F.coalesce(F.lag("_takes_next").over(w), F.lit(False)) | F.coalesce(F.lead("_takes_prev").over(w), F.lit(False))
    rows = rows.withColumn("caption", F.when(F.col("_takes_next"), F.col("_next_text")).when(F.col("_takes_prev"), F.col("_prev_text")).when(image, "")).withColumn("_used", used)
    return rows.filter(~(F.col("_used") & (F.col("kind") == "text"))).select(*items.columns, "caption")


def classified(items: DataFrame, bodies: DataFrame, sizes: DataFrame, toc: DataFrame) -> DataFrame:
    """items with level: the outline's, else by font size for short large texts, else 0."""
    keyed = items.withColumn("key", T.normalized(F.col("text")))
    joined = keyed.join(toc.withColumnRenamed("level", "_toc"), ["doc_id", "key"], "left").join(bodies, "doc_id", "left").join(sizes.withColumnRenamed("level", "_by_size"), ["doc_id", "size"], "left")
    body = F.coalesce("body_size", F.lit(0.0))
    large = (F.length("text") <= MAX_HEADING_CHARS) & (body > 0) & (F.col("size") >= body * F.lit(HEADING_RATIO))
    level = F.when(F.col("kind") != "text", 0).when(F.col("_toc").isNotNull(), F.col("_toc")).when(large, F.coalesce("_by_size", F.lit(1))).otherwise(0)
    return joined.withColumn("level", level.cast("int")).select(*items.columns, "level")
