"""Content blocks: image numbering, size limits, tables and rendering to Markdown.

blocks: doc_id, pos, kind, text, level, lang, image (struct of id, ext, caption, reason, extracted), or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

MAX_IMAGE_BYTES = 10_485_760


def heading_ordinals(rows: DataFrame, is_heading: Column, out: str = "heading_no") -> DataFrame:
    """rows (doc_id, pos) with the number of headings up to each."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.sum(is_heading.cast("int")).over(w))


def numbered_images(images: DataFrame) -> DataFrame:
    """images (doc_id, slug, pos, locator) with number and id: counted from 1 in each run of one locator."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    change = F.coalesce((F.col("locator") != F.lag("locator").over(w)).cast("int"), F.lit(1))
    runs = images.withColumn("_change", change).withColumn("_run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    number = F.row_number().over(Window.partitionBy("doc_id", "_run").orderBy("pos"))
    return runs.withColumn("number", number).withColumn("id", T.image_id(F.col("slug"), F.col("locator"), F.col("number"))).drop("_change", "_run")


def limited(images: DataFrame, extract: bool = True, most: int = MAX_IMAGE_BYTES) -> DataFrame:
    """images (id, n_bytes: null if not extracted, reason) after the size policy, with extracted, reason and note."""
    large = F.col("n_bytes") > most
    size = T.human_size(F.col("n_bytes"))
    had = F.col("n_bytes").isNotNull()
    if not extract:
        return images.withColumn("reason", F.when(had, "image extraction disabled").otherwise(F.col("reason"))).withColumn("extracted", F.lit(False)).withColumn("note", F.lit(None).cast("string"))
    reason = F.when(had & large, F.concat(F.lit("image too large ("), size, F.lit(")"))).otherwise(F.col("reason"))
    note = F.when(had & large, F.concat("id", F.lit(": skipped, "), size, F.lit(" exceeds max_image_bytes")))
    return images.withColumn("reason", reason).withColumn("extracted", had & ~large).withColumn("note", note)


def demoted_text(text: Column, id: Column, ext: Column, placeholder: Column) -> Column:
    """Raw Markdown in which an image's link is its placeholder."""
    target = F.concat(F.lit(r"!\[[^\]]*\]\(images/\Q"), id, ext, F.lit(r"\E\)"))
    quoted = F.regexp_replace(placeholder, r"([\\$])", r"\\$1")
    return F.regexp_replace(text, target, quoted)


def table_markdown(cells: Column) -> Column:
    """A pipe table of rows of cells: blank rows go, short rows are filled, blank headers are named. '' without rows."""
    clean = F.filter(F.transform(cells, lambda r: F.transform(r, T.table_cell)), lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(clean, F.size))
    even = F.transform(clean, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    head = F.transform(F.get(even, F.lit(0)), lambda c, i: F.when(c == "", F.concat(F.lit("col"), (i + 1).cast("string"))).otherwise(c))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = line(F.array_repeat(F.lit("---"), width))
    rows = F.concat(F.array(line(head), rule), F.transform(F.slice(even, F.lit(2), F.greatest(F.size(even) - 1, F.lit(0))), line))
    return F.when(F.coalesce(F.size(clean), F.lit(0)) == 0, "").otherwise(F.array_join(rows, "\n"))


def rendered(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, md: blocks in order, parted by blank lines, blank ones left out; a title if no block is a first heading."""
    i = F.col("image")
    image = F.when(i.isNotNull(), T.image_markdown(i["id"], i["ext"], i["caption"], i["extracted"], i["reason"])).otherwise("")
    code = F.when(F.col("kind") == "code", F.regexp_replace("text", r"\s+$", "")).when(F.col("kind").isin("text", "table"), T.stripped(F.col("text"))).otherwise(F.col("text"))
    md = T.block_markdown(F.col("kind"), F.coalesce(code, F.lit("")), F.coalesce(F.col("level"), F.lit(1)), F.col("lang"), image)
    first = F.coalesce(F.bool_or((F.col("kind") == "heading") & (F.col("level") == 1)), F.lit(False))
    made = blocks.withColumn("_md", md)
    per = made.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_md").rlike(r"\S"), F.struct("pos", "_md")))), lambda x: x["_md"]), "\n\n").alias("_body"), first.alias("_h1"))
    out = docs.select("doc_id", "title", "has_h1").join(per, "doc_id", "left")
    titled = ~(F.col("has_h1") | F.coalesce("_h1", F.lit(False)))
    whole = F.concat_ws("\n\n", F.when(titled, F.concat(F.lit("# "), T.stripped(F.col("title")))), F.nullif(F.coalesce("_body", F.lit("")), F.lit("")))
    return out.select("doc_id", F.concat(F.regexp_replace(whole, r"\s+$", ""), F.lit("\n")).alias("md"))


def ordered_notes(notes: DataFrame) -> DataFrame:
    """notes (doc_id, pos, note) without repeats: the first of each stays."""
    return notes.groupBy("doc_id", "note").agg(F.min("pos").alias("pos"))
