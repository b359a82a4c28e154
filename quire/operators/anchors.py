"""Anchor consistency: what Markdown links to against the image files there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINK = r"!\[[^\]]*\]\(images/([^)]+)\)"
PLACEHOLDER = r"\*\[([\w.-]+) — [^\]]*\]\*"


def problems(markdown: DataFrame, files: DataFrame) -> DataFrame:
    """markdown (doc_id, md), files (doc_id, filename) to doc_id, class, name, problem: missing files, orphans, images told of twice."""
    linked = markdown.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("md", F.lit(LINK), 1))).alias("name"))
    skipped = markdown.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("md", F.lit(PLACEHOLDER), 1))).alias("name"))
    on_disk = files.select("doc_id", F.col("filename").alias("name")).distinct()
    stems = linked.select("doc_id", F.regexp_replace("name", r"(?<=.)\.[^.]*$", "").alias("name")).distinct()
    missing = linked.join(on_disk, ["doc_id", "name"], "left_anti").select("doc_id", F.lit(1).alias("class"), "name", F.concat(F.lit("anchor references missing file: images/"), "name").alias("problem"))
    orphan = on_disk.join(linked, ["doc_id", "name"], "left_anti").select("doc_id", F.lit(2).alias("class"), "name", F.concat(F.lit("orphan image file with no anchor: images/"), "name").alias("problem"))
    both = skipped.join(stems, ["doc_id", "name"], "left_semi").select("doc_id", F.lit(3).alias("class"), "name", F.concat("name", F.lit(" appears as both a link and a placeholder")).alias("problem"))
    return missing.unionByName(orphan).unionByName(both)
