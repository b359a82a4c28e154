"""Files to Markdown with anchored images, and Markdown to summaries: the two plans, and their sinks."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import batch, blocks, summaries
from quire.plans.config import ConvertConfig, SummaryConfig
from quire.sources import readers, registry


def image_table(documents: DataFrame, files: DataFrame) -> DataFrame:
    """path, n, id, ext, caption, reason, n_bytes: every image; linked ones by a join with the files' lengths. No bytes are moved."""
    each = documents.select("path", F.posexplode("images").alias("n", "i")).select("path", "n", "i.id", "i.ext", "i.caption", "i.reason", "i.link", F.octet_length("i.data").cast("long").alias("_own"))
    lengths = files.select(F.regexp_replace("path", "^file:/*(?=/)", "").alias("link"), F.col("length").cast("long").alias("_linked"))
    out = each.join(lengths, "link", "left")
    reason = F.when(F.col("link").isNotNull() & F.col("_linked").isNull(), "linked image file not found").otherwise(F.col("reason"))
    return out.select("path", "n", "id", "ext", "caption", reason.alias("reason"), F.coalesce("_own", "_linked").alias("n_bytes"))


def markdown(documents: DataFrame, files: DataFrame, cfg: ConvertConfig = ConvertConfig()) -> DataFrame:
    """path, title, slug, md, images, placeholders, notes, error: a row for each document that readers.read_files gives."""
    images = blocks.limited(image_table(documents, files), cfg.extract_images, cfg.max_image_bytes)
    form = T.image_markdown(F.col("id"), F.col("ext"), F.col("caption"), F.col("extracted"), F.col("reason"))
    per = images.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("n", form.alias("md")))).alias("_images"), F.sum(F.col("extracted").cast("int")).alias("_written"), F.sum((~F.col("extracted")).cast("int")).alias("_skipped"), F.collect_list("note").alias("_notes")
    )
    rows = documents.join(per, "path", "left")
    mine = F.coalesce(F.col("_images"), F.array().cast("array<struct<n:int,md:string>>"))
    filled = lambda text: F.aggregate(mine, text, lambda t, i: F.replace(t, F.concat(F.lit("\ue000"), i["n"].cast("string"), F.lit("\ue001")), i["md"]))

    def piece(b):
        own = F.get(F.filter(mine, lambda i: i["n"] == b["image"]), F.lit(0))["md"]
        text = F.when(b["kind"] == "raw", filled(b["text"])).when(b["kind"] == "code", F.regexp_replace(b["text"], r"\s+$", "")).otherwise(T.stripped(b["text"]))
        return T.block_markdown(b["kind"], text, b["level"], b["lang"], F.coalesce(own, F.lit("")))

    parts = F.filter(F.transform("blocks", piece), lambda p: p.rlike(r"\S"))
    titled = ~(F.col("has_h1") | F.exists("blocks", lambda b: (b["kind"] == "heading") & (b["level"] == 1)))
    whole = F.array_join(F.concat(F.when(titled, F.array(F.concat(F.lit("# "), T.stripped(F.col("title"))))).otherwise(F.array().cast("array<string>")), parts), "\n\n")
    md = F.when(F.col("error").isNull(), F.concat(F.regexp_replace(whole, r"\s+$", ""), F.lit("\n")))
    notes = F.array_distinct(F.concat("notes", F.coalesce("_notes", F.array().cast("array<string>"))))
    return rows.select("path", "title", "slug", md.alias("md"), F.coalesce("_written", F.lit(0)).alias("images"), F.coalesce("_skipped", F.lit(0)).alias("placeholders"), notes.alias("notes"), "error")


def convert(files: DataFrame, cfg: ConvertConfig = ConvertConfig()) -> DataFrame:
    """files (path, length, content) to markdown(...) of those that are documents."""
    return markdown(readers.read_files(files.filter(registry.is_supported(F.col("path"))), cfg.min_image_pixels), files, cfg)


def placed(made: DataFrame) -> DataFrame:
    """Converted documents with dest: folder names, unique in this run, first come first served in the order of file names."""
    order = F.struct(F.lower(T.file_name(F.col("path"))), F.col("path"))
    rows = made.filter(F.col("error").isNull()).withColumn("pos", order).withColumn("stem", T.slugify(T.stem(F.col("path"))))
    names = batch.distinct_names(batch.destinations_by_rank(rows.select("path", "pos", "slug", "stem")))
    return names.select("path", "dest").join(made.filter(F.col("error").isNull()), "path")


def write_tree(made: DataFrame, images: DataFrame, outdir: str, force: bool = False) -> DataFrame:
    """<outdir>/<dest>/<slug>.md and images/ beside it, written by the executors to a file system they share. Returns path, target, error.

    made: placed(...); images: readers.with_linked(...). A folder that is there is refused, or with force replaced. For corpora write Parquet.
    """
    grouped = images.filter(F.col("data").isNotNull()).groupBy("path").agg(F.collect_list(F.struct(F.concat("id", "ext").alias("name"), "data")).alias("files"))

    def each(batches: Iterator) -> Iterator:
        import shutil

        import pandas as pd

        for b in batches:
            out = []
            for r in b.itertuples():
                folder, error = Path(outdir) / r.dest, None
                try:
                    if folder.exists() and not force:
                        raise FileExistsError(f"{folder} already exists (use --force to overwrite)")
                    if folder.exists():
                        shutil.rmtree(folder) if folder.is_dir() else folder.unlink()
                    folder.mkdir(parents=True)
                    (folder / f"{r.slug}.md").write_text(r.md, encoding="utf-8")
                    for f in r.files if r.files is not None else ():
                        (folder / "images").mkdir(exist_ok=True)
                        (folder / "images" / f["name"]).write_bytes(bytes(f["data"]))
                except OSError as e:
                    error = str(e)
                out.append((r.path, str(folder / f"{r.slug}.md"), error))
            yield pd.DataFrame(out, columns=["path", "target", "error"], dtype=object)

    return made.join(grouped, "path", "left").select("path", "dest", "slug", "md", "files").mapInPandas(each, "path string, target string, error string")


def write_parquet(made: DataFrame, path: str, force: bool = False) -> None:
    """The sink for corpora."""
    made.write.mode("overwrite" if force else "errorifexists").parquet(path)


def summarize(documents: DataFrame, cfg: SummaryConfig = SummaryConfig()) -> DataFrame:
    """documents (path, md) to doc_id (the path), title, md, summary_words, total_words, mode, sections; empty ones go."""
    docs = documents.filter(F.col("md").rlike(r"\S")).select(F.col("path").alias("doc_id"), "md")
    fallback = T.title_from_path(F.col("doc_id"))
    return summaries.summarize(docs, fallback, T.file_name(F.col("doc_id")), cfg.model, cfg.carry_context, cfg.chapter_threshold_words, **cfg.ratios())


def report(made: DataFrame) -> DataFrame:
    """path, line: what a batch says of each document."""
    bits = F.array_join(F.filter(F.array(F.when(F.col("images") > 0, F.format_string("%d image(s)", "images")), F.when(F.col("placeholders") > 0, F.format_string("%d placeholder(s)", "placeholders"))), lambda x: x.isNotNull()), ", ")
    line = F.concat(T.file_name(F.col("path")), F.lit(" -> "), "slug", F.when(bits == "", "").otherwise(F.concat(F.lit("  ["), bits, F.lit("]"))))
    return made.select("path", F.coalesce(F.concat(T.file_name(F.col("path")), F.lit(": "), "error"), line).alias("line"))


