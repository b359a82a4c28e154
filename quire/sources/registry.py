"""Which files can be read, and by which reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T

# Suffixes that are read, by reader.
READERS = {
    "pdf": (".pdf",),
    "docx": (".docx",),
    "pptx": (".pptx",),
    "epub": (".epub",),
    "html": (".htm", ".html", ".xhtml"),
    "opendocument": (".odp", ".ods", ".odt"),
    "rtf": (".rtf",),
    "markdown": (".markdown", ".md"),
    "plain": (".log", ".text", ".txt"),
    "csv": (".csv",),
    "fallback": (".ipynb", ".json", ".msg", ".xls", ".xlsx", ".xml"),
}
BY_SUFFIX = {s: reader for reader, suffixes in READERS.items() for s in suffixes}
SUMMARY_SUFFIX = ".summary.md"
OUTPUTS = "outputs"
SCAN_DEPTH = 2


def supported() -> list[str]:
    return sorted(BY_SUFFIX)


def is_supported(path: Column) -> Column:
    return T.suffix(path).isin(supported())


def is_markdown(path: Column) -> Column:
    return T.suffix(path).isin(".md", ".markdown")


def is_summary(path: Column) -> Column:
    return F.lower(T.file_name(path)).endswith(SUMMARY_SUFFIX)


def registry(spark: SparkSession) -> DataFrame:
    """suffix, reader: one row for each suffix."""
    rows = ", ".join(f"('{s}', '{r}')" for s, r in sorted(BY_SUFFIX.items()))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(suffix, reader)")


def dispatched(files: DataFrame) -> DataFrame:
    """files (path) with suffix, reader and error: null, or what speaks against reading the file."""
    table = F.broadcast(registry(files.sparkSession))  # a fixed list
    out = files.withColumn("suffix", T.suffix(F.col("path"))).join(table, "suffix", "left")
    said = F.concat(F.lit("unsupported file type '"), "suffix", F.lit("'. Supported: " + ", ".join(supported())))
    return out.withColumn("error", F.when(F.col("reader").isNull(), said))


def convertible(files: DataFrame) -> DataFrame:
    """files (path) of one folder that can be read, with at: their place by lower-case name."""
    from pyspark.sql import Window

    return files.filter(is_supported(F.col("path"))).withColumn("at", F.row_number().over(Window.orderBy(F.lower(T.file_name(F.col("path"))), "path")))


def markdown_inputs(files: DataFrame, root: str, depth: int = SCAN_DEPTH) -> DataFrame:
    """files (path) below root that are Markdown and no summaries, at most `depth` folders down, none in a folder of leading dot; with key, their order."""
    relative = F.split(F.substring("path", len(root.rstrip("/")) + 2, 1 << 20), "/")
    folders = F.slice(relative, F.lit(1), F.size(relative) - 1)
    seen = F.col("path").startswith(root.rstrip("/") + "/") & is_markdown(F.col("path")) & ~is_summary(F.col("path")) & (F.size(folders) <= depth) & ~F.exists(folders, lambda p: p.startswith("."))
    return files.filter(seen).withColumn("key", F.transform(relative, F.lower))


def summary_path(path: Column, cwd: str) -> Column:
    """Where a summary goes: beside a file below a folder named outputs, else to ./outputs."""
    parts = F.split(path, "/")
    beside = F.array_contains(parts, OUTPUTS)
    folder = F.regexp_replace(path, "/[^/]*$", "")
    return F.concat(F.when(beside, folder).otherwise(f"{cwd.rstrip('/')}/{OUTPUTS}"), F.lit("/"), T.stem(path), F.lit(SUMMARY_SUFFIX))


def files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, modificationTime, length, content of the files of a folder; content is read only where it is used."""
    reader = spark.read.format("binaryFile")
    return (reader.option("recursiveFileLookup", "true") if recursive else reader).load(path)
