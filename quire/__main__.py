"""python -m quire convert|summarize: a thin command line over the plans."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession

    from quire.plans.config import Settings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description="Documents to Markdown, and Markdown to summaries, on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("convert", "summarize"):
        s = sub.add_parser(name)
        s.add_argument("files", nargs="*", metavar="FILES", help="files, or folders of them; the working folder where none is named")
        s.add_argument("--select", help="which of them, in the order listed: numbers and ranges such as 1,3-5, or all")
        s.add_argument("--list", action="store_true", help="list them with their numbers, and no more")
        s.add_argument("--outdir", help="folder of the results")
        s.add_argument("--config", type=Path)
        s.add_argument("--force", action="store_true", help="replace what is there")
        s.add_argument("-v", "--verbose", action="store_true")
        if name == "convert":
            s.add_argument("--check", action="store_true", help="verify image anchors after converting")
        else:
            s.add_argument("--model")
            s.add_argument("--list-models", action="store_true", help="list the models named on standard input, those that converse first")
    return p


def say(line: str) -> None:
    print(f"quire: {line}", file=sys.stderr)


def inputs(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """path, length, content of the files that a command line names."""
    from pyspark.sql import functions as F

    from quire.operators.batch import parse_selection
    from quire.sources import registry

    whole = args.command == "summarize"
    folders = [f for f in args.files or ["."] if Path(f).is_dir()]
    single = [f for f in args.files if not Path(f).is_dir()]
    if missing := [f for f in single if not Path(f).is_file()]:
        raise ValueError(f"no such file: {', '.join(missing)}")
    local = F.regexp_replace("path", "^file:/*(?=/)", "")
    parts = [registry.files(spark, str(Path(f).resolve())).withColumn("path", local) for f in single]
    for folder in folders:
        found = registry.files(spark, str(Path(folder).resolve()), recursive=whole).withColumn("path", local)
        parts.append(registry.markdown_inputs(found, str(Path(folder).resolve())).drop("key") if whole else found.filter(registry.is_supported(F.col("path"))))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = every.dropDuplicates(["path"])
    if not (args.select or args.list):
        return every
    names = [r.path for r in every.select("path").orderBy(F.lower(F.regexp_extract("path", "([^/]*)$", 1)), "path").collect()]  # what a user chooses from
    if args.list:
        for i, name in enumerate(names, 1):
            print(f"{i:4d}  {name}")
        return every.limit(0)
    return every.filter(F.col("path").isin([names[i] for i in parse_selection(args.select, len(names))]))


def run_convert(files: DataFrame, cfg: Settings, args: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from quire.operators import anchors
    from quire.plans import convert
    from quire.sources import readers

    docs = readers.read_files(files, cfg.min_image_pixels).cache()
    linked = docs.select(F.explode("images.link").alias("link")).filter("link is not null").distinct()
    there = [r.link for r in linked.toLocalIterator() if Path(r.link).is_file()]  # what the files of one command line link to
    beside = docs.sparkSession.read.format("binaryFile").load(there) if there else files.limit(0)
    made = convert.markdown(docs, beside, cfg).cache()
    images = readers.with_linked(docs, beside)
    done = {r.path: r for r in convert.write_tree(convert.placed(made), images, str(Path(args.outdir or "outputs").resolve()), args.force).toLocalIterator()}
    code = 0
    for r in convert.report(made).join(made.select("path", "notes", F.col("error").alias("failed")), "path").orderBy("path").toLocalIterator():
        written = done.get(r.path)
        if r.failed or written is None or written.error:
            say(r.line if r.failed else f"{r.path}: {written.error if written else 'not written'}")
            code = 1
            continue
        print(r.line)
        for note in (r.notes or []) + ([f"written to {written.target}"] if args.verbose else []):
            print(f"    {note}")
    if args.check and not code:
        texts = made.filter("error is null").select(F.col("path").alias("doc_id"), "md")
        for r in anchors.problems(texts, images.filter("data is not null").select(F.col("path").alias("doc_id"), F.concat("id", "ext").alias("filename"))).orderBy("doc_id", "class", "name").toLocalIterator():
            say(f"  - {r.doc_id}: {r.problem}")
            code = 2
    return code


def run_summarize(files: DataFrame, cfg: Settings, args: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from quire.functions import text as T
    from quire.plans import convert
    from quire.sources import registry

    docs = files.select("path", F.col("content").cast("string").alias("md"))
    beside = registry.summary_path(F.col("doc_id"), str(Path.cwd()))
    target = beside if not args.outdir else F.concat(F.lit(f"{args.outdir}/"), T.file_name(beside))
    code, taken = 0, set()
    for r in convert.summarize(docs, cfg).withColumn("target", target).orderBy("doc_id").toLocalIterator():
        path = Path(r.target)
        if path in taken or path.exists() and not args.force:
            say(f"{path} is there already" + ("" if path in taken else "; --force replaces it"))
            code = 1
            continue
        taken.add(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(r.md, encoding="utf-8")
        print(f"{r.doc_id} -> {path}  ({r.total_words:,} words -> {r.summary_words:,})" + (f"  {r.mode}, {r.sections} section(s)" if args.verbose else ""))
    return code


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from quire.operators import batch
    from quire.plans import config

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quire").getOrCreate()
    converting = args.command == "convert"
    if not converting and args.list_models:
        ids = [x for line in sys.stdin if (x := line.strip())]
        if ids:
            for r in batch.listed_models(spark.createDataFrame([(x,) for x in ids], "id string")).orderBy("chat", "id", ascending=[False, True]).collect():
                print(r.id if r.chat else f"{r.id}  (does not converse)")
        return 0
    kind, name = (config.ConvertConfig, "quire-convert.yaml") if converting else (config.SummaryConfig, "quire-summarize.yaml")
    try:
        cfg = config.read(kind, name, args.config)
        if not args.config and (made := config.provide(kind, name)):
            say(f"default settings are in {made}")
        cfg = cfg.but(model=args.model) if not converting and args.model else cfg
        files = inputs(spark, args)
    except ValueError as e:
        say(str(e))
        return 1
    for key in cfg.unknown:
        say(f"unknown setting {key!r}")
    return (run_convert if converting else run_summarize)(files, cfg, args)


if __name__ == "__main__":
    sys.exit(main())
