"""Requests, summaries and their assembly over planned sections."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import prompts, text as T

CARRY_WORDS = 400
OVERVIEW_WORDS = 300
LEAST_COMPRESSION = 0.5


class Summarizer(Protocol):
    """What answers requests; made once in each Python worker."""

    def complete(self, system: str, user: str, text: str, target_words: int) -> tuple[str, int, int]: ...


def targets(sections: DataFrame, carry: bool = True, **ratios) -> DataFrame:
    """Planned sections with target_words, heading and verbatim: whether a summary would not halve the section."""
    target = T.target_words(F.when(F.col("mode") == "single", F.col("total_words")).otherwise(F.col("word_count")), **ratios)
    label = F.when(F.col("mode") == "chapters", "Chapter").otherwise("Part")
    heading = F.when(F.col("title") == "", F.concat_ws(" ", label, F.col("pos").cast("string"))).otherwise(F.col("title"))
    out = sections.withColumn("target_words", target).withColumn("heading", heading)
    return out.withColumn("verbatim", (F.col("mode") != "single") & (F.col("target_words") >= F.col("word_count") * LEAST_COMPRESSION))


def carried(rows: DataFrame, body: str = "body", most: int = CARRY_WORDS) -> DataFrame:
    """rows with previous: the cut text of the last summarized section before; sections kept as they are leave it be."""
    own = F.when(~F.col("verbatim"), T.truncated(F.col(body), most))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("previous", F.coalesce(F.last(own, ignorenulls=True).over(w), F.lit("")))


def lead(sections: DataFrame, carry: bool = True) -> DataFrame:
    """Sections (with targets) with summary, user and system: the built-in summarizer takes the leading words; nothing leaves the JVM."""
    text = T.section_text(F.col("title"), F.col("level"), F.col("body"))
    summary = F.when(F.col("verbatim"), T.stripped(F.col("body"))).otherwise(T.leading_words(text, F.col("target_words").cast("int")))
    rows = sections.withColumn("summary", summary)
    rows = carried(rows, "summary") if carry else rows.withColumn("previous", F.lit(""))
    single = F.col("mode") == "single"
    user = F.when(single, prompts.single_user(text, F.col("target_words"))).otherwise(prompts.chapter_user(F.col("title"), text, F.col("target_words"), F.col("pos"), F.col("total"), F.col("previous")))
    return rows.withColumn("system", F.when(single, prompts.SINGLE_SYSTEM).otherwise(prompts.CHAPTER_SYSTEM)).withColumn("user", F.when(~F.col("verbatim"), user))


def per_document(rows: DataFrame, target: int = OVERVIEW_WORDS) -> DataFrame:
    """A row for each document of summarized sections: all that its overview and its assembly need, in one pass over the sections.

    joined are the summaries under their headings, parts the same numbered, overview the leading words of joined.
    """
    heading = F.coalesce(F.nullif("heading", F.lit("")), F.format_string("Section %d", F.col("pos").cast("int")))
    line = F.concat(F.lit("## "), heading, F.lit("\n"), F.col("summary"))
    piece = F.concat(F.lit("## "), F.col("pos").cast("string"), F.lit(". "), F.col("heading"), F.lit("\n\n"), T.stripped(F.col("summary")))
    each = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"), piece.alias("piece"), F.col("summary").alias("summary"))))
    per = rows.groupBy("doc_id").agg(each.alias("_s"), *(F.first(c).alias(c) for c in ("doc_title", "mode", "total_words")), F.count("*").alias("sections"), F.sum(T.word_count(F.col("summary"))).alias("words"))
    text = lambda of: F.array_join(F.transform("_s", lambda x: x[of]), "\n\n")
    out = per.select("doc_id", F.col("doc_title").alias("title"), "mode", "total_words", "sections", "words", text("line").alias("joined"), text("piece").alias("parts"), F.get("_s", F.lit(0))["summary"].alias("one"))
    return out.withColumn("overview", F.when(F.col("mode") != "single", T.leading_words(F.col("joined"), F.lit(target))))


def overviews(rows: DataFrame, target: int = OVERVIEW_WORDS) -> DataFrame:
    """doc_id, user: one overview request for each document of several sections, over all of them in order."""
    return per_document(rows.filter(F.col("mode") != "single"), target).select("doc_id", prompts.overview_user(F.col("title"), F.col("joined"), target).alias("user"), "overview")


def assembled(rows: DataFrame, target: int = OVERVIEW_WORDS) -> DataFrame:
    """doc_id, title, md, summary_words, total_words, mode, sections: title, overview, numbered sections."""
    out = per_document(rows, target)
    head, alone = F.concat(F.lit("# Summary of "), F.col("title")), F.col("mode") == "single"
    long = F.concat_ws("\n\n", head, F.lit("## Overview"), T.stripped(F.col("overview")), "parts")
    md = F.when(alone, F.concat(F.concat_ws("\n\n", head, "one"), F.lit("\n"))).otherwise(F.concat(F.regexp_replace(long, r"\s+$", ""), F.lit("\n")))
    words = F.col("words") + F.when(alone, 0).otherwise(T.word_count(F.col("overview")))
    return out.select("doc_id", "title", md.alias("md"), words.cast("long").alias("summary_words"), "total_words", "mode", "sections")


def ratio(summary_words: Column, total_words: Column) -> Column:
    """Percent of the words that the summary has; 0 of nothing."""
    return F.when(total_words == 0, F.lit(0.0)).otherwise(summary_words / total_words * 100)


def footer(name: Column, model: str, mode: Column, sections: Column, total: Column, summary: Column) -> Column:
    """Provenance line. Percentages are rounded half to even."""
    n = sections.cast("string")
    shape = F.when(mode == "single", F.lit("single pass")).when(mode == "chapters", F.concat(n, F.lit(" chapters, summarized independently"))).otherwise(F.concat(n, F.lit(" parts, split by length")))
    percent = F.format_string("%.0f", F.rint(ratio(summary, total)))
    return F.concat(
        F.lit("\n---\n\n*Summarized from `"), name, F.lit(f"` by quire using {model} ("), shape, F.lit("). "), F.format_number(total, 0), F.lit(" words in, "), F.format_number(summary, 0), F.lit(" out ("), percent, F.lit("%).*\n")
    )


_MADE: dict[bytes, Summarizer] = {}


def _of_worker(make: Callable[[], Summarizer]) -> Summarizer:
    """What make gives, made once in each Python worker: what it has learned of a service holds for all documents that come to the worker."""
    from pyspark import cloudpickle

    key = cloudpickle.dumps(make)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = make()
    return _MADE[key]


def answered(sections: DataFrame, make: Callable[[], Summarizer], carry: bool = True) -> DataFrame:
    """Sections (with targets) with summary, input_tokens, output_tokens and error, from a summarizer of one's own.

    Sections kept as they are never reach Python. With carry, a document's requests run in order, each with the cut answer before it;
    without, they are independent. After an error the rest of the document has that error.
    """
    schema = "doc_id {0}, pos long, summary string, input_tokens long, output_tokens long, error string".format(dict(sections.dtypes)["doc_id"])
    text = T.section_text(F.col("title"), F.col("level"), F.col("body"))
    asked = sections.filter(~F.col("verbatim")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("total").cast("long").alias("total"), "mode", "title", text.alias("text"), F.col("target_words").cast("long").alias("target_words"))

    def run(model: Summarizer, rows: pd.DataFrame) -> pd.DataFrame:
        previous, failed, out = "", None, []
        for r in rows.sort_values("pos").itertuples():
            body, used_in, used_out = "", 0, 0
            if failed is None:
                try:
                    system, user = prompts.SINGLE_SYSTEM if r.mode == "single" else prompts.CHAPTER_SYSTEM, prompts.user_text(r.mode, r.title, r.text, int(r.target_words), int(r.pos), int(r.total), previous)
                    body, used_in, used_out = model.complete(system, user, r.text, int(r.target_words))
                    words = body.split()
                    previous = (body if len(words) <= CARRY_WORDS else " ".join(words[:CARRY_WORDS]) + " …") if carry else ""
                except Exception as e:  # noqa: BLE001 - an answer that fails is data
                    failed = str(e) or type(e).__name__
            out.append((r.doc_id, r.pos, body, used_in, used_out, failed))
        return pd.DataFrame(out, columns=["doc_id", "pos", "summary", "input_tokens", "output_tokens", "error"], dtype=object)

    if carry:
        done = asked.groupBy("doc_id").applyInPandas(lambda rows: run(_of_worker(make), rows), schema)
    else:

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = _of_worker(make)
            for b in batches:
                yield pd.concat([run(model, b.iloc[i : i + 1]) for i in range(len(b))] or [run(model, b)])

        done = asked.mapInPandas(each, schema)
    kept = sections.filter("verbatim").select("doc_id", F.col("pos").cast("long").alias("pos"), T.stripped(F.col("body")).alias("summary"), F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"), F.lit(None).cast("string").alias("error"))
    return sections.withColumn("pos", F.col("pos").cast("long")).join(done.unionByName(kept), ["doc_id", "pos"])


def usage(rows: DataFrame) -> DataFrame:
    """calls, input_tokens, output_tokens, line: over the requests that were answered."""
    one = rows.filter(F.col("error").isNull() & ~F.col("verbatim")).agg(F.count("*").alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
    return one.withColumn("line", T.usage_line(F.col("calls"), F.col("input_tokens"), F.col("output_tokens")))


def summarize(docs: DataFrame, title: Column, name: Column, model: str = "gpt-5.4", carry: bool = True, threshold: int | None = None, **ratios) -> DataFrame:
    """docs (doc_id, md, ...) to doc_id, title, md (with footer), summary_words, total_words, mode, sections."""
    from quire.operators import structure

    planned = structure.plan(docs, **({} if threshold is None else {"threshold": threshold}), fallback=title)
    done = assembled(lead(targets(planned, carry, **ratios), carry))
    named = docs.select("doc_id", name.alias("_name"))
    end = footer(F.col("_name"), model, F.col("mode"), F.col("sections"), F.col("total_words"), F.col("summary_words"))
    return done.join(named, "doc_id").withColumn("md", F.concat("md", end)).drop("_name")
