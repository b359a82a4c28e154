"""Headings, sections and chunks of Markdown documents: (doc_id, md) to (doc_id, mode, pos, total, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

MIN_SECTION_WORDS = 50
CHUNK_WORDS = 8000
CHUNK_TAIL = 0.25
CHAPTER_THRESHOLD = 20_000
_LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it: a lambda's argument is never computed anew."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines_of(c: Column) -> Column:
    """Lines, without an empty one after a final line end."""
    return let(F.split(c, _LINE_END), lambda parts: F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def fenced_ranges(lines: Column) -> Column:
    """Ranges of lines that lie in a code fence, fence lines included: a fold over fence lines alone.

    A fence closes at the next fence of its character; one that never closes runs to the end.
    """
    marks = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("line"), F.substring(F.regexp_extract(x, T.FENCE, 1), 1, 1).alias("c"))), lambda m: m["c"] != "")
    start = F.struct(F.lit("").alias("c"), F.lit(-1).alias("line"), F.array().cast("array<struct<first:int,last:int>>").alias("done"))

    def step(acc: Column, m: Column) -> Column:
        opens = F.struct(m["c"].alias("c"), m["line"].alias("line"), acc["done"].alias("done"))
        closes = F.struct(F.lit("").alias("c"), F.lit(-1).alias("line"), F.array_append(acc["done"], F.struct(acc["line"].alias("first"), m["line"].alias("last"))).alias("done"))
        return F.when(acc["c"] == "", opens).when(acc["c"] == m["c"], closes).otherwise(acc)

    end = lambda acc: F.when(acc["c"] == "", acc["done"]).otherwise(F.array_append(acc["done"], F.struct(acc["line"].alias("first"), F.lit(2**31 - 1).alias("last"))))
    return F.aggregate(marks, start, step, end)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 0), text, in_fence: a row for each line."""
    cut = docs.select("doc_id", let(lines_of(F.col("md")), lambda ls: F.struct(ls.alias("lines"), fenced_ranges(ls).alias("fences"))).alias("c"))
    rows = cut.select("doc_id", F.col("c.fences").alias("_fences"), F.posexplode("c.lines").alias("line", "text"))
    return rows.select("doc_id", "line", "text", F.exists("_fences", lambda r: F.col("line").between(r["first"], r["last"])).alias("in_fence"))


def heads_of(ls: Column) -> Column:
    """(line, level, title) of the ATX headings among lines, outside fences."""
    seen = F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("line"), x.alias("text"))), lambda h: h["text"].rlike(T.HEADING))
    out = let(fenced_ranges(ls), lambda fences: F.filter(seen, lambda h: ~F.exists(fences, lambda r: h["line"].between(r["first"], r["last"]))))
    return F.transform(out, lambda h: F.struct(h["line"].alias("line"), F.length(F.regexp_extract(h["text"], T.HEADING, 1)).alias("level"), T.stripped(F.regexp_extract(h["text"], T.HEADING, 2)).alias("title")))


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, line, level, title: ATX headings outside fences."""
    return docs.select("doc_id", F.explode(let(lines_of(F.col("md")), heads_of)).alias("h")).select("doc_id", "h.*")


def split_levels(found: DataFrame) -> DataFrame:
    """doc_id, split_level: the shallowest level that two headings or more have; documents without one have no row."""
    return found.groupBy("doc_id", "level").count().filter("count >= 2").groupBy("doc_id").agg(F.min("level").alias("split_level"))


def titles(docs: DataFrame, fallback: Column) -> DataFrame:
    """doc_id, title: the first level-1 heading with a title, else the fallback."""
    first = headings(docs).filter("level = 1 and title <> ''").groupBy("doc_id").agg(F.min_by("title", "line").alias("_title"))
    return docs.join(first, "doc_id", "left").select("doc_id", F.coalesce("_title", fallback).alias("title"))


def level_of(heads: Column) -> Column:
    """The shallowest level that two headings or more have; null where there is none."""
    of = lambda n: F.size(F.filter(heads, lambda h: h["level"] == n))
    return F.coalesce(*(F.when(of(n) >= 2, n) for n in range(1, 7)))


def _between(ls: Column, first: Column, end: Column) -> Column:
    """Lines first (from 0) to the one before end, as one text."""
    return T.stripped(F.array_join(F.slice(ls, first + 1, F.greatest(end - first, F.lit(0))), "\n"))


def _cut(ls: Column, heads: Column, level: Column, min_words: int) -> Column:
    """(pos, title, body) of the sections at a level; text in front of the first is its own section or put before it."""

    def bodied(cuts: Column) -> Column:
        own = F.transform(cuts, lambda h, i: F.struct((i + 1).alias("pos"), h["title"].alias("title"), _between(ls, h["line"] + 1, F.coalesce(F.get(cuts, i + 1)["line"], F.size(ls))).alias("body")))

        def fronted(front: Column) -> Column:
            led = F.transform(own, lambda x, i: F.struct(x["pos"].alias("pos"), x["title"].alias("title"), F.when((i == 0) & (front != ""), T.stripped(F.concat_ws("\n\n", front, x["body"]))).otherwise(x["body"]).alias("body")))
            first = F.array(F.struct(F.lit(0).alias("pos"), F.lit("Front matter").alias("title"), front.alias("body")))
            return F.when(T.word_count(front) >= min_words, F.concat(first, own)).otherwise(led)

        return let(_between(ls, F.lit(0), F.get(cuts, F.lit(0))["line"]), fronted)

    return let(F.filter(heads, lambda h: h["level"] == level), bodied)


def _folded(parts: Column, level: Column, min_words: int) -> Column:
    """(pos, title, level, body): sections (pos, title, body) with thin ones folded into the next (at the end: the one before).

    A fold over word counts finds the sections that stand. Headings of folded sections come in reverse order before their texts.
    """
    counts = F.transform(parts, lambda x: F.struct(x["pos"].alias("pos"), T.word_count(x["body"]).alias("words"), (T.word_count(x["title"]) + 1).alias("head")))
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<int>").alias("ends"))

    def step(acc: Column, x: Column) -> Column:
        n = acc["carry"] + x["words"]
        thin = F.struct((n + x["head"]).alias("carry"), acc["ends"].alias("ends"))
        return F.when(n < min_words, thin).otherwise(F.struct(F.lit(0).cast("long").alias("carry"), F.array_append(acc["ends"], x["pos"]).alias("ends")))

    def texts(some: Column) -> Column:
        head = lambda x: F.concat(F.repeat(F.lit("#"), F.greatest(level, F.lit(1))), F.lit(" "), x["title"])
        return F.concat(F.transform(F.reverse(some), head), F.transform(some, lambda x: x["body"]))

    def group(ends: Column, end: Column, i: Column) -> Column:
        before = F.coalesce(F.get(ends, i - 1), F.lit(-1))
        thin = F.filter(parts, lambda x: (x["pos"] > before) & (x["pos"] < end))
        tail = F.filter(parts, lambda x: (i == F.size(ends) - 1) & (x["pos"] > end))
        own = F.filter(parts, lambda x: x["pos"] == end)
        pieces = F.concat(texts(thin), F.transform(own, lambda x: x["body"]), texts(tail))
        return F.struct((i + 1).alias("pos"), F.get(own, F.lit(0))["title"].alias("title"), level.alias("level"), T.stripped(F.array_join(F.filter(pieces, lambda t: t != ""), "\n\n")).alias("body"))

    lone = F.array(F.struct(F.lit(1).alias("pos"), F.lit("").alias("title"), F.lit(1).alias("level"), T.stripped(F.array_join(F.filter(texts(parts), lambda t: t != ""), "\n\n")).alias("body")))
    return let(F.aggregate(counts, start, step)["ends"], lambda ends: F.when(F.size(ends) == 0, lone).otherwise(F.transform(ends, lambda e, i: group(ends, e, i))))


def _sections(md: Column, min_words: int, fold: bool) -> Column:
    """Sections of a text, raw or folded; null where no level has two headings."""

    def of(ls: Column, heads: Column, level: Column) -> Column:
        raw = _cut(ls, heads, level, min_words)
        return F.when(level.isNotNull(), let(raw, lambda parts: _folded(parts, level, min_words)) if fold else raw)

    return let(lines_of(md), lambda ls: let(heads_of(ls), lambda heads: let(level_of(heads), lambda level: of(ls, heads, level))))


def raw_sections(docs: DataFrame, min_words: int = MIN_SECTION_WORDS) -> DataFrame:
    """doc_id, pos, title, body: sections at the split level, text in front of the first as its own or put before it."""
    return docs.select("doc_id", F.explode(_sections(F.col("md"), min_words, False)).alias("s")).select("doc_id", "s.*")


def merged_sections(docs: DataFrame, min_words: int = MIN_SECTION_WORDS) -> DataFrame:
    """doc_id, pos, title, level, body: sections with thin ones folded into their neighbours."""
    return docs.select("doc_id", F.explode(_sections(F.col("md"), min_words, True)).alias("s")).select("doc_id", "s.*")


def _packed(md: Column, target: int) -> Column:
    """(pos, title, level, body): paragraphs packed greedily to `target` words; a small last part joins the one before."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("words"), F.array().cast("array<int>").alias("breaks"))

    def step(acc: Column, w: Column) -> Column:
        full = (acc["words"] + w > target) & (acc["i"] > F.coalesce(F.try_element_at(acc["breaks"], F.lit(-1)), F.lit(0)))
        return F.struct((acc["i"] + 1).alias("i"), F.when(full, w).otherwise(acc["words"] + w).alias("words"), F.when(full, F.array_append(acc["breaks"], acc["i"])).otherwise(acc["breaks"]).alias("breaks"))

    def end(acc: Column) -> Column:
        small = (F.size(acc["breaks"]) > 0) & (acc["words"] < F.lit(target * CHUNK_TAIL))
        return F.when(small, F.slice(acc["breaks"], F.lit(1), F.size(acc["breaks"]) - 1)).otherwise(acc["breaks"])

    def parts(ps: Column, breaks: Column) -> Column:
        ranges = F.zip_with(F.concat(F.array(F.lit(0)), breaks), F.concat(breaks, F.array(F.size(ps))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        body = lambda r: F.array_join(F.slice(ps, r["a"] + 1, r["b"] - r["a"]), "\n\n")
        every = F.transform(ranges, lambda r, i: F.struct((i + 1).alias("pos"), F.format_string("Part %d", i + 1).alias("title"), F.lit(1).alias("level"), body(r).alias("body")))
        return F.when(F.size(ps) > 0, every)

    paragraphs = F.filter(F.split(md, r"\n\s*\n"), lambda p: p.rlike(r"\S"))
    return let(paragraphs, lambda ps: let(F.aggregate(F.transform(ps, T.word_count), start, step, end), lambda breaks: parts(ps, breaks)))


def chunks(docs: DataFrame, target: int = CHUNK_WORDS) -> DataFrame:
    """doc_id, pos, title, level, body: the text by length alone."""
    return docs.select("doc_id", F.explode(_packed(F.col("md"), target)).alias("s")).select("doc_id", "s.*")


def plan(docs: DataFrame, threshold: int = CHAPTER_THRESHOLD, min_words: int = MIN_SECTION_WORDS, chunk_words: int = CHUNK_WORDS, fallback: Column | None = None) -> DataFrame:
    """doc_id, mode, total_words, doc_title, total, pos, title, level, body, word_count: the sections of each document (doc_id, md).

    Short documents are one section; long ones split at their headings if that gives two sections or more, else by length. A document
    is read once, as one row, and is a row a section only at the end. doc_title is the first level-1 heading, else the fallback.
    """

    def modes(text: Column, total: Column, sections: Column) -> Column:
        one = F.array(F.struct(F.lit(1).alias("pos"), F.lit("").alias("title"), F.lit(1).alias("level"), text.alias("body")))
        single, chapters = total < threshold, F.coalesce(F.size(sections), F.lit(0)) >= 2
        mode = F.when(single, "single").when(chapters, "chapters").otherwise("chunks")
        return F.struct(total.alias("total_words"), mode.alias("mode"), F.when(single, one).when(chapters, sections).otherwise(_packed(text, chunk_words)).alias("sections"))

    def whole(text: Column) -> Column:
        def of(total: Column) -> Column:
            sections = F.when(total >= threshold, _sections(text, min_words, True))
            return let(sections, lambda found: modes(text, total, found))

        return let(T.word_count(text), of)

    first = let(lines_of(F.col("md")), lambda ls: F.get(F.filter(heads_of(ls), lambda h: (h["level"] == 1) & (h["title"] != "")), F.lit(0))["title"])
    title = F.coalesce(first, fallback) if fallback is not None else first
    rows = docs.select("doc_id", title.alias("doc_title"), let(T.stripped(F.col("md")), whole).alias("p"))
    each = rows.select("doc_id", "doc_title", "p.mode", "p.total_words", F.size("p.sections").cast("long").alias("total"), F.explode("p.sections").alias("s"))
    return each.select("doc_id", "mode", "total_words", "doc_title", "total", "s.pos", "s.title", "s.level", "s.body", T.word_count(F.col("s.body")).alias("word_count"))
