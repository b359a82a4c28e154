"""Batch bookkeeping: destinations, selection, status, settings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def destinations_by_rank(docs: DataFrame) -> DataFrame:
    """docs (pos, slug, stem) with dest: slug for its first document, else slug-stem, then slug-stem-2, -3 ...; see distinct_names for what can still be equal."""
    first = F.row_number().over(Window.partitionBy("slug").orderBy("pos"))
    rows = docs.withColumn("_n", first).withColumn("_base", F.concat_ws("-", "slug", "stem"))
    again = F.row_number().over(Window.partitionBy("_base", F.col("_n") == 1).orderBy("pos"))
    name = F.when(F.col("_n") == 1, F.col("slug")).when(again == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", again.cast("string")))
    return rows.withColumn("dest", name).drop("_n", "_base")


#: A part of a selection: a number, or two with a dash between.
_PART = re.compile(r"(\d+)(?:-(\d+))?")


def distinct_names(docs: DataFrame) -> DataFrame:
    """docs (pos, dest) with dest made distinct: of equal names all but the first get their number, until no two are equal.

    Two are equal only where one document's slug is what another was given, so that a pass or two over the names is all.
    """
    same = Window.partitionBy("dest").orderBy("pos")
    while not docs.groupBy("dest").count().filter("count > 1").isEmpty():
        docs = docs.withColumn("_n", F.row_number().over(same)).withColumn("dest", F.when(F.col("_n") == 1, F.col("dest")).otherwise(F.concat_ws("-", "dest", F.col("_n").cast("string")))).drop("_n")
    return docs


def parse_selection(raw: str, count: int) -> list[int]:
    """Places from 0 for `3`, `1,4`, `2-6`, `6-2` or `all`; each once, in the order named. Raises ValueError."""
    if raw.strip().lower() in {"all", "a", "*"}:
        return [*range(count)]
    named: list[int] = []
    for part in re.findall(r"[^\s,]+", raw):
        m = _PART.fullmatch(part)
        if m is None:
            raise ValueError(f"{part!r} in a selection is neither a number nor a range such as 2-5")
        a, b = int(m[1]), int(m[2] or m[1])
        if min(a, b) < 1 or max(a, b) > count:
            raise ValueError(f"{part!r} in a selection names what is not listed; there are {count}")
        named += range(min(a, b) - 1, max(a, b))
    return [*dict.fromkeys(named)]


def status(results: DataFrame) -> DataFrame:
    """code: the first that is not 0, in input order (pos, code); else 0."""
    return results.agg(F.coalesce(F.min(F.when(F.col("code") != 0, F.struct("pos", "code")))["code"], F.lit(0)).alias("code"))


def unknown_keys(given: Column, known: Column) -> Column:
    return F.array_sort(F.array_except(given, known))


def listed_models(models: DataFrame, prefixes: tuple[str, ...] = ("gpt-", "o1", "o3", "o4", "chatgpt")) -> DataFrame:
    """models (id) with chat: those that converse; order by not chat, id."""
    chat = F.lit(False)
    for p in prefixes:
        chat = chat | F.col("id").startswith(p)
    return models.select("id", chat.alias("chat"))
