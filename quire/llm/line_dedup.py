"""Line dedup: later repeats of runs of lines are deleted.

A window is the least run of lines from a line on, or up to a line, that has `least` words. Winnowing selects fingerprints:
of each window the least line hash, with its place. Two copies of a run of `least` words or more hold equal windows, so both
have the same fingerprints at the same places of the run. Fingerprints are joined by hash; those found at one place only go no further.
From each place of a shared fingerprint the match is extended both ways over the windows that it was selected from, and compared with the
first place where the same lines stand around the same fingerprint. Windows up to a line reach a run's closing
lines as those from a line on reach its opening ones, so all of a repeated run goes: a line is deleted just when it lies in a run of
`least` words or more that stood before, in the order of doc_id and line. Its first occurrence always stays. Built-in functions only.

Defined cases: null text stays null and blank lines belong to no window (those inside a deleted run go with it); lines
are compared without white space at their ends; rows equal in doc_id and text count as one document and are edited
alike; null ids are last in order; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import SMALL, keyed, stash, word_count, wrapped

LEAST = 32


def fingerprints(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """_id, _h, mark, place, around: a row for each selected line, with its hash, its number and the windows (run: hash of the
    lines; first, last: numbers of lines) that it was selected from."""
    line = lambda x: F.struct(F.xxhash64(F.trim(F.regexp_replace(x, r"^[\x09-\x0D]+|[\x09-\x0D]+$", ""))).alias("lh"), word_count(x).cast("int").alias("w"))
    # repeated rows are one document; only hashes and counts of lines are dealt out
    once = keyed(docs).select("_id", "_h", F.transform(F.split("text", "\n"), line).alias("lines")).filter("lines is not null").groupBy("_id", "_h").agg(F.first("lines").alias("lines"))
    rows = once.select("_id", "_h", F.posexplode("lines").alias("pos", "line")).select("_id", "_h", "pos", "line.lh", "line.w").filter("w > 0")
    rows = rows.withColumn("e", F.sum("w").over(Window.partitionBy("_id", "_h").orderBy("pos"))).withColumn("s", F.col("e") - F.col("w"))
    ahead = Window.partitionBy("_id", "_h").orderBy("s").rangeBetween(0, least - 1)
    back = Window.partitionBy("_id", "_h").orderBy("e").rangeBetween(1 - least, 0)
    windows = [
        F.when(
            F.sum("w").over(w) >= least,
            F.struct(F.min(F.struct("lh", "pos")).over(w).alias("mark"), F.xxhash64(F.collect_list("lh").over(w)).alias("run"), F.min("pos").over(w).alias("first"), F.max("pos").over(w).alias("last")),
        )
        for w in (ahead, back)
    ]
    found = rows.select("_id", "_h", F.array(*windows).alias("each")).select("_id", "_h", F.explode(F.filter("each", lambda w: w.isNotNull())).alias("w"))
    return found.groupBy("_id", "_h", F.col("w.mark.lh").alias("mark"), F.col("w.mark.pos").alias("place")).agg(F.collect_set(F.struct("w.run", "w.first", "w.last")).alias("around"))


def repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """_id, _h, gone (line numbers from 0): a row for each document that loses lines."""
    found = stash(fingerprints(docs, least))
    at = F.struct("_id", "_h", "place")
    shared = stash(found.groupBy("mark").agg(F.min(at).alias("a"), F.max(at).alias("b")).filter("a <> b").select("mark"))
    # both ways from each place of a shared fingerprint
    matched = stash(found.join(shared, "mark", "left_semi").select("_id", "_h", "mark", F.explode("around").alias("w")).select("_id", "_h", "mark", "w.*"))
    before = F.struct((F.col("_id") == F.lit(-(1 << 63))).alias("unknown"), "_id", "_h", "first")
    origin = stash(matched.groupBy("mark", "run").agg(F.min(before).alias("origin"), F.max(before).alias("final")).filter("origin <> final").drop("final"))
    later = matched.join(origin, ["mark", "run"]).filter(before != F.col("origin"))
    return later.groupBy("_id", "_h").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("first", "last")))).alias("gone"))


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with text without its repeated lines, and n_lines, n_deleted (0 for null texts; they replace columns of these names)."""
    out = _edited(docs, least)
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_deleted")]
    return out.select(*kept, "n_lines", "n_deleted")


def _edited(docs: DataFrame, least: int) -> DataFrame:
    """row (with the new text), n_lines, n_deleted."""
    gone = stash(repeated_lines(docs, least))
    total = gone.agg(F.count("*") + F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0]
    side = F.broadcast(gone) if total <= 4 * SMALL else gone  # a bounded number of line numbers, else a shuffle
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("gone"))
    joined = keyed(wrapped(docs, "doc_id", "text")).join(side, ["_id", "_h"], "left").withColumn("_lines", lines)
    edited = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
    return joined.withColumn("row", F.col("row").withField("text", edited)).withColumn("n_lines", F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long")).withColumn("n_deleted", F.coalesce(F.size("gone"), F.lit(0)).cast("long")).select("row", "n_lines", "n_deleted")


def keep(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with edited text and n_chars; documents of which nothing is left go."""
    out = _edited(docs, least).filter((F.col("n_deleted") == 0) | F.col("row.text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        n = F.when(F.col("n_deleted") > 0, F.char_length("row.text")).otherwise(F.col("row.n_chars")).cast(dict(docs.dtypes)["n_chars"])
        out = out.withColumn("row", F.col("row").withField("n_chars", n))
    return out.select("row.*")
