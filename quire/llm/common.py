"""What the corpus operators share: reading, durable cuts of lineage, words, exact top-k."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs of ASCII white space part words.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which all executors share. Where that is unset a local folder
    serves, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{named or 'file:///tmp/checkpoints'}/quire-{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever the session's file systems have it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder; results that are not written yet are lost."""
    remove(spark, shared_dir(spark))


#: Folders that are open for what is stashed, the innermost last (see scratch).
_OPEN: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stashed inside, without a path of its own, is deleted at the end; so a result must be written by then."""
    _OPEN.append(uuid.uuid4().hex)
    path = "/".join([shared_dir(spark), *_OPEN])
    try:
        yield
    finally:
        _OPEN.pop()
        remove(spark, path)


def fresh(spark: SparkSession) -> str:
    """A path below the shared folder that is not in use."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def stash(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written to the shared folder and read back: later stages start from the files, whichever executor is lost."""
    spark = df.sparkSession
    path = path or "/".join([shared_dir(spark), *_OPEN, uuid.uuid4().hex])
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(*cols: Column) -> Column:
    """A uniform number in (0, 1) decided by the columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def offsets(counts: DataFrame, group: list[str], order: list[str], n: str, out: str) -> DataFrame:
    """counts with, in out, the sum of n over the earlier rows of the group. Takes a table of counts, not of records."""
    w = (Window.partitionBy(*group).orderBy(*order) if group else Window.orderBy(*order)).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0).cast("long")))


def top(rows: DataFrame, key: str, k: int, tie: str, cells: int = 512) -> DataFrame:
    """rows with a boolean column chosen: the k rows of largest key (double), then of smallest tie (long).

    Only counts are gathered, never rows: quantiles cut a range of keys into cells, and the cell in which the k-th row lies is
    cut again until it is one value. Rows equal in both are chosen or not together; more than k if they stand at the end.
    """

    def last(some: DataFrame, by: Column, need: int):
        """The value of `by` (rising) of the row number `need`, and how many rows are below it."""
        low, below = None, 0
        while True:
            inside = some if low is None else some.filter(by > low)
            marks, least = inside.agg(F.percentile_approx(by, F.lit([i / cells for i in range(1, cells + 1)]), 10_000), F.min(by)).first()
            edges = sorted({least, *marks})  # with the least value, so that a cell of two values is always cut
            at = F.size(F.filter(F.lit(edges), lambda e: e < by))  # number of edges below, over a bounded list
            found = inside.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(by).alias("a"), F.max(by).alias("b")).orderBy("at").collect()  # `cells` rows and one
            for r in found:
                if below + r["n"] >= need:
                    break
                low, below = r["b"], below + r["n"]
            if r["a"] == r["b"]:
                return r["a"], below
            some = some.filter(by <= F.lit(r["b"]))

    if k <= 0:
        return rows.withColumn("chosen", F.lit(False))
    if rows.count() <= k:
        return rows.withColumn("chosen", F.lit(True))
    falls = -F.col(key)
    edge, before = last(rows, falls, k)
    here = falls == F.lit(edge)
    some = rows.filter(here)
    if some.count() == k - before:
        return rows.withColumn("chosen", falls <= F.lit(edge))
    mark, _ = last(some, F.col(tie), k - before)
    return rows.withColumn("chosen", (falls < F.lit(edge)) | here & (F.col(tie) <= F.lit(mark)))


#: Rows of a few numbers that may be sent to every executor (about 32 MB); more are joined by a shuffle.
SMALL = 500_000


def sized_side(side: DataFrame, most: int = SMALL) -> DataFrame:
    """side, stored already, with a broadcast hint where its count allows it."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def wrapped(docs: DataFrame, *names: str) -> DataFrame:
    """row (a struct of all columns, so that none can clash with a name used here) and the named columns."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *names)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _id and _h, which tell rows apart but for repeated ones."""
    return docs.withColumn("_id", F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)))).withColumn("_h", F.xxhash64(docs["doc_id"], docs["text"]))
