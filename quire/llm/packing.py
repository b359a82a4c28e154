"""Packing into length buckets of least padding.

The global histogram of lengths goes to a dynamic program that chooses bucket boundaries of least total
padding; inside each bucket, batches hold as many documents as a token budget allows at the bucket's padded length.

Lengths are counted in words, or in the tokens of a tokenizer file that every executor can read. The histogram is exact up to `fine` and then in steps of 1/64 of the length, rounded
up, so its size grows with the logarithm of the longest document alone; boundaries are exact maxima
of the documents in a bin.

Defined cases: null and empty texts have length 0 and share a first bucket of length 0; a document longer than the
budget has a batch of its own; an empty table gives no rows; equal lengths are batched in the order of a
hash; extra columns are ignored by `pack`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import offsets, partitions, stash, word_count
from quire.llm.shingling import slices

BUCKETS = 16
BUDGET = 65_536
FINE = 1024


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds, rising, of at most `buckets` buckets: least sum of (bound - length), by dynamic programming."""
    order = np.argsort(np.asarray(lengths, dtype=np.int64))
    x, c = np.asarray(lengths, dtype=np.float64)[order], np.asarray(counts, dtype=np.float64)[order]
    n = len(x)
    if not n:
        return []
    before = np.concatenate([[0.0], np.cumsum(c)])  # documents in the bins before
    best = x * before[1:]  # one bucket up to each bin; the sum of lengths is the same for every choice
    back: list[np.ndarray] = []
    for _ in range(1, min(buckets, n)):
        # cost[j, i]: bins up to j as before, j+1..i in one bucket more
        cost = np.where(np.arange(n)[:, None] < np.arange(n)[None, :], best[:, None] + x[None, :] * (before[None, 1:] - before[1:, None]), np.inf)
        pick = cost.argmin(axis=0)
        step = cost[pick, np.arange(n)]
        keep = best <= step
        back.append(np.where(keep, -1, pick))
        best = np.where(keep, best, step)
    out, i = [], n - 1
    for pick in reversed(back):
        if pick[i] >= 0:
            out.append(int(x[i]))
            i = int(pick[i])
    out.append(int(x[i]))
    return sorted(out)


def histogram(lengths: DataFrame, fine: int = FINE) -> tuple[list[int], list[int]]:
    """Greatest length and number of documents of each bin."""
    n = F.col("tokens")
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(fine)).cast("double") / 64)))
    coarse = F.when(n <= fine, n.cast("double")).otherwise(F.ceil(n / step) * step)
    rows = lengths.groupBy(coarse.alias("_bin")).agg(F.max("tokens").alias("m"), F.count("*").alias("c")).collect()  # a bounded number of bins
    return [r.m for r in rows], [r.c for r in rows]


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, tokens, _h, by the tokenizer file (JSON) at the path."""
    kind = dict(docs.dtypes)["doc_id"]

    def each(batches):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for b in (x for whole in batches for x in slices(whole)):
            n = [len(e.ids) for e in t.encode_batch([x or "" for x in b.column("text").to_pylist()], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), b.column("_h")], ["doc_id", "tokens", "_h"])

    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), F.xxhash64(docs["doc_id"], docs["text"]).alias("_h"))
    return rows.mapInArrow(each, f"doc_id {kind}, tokens long, _h long")


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, fine: int = FINE, tokenizer: str | None = None) -> DataFrame:
    """doc_id, tokens, bucket, bucket_tokens, batch (from 0 in its bucket), place (in its batch): a row for each document."""
    spark = docs.sparkSession
    counted = docs.select(docs["doc_id"].alias("doc_id"), word_count(docs["text"]).alias("tokens"), F.xxhash64(docs["doc_id"], docs["text"]).alias("_h"))
    rows = stash(token_counts(docs, tokenizer) if tokenizer else counted)
    edges = boundaries(*histogram(rows, fine), buckets)
    cells = 4 * partitions(spark)
    bound = F.lit(edges) if edges else F.lit([0])
    bucket = F.size(F.filter(bound, lambda e: e < F.col("tokens"))) if edges else F.lit(0)
    rows = rows.withColumn("bucket", bucket).withColumn("bucket_tokens", F.get(bound, F.col("bucket")).cast("long")).withColumn("_cell", F.pmod("_h", F.lit(cells)))
    first = offsets(rows.groupBy("bucket", "_cell").agg(F.count("*").alias("n")), ["bucket"], ["_cell"], "n", "before").drop("n")
    place = F.row_number().over(Window.partitionBy("bucket", "_cell").orderBy("_h", "doc_id")) - 1
    at = F.col("before") + F.col("_at")
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1)))).cast("long")
    return (
        rows.withColumn("_at", place)
        .join(first, ["bucket", "_cell"])
        .select("doc_id", "tokens", "bucket", "bucket_tokens", F.floor(at / room).cast("long").alias("batch"), (at % room).cast("long").alias("place"))
    )
