"""Quality by importance resampling.

Two generative models over hashed n-grams (words and word pairs; four bytes in a row), one of target text (labelled
good, not toxic) and one of all documents, give each document the log ratio of its probabilities, taken at a
standard length so that long documents are not favoured. Gumbel noise added to it turns the top k into a sample without
replacement by importance.

At most `sample` labelled rows are used (those of smallest hash): two thirds fit the target model, the others choose the
ratio that best parts good from bad; among these, toxic rows of good quality count as neither, for they read like good text but
for single words. The other model counts every document, and k is the number of documents above that ratio. Texts are counted
a run of n-grams at a time, also inside one text, so that a worker's arrays do not grow with the longest document.

Defined cases: null and empty texts, and texts without words, have ratio 0 for want of evidence (n_grams 0) and are
rejected; labels without documents are ignored, a document labelled twice counts by its best label; without
labels of both kinds nothing is rejected but texts without words; repeated rows share a score and are chosen or
rejected together, so that the k-th may bring more than k; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import keyed, sized_side, stash, top, unit, wrapped
from quire.llm.shingling import RUN, mixed, slices, word_hashes

BUCKETS = 1 << 16
SAMPLE = 20_000
LENGTH = 512


def grams(texts: pa.Array, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, bucket, owner), a run at a time: kind 0 for words and pairs of neighbouring words, kind 1 (buckets further on) for four
    bytes in a row. Runs are cut within a text too, so that the arrays do not grow with it."""
    m = np.uint64(buckets)
    h, start = word_hashes(texts)
    for a in range(0, len(h), RUN):
        own = owners(start, a, min(a + RUN + 1, len(h)))
        one, after = h[a : a + RUN], h[a + 1 : a + RUN + 1]
        pair = own[: len(after)] == own[1 : len(after) + 1]
        two = mixed(one[: len(after)] * np.uint64(3) + after)[pair]
        yield 0, (np.concatenate([mixed(one), two]) % m).astype(np.int64), np.concatenate([own[: len(one)], own[: len(after)][pair]])
    del h
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    start = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if start[-1] else np.zeros(0, np.uint8)
    for a in range(int(start[0]), int(start[-1]) - 3, RUN):
        end = min(a + RUN + 3, int(start[-1]))
        x, own = data[a:end].astype(np.uint32), owners(start, a, end)
        whole = own[:-3] == own[3:]
        four = (x[:-3] | x[1:-2] << 8 | x[2:-1] << 16 | x[3:] << 24)[whole]
        yield 1, (mixed(four.astype(np.uint64)) % m).astype(np.int64) + buckets, own[:-3][whole]


def owners(start: np.ndarray, a: int, end: int) -> np.ndarray:
    """Of each place from a to end, which of the texts that begin at start it lies in."""
    return np.repeat(np.arange(len(start) - 1), np.diff(np.clip(start, a, end)))


def joined(runs: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, owner) of runs put together until they are worth a pass over the counts."""
    held, size = [], 0
    for _, x, owner in runs:
        held.append((x, owner))
        size += len(x)
        if size >= RUN:
            yield tuple(np.concatenate(z) for z in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(z) for z in zip(*held))


def counts(rows: DataFrame, buckets: int) -> DataFrame:
    """bucket, raw, target: counts over all rows, and over those whose good is 1."""

    def each(batches):
        raw, target = np.zeros(2 * buckets, np.int64), np.zeros(2 * buckets, np.int64)
        for b in (x for whole in batches for x in slices(whole)):
            good = b.column("good").fill_null(0).to_numpy(zero_copy_only=False) == 1
            for x, owner in joined(grams(b.column("text"), buckets)):
                raw += np.bincount(x, minlength=2 * buckets)
                if (mine := good[owner]).any():
                    target += np.bincount(x[mine], minlength=2 * buckets)
        at = np.flatnonzero(raw)
        for i in range(0, len(at), 50_000):
            k = at[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(raw[k]), pa.array(target[k])], ["bucket", "raw", "target"])

    parts = rows.select("text", "good").mapInArrow(each, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratio(model: pa.Table, buckets: int) -> np.ndarray:
    """Log of target over raw probability by bucket, one added to every count. `model` has two rows a bucket at most."""
    raw, target = np.ones(2 * buckets), np.ones(2 * buckets)
    at = model["bucket"].to_numpy()
    raw[at] += model["raw"].to_numpy()
    target[at] += model["target"].to_numpy()
    raw, target = raw.reshape(2, buckets), target.reshape(2, buckets)
    return np.log(target / target.sum(axis=1)[:, None] / (raw / raw.sum(axis=1)[:, None])).ravel().astype(np.float32)


def threshold(good: np.ndarray, bad: np.ndarray, dear: float = 5.0) -> float | None:
    """The ratio below which labelled bad most exceed `dear` times labelled good (as parts of their kind)."""
    if not len(good) or not len(bad):
        return None
    x = np.unique(np.concatenate([good, bad]))
    gain = np.searchsorted(np.sort(bad), x) / len(bad) - dear * np.searchsorted(np.sort(good), x) / len(good)
    best = int(gain.argmax())
    return float((x[best] + x[max(best - 1, 0)]) / 2)


def score(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, sample: int = SAMPLE, length: int = LENGTH, seed: int = 11) -> DataFrame:
    """doc_id, _id, _h, held, n_grams, log_ratio, key, chosen: a row for each document."""
    spark = docs.sparkSession
    fine, toxic = F.max((labels["quality"] == 1).cast("int")), F.max(F.coalesce(labels["toxic"], F.lit(0)))
    picked = labels.filter(labels["doc_id"].isNotNull() & labels["quality"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("_lid")).agg(fine.alias("_fine"), toxic.alias("_toxic"))
    picked = picked.orderBy(F.xxhash64(F.lit(seed), "_lid"), "_lid").limit(sample)  # at most `sample` rows
    apart = F.pmod(F.xxhash64(F.lit(seed + 1), "_lid"), F.lit(3)) == 0  # a third, to choose the threshold by
    good = ((F.col("_fine") == 1) & (F.col("_toxic") == 0)).cast("int")
    # toxic rows of good quality are no target text, but do not tell where junk begins either
    held = F.when((F.col("_fine") == 0) | (F.col("_toxic") == 0), F.col("_fine"))
    picked = picked.select("_lid", F.when(~apart, good).alias("good"), F.when(apart, held).alias("held"))
    rows = keyed(docs.select("doc_id", "text")).join(F.broadcast(picked), F.col("_id") == F.col("_lid"), "left").drop("_lid")
    weights = spark.sparkContext.broadcast(log_ratio(counts(rows, buckets).toArrow(), buckets))

    def each(batches):
        w = weights.value
        for b in (x for whole in batches for x in slices(whole)):
            total, n = np.zeros((2, b.num_rows)), np.zeros((2, b.num_rows), np.int64)
            for kind, x, owner in grams(b.column("text"), buckets):
                n[kind] += np.bincount(owner, minlength=b.num_rows)
                total[kind] += np.bincount(owner, weights=w[x], minlength=b.num_rows)
            ratio = (total / np.maximum(n, 1)).sum(0) * (length / 2)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "_id", "_h", "held")), pa.array(n[0]), pa.array(np.where(n[0] > 0, ratio, 0.0))], ["doc_id", "_id", "_h", "held", "n_grams", "log_ratio"])

    noise = -F.log(-F.log(unit(F.lit(seed), F.col("_h"))))
    kind = dict(docs.dtypes)["doc_id"]
    scored = stash(rows.mapInArrow(each, f"doc_id {kind}, _id long, _h long, held int, n_grams long, log_ratio double").withColumn("key", F.when(F.col("n_grams") > 0, F.col("log_ratio") + noise).otherwise(float("-inf"))))
    known = scored.filter("held is not null and n_grams > 0").groupBy("_id").agg(F.max("held").alias("held"), F.min("log_ratio").alias("log_ratio")).toArrow()  # at most `sample` rows
    of = known["held"].to_numpy()
    cut = threshold(known["log_ratio"].to_numpy()[of == 1], known["log_ratio"].to_numpy()[of == 0])
    k = scored.filter((F.col("n_grams") > 0) & (F.col("log_ratio") >= F.lit(float("-inf") if cut is None else cut))).count()
    return top(scored, "key", k, "_h")


def op9_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels).select("doc_id", "n_grams", F.round("log_ratio", 4).alias("log_ratio"), F.round("key", 4).alias("key"), "chosen")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier chooses, with all their columns."""
    gone = sized_side(stash(score(docs, labels).filter(~F.col("chosen")).select("_id", "_h").distinct()))
    return keyed(wrapped(docs, "doc_id", "text")).join(gone, ["_id", "_h"], "left_anti").select("row.*")
