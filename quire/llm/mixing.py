"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size says how often each of its documents is taken. The whole part is taken for certain; for the
rest, each document has an inclusion probability of its own: the source's missing part times the square root of the document's
size over the source's mean of it, so that longer documents are likelier (`lean` is the power; 0 makes all alike). Documents are
ranked by random odds over inclusion odds, those of probability 1 first, and the lowest ranks are taken until the source's words are
reached: a sample of fixed size in words. Random numbers come from a hash of the document, so reruns agree.

Defined cases: null text has no words; a null source is a source, last in order; sources without words have
target 0 and take nothing; an empty table gives no rows; equal rows share a random number and are interchangeable;
extra columns of the input are ignored. Work by source is done on sums by rank interval, so that a source
with a third of all rows is not ordered in one task, and sources are numbered by range, so that they may be very many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import offsets, partitions, sized_side, stash, unit, word_count, wrapped

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BINS = 4096
LEAN = 0.5


def numbered(sums: DataFrame) -> DataFrame:
    """sums, stored, with place: the number, from 0, of each source by code point, null last. Dealt by ranges of the source."""
    key = F.struct(F.col("source").isNull().alias("null"), "source")
    ranged = stash(sums.repartitionByRange(partitions(sums.sparkSession), key).withColumn("_range", F.spark_partition_id()))
    first = offsets(ranged.groupBy("_range").agg(F.count("*").alias("n")), [], ["_range"], "n", "_before").drop("n")  # a row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return stash(ranged.withColumn("_own", own).join(F.broadcast(first), "_range").withColumn("place", F.col("_before") + F.col("_own") - 1).drop("_range", "_own", "_before"))


def targets(sums: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sums (source, source_size) with target: a row for each source.

    Every source gets its weight times a common level, or `most` times its size where that is less. The level is found on sums:
    while sources are over their bound at the level, what they leave raises it for the others.
    """
    rows = numbered(sums).withColumn("weight", F.get(F.lit(list(weights)), (F.col("place") % len(weights)).cast("int")).cast("double")).withColumn("_cap", most * F.col("source_size"))
    goal, level = share * (rows.agg(F.sum("source_size")).first()[0] or 0), 0.0
    while True:  # the level only rises, and each step fills one source more at least
        full = F.col("_cap") <= F.col("weight") * F.lit(level)
        caps, free = rows.agg(F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        if not free or (goal - caps) / free <= level:
            break
        level = (goal - caps) / free
    return rows.withColumn("target", F.least("_cap", F.col("weight") * F.lit(level))).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7, bins: int = BINS, lean: float = LEAN) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, copies, taken: a row for each document."""
    rows = stash(
        docs.select(docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"), F.xxhash64(docs["text"]).alias("text_hash"), word_count(docs["text"]).alias("size"))
    )
    lean_size = F.pow(F.col("size").cast("double"), F.lit(float(lean)))
    # the missing part is spread by size: the sum of probability times size over a source is what it still needs
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(lean_size * F.col("size")).alias("_leaning"))
    goal = targets(sums.select("source", "source_size"), weights, share, most)
    goal = goal.join(sums.select(F.col("source").alias("_s"), "_leaning"), goal["source"].eqNullSafe(F.col("_s"))).drop("_s")
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = stash(
        goal.withColumn("_whole", F.floor(per + 1e-12).cast("long"))
        .withColumn("_need", F.greatest(F.col("target") - F.col("_whole") * F.col("source_size"), F.lit(0.0)))
        .withColumn("_scale", F.when(F.col("_leaning") > 0, F.col("_need") / F.col("_leaning")).otherwise(0.0))
        .drop("_leaning")
        .withColumnRenamed("source", "_of")
    )
    u = unit(F.lit(seed), F.col("doc_id"), F.col("text_hash"))
    ranked = (
        rows.join(sized_side(goal), rows["source"].eqNullSafe(goal["_of"]))
        .withColumn("odds", F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("_scale") * lean_size)))
        .withColumn("_u", u)
        .withColumn("rank_odds", F.col("_u") / (1 - F.col("_u")) / (F.col("odds") / (1 - F.col("odds"))))
        .withColumn("_bin", F.floor(F.lit(bins) * F.col("rank_odds") / (1 + F.col("rank_odds"))).cast("int"))  # intervals of rank
    )
    reached = Window.partitionBy("_of").orderBy("_bin")
    cut = (
        ranked.groupBy("_of", "_bin").agg(F.sum("size").alias("_words"), F.first("_need").alias("_need"))
        .withColumn("_upto", F.sum("_words").over(reached))
        .filter(F.col("_upto") > F.col("_need"))
        .groupBy("_of").agg(F.min_by(F.struct("_bin", (F.col("_upto") - F.col("_words")).alias("have")), "_bin").alias("_cut"))
        .withColumnRenamed("_of", "_cut_of")
    )
    placed = ranked.join(cut, ranked["_of"].eqNullSafe(cut["_cut_of"]), "left").drop("_cut_of")
    inner = F.col("_cut").isNotNull() & (F.col("_bin") == F.col("_cut._bin"))
    order = Window.partitionBy("_of").orderBy("rank_odds", "doc_id")
    sums = F.col("_cut.have") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    edge = placed.filter(inner).withColumn("_extra", (sums - F.col("size") / 2 <= F.col("_need")).cast("long"))
    rest = placed.filter(~inner).withColumn("_extra", (F.col("_cut").isNull() | (F.col("_bin") < F.col("_cut._bin"))).cast("long"))
    first = stash(rest.unionByName(edge).withColumn("_extra", F.when(F.col("_need") > 0, F.col("_extra")).otherwise(0)))

    # one document more, or one less, where that brings a source nearer to its words
    gaps = first.groupBy("_of").agg((F.max("_need") - F.sum(F.col("size") * F.col("_extra"))).alias("_gap")).withColumnRenamed("_of", "_gap_of")
    near = first.join(gaps, first["_of"].eqNullSafe(gaps["_gap_of"]))
    change = F.when(F.col("_extra") == 0, F.col("size")).otherwise(-F.col("size"))
    off = F.abs(F.col("_gap") - change)
    pick = (
        near.filter((off < F.abs(F.col("_gap"))) & ((F.col("_extra") == 1) | (F.col("_whole") < most)))
        .groupBy("_gap_of").agg(F.min(F.struct(off.alias("off"), "rank_odds", "doc_id", "text_hash")).alias("_pick"))
        .select(F.col("_gap_of").alias("_pick_of"), "_pick")
    )
    # of equal rows only the whole group could be told apart from one, so a pick must be a single row
    pick = pick.join(rows.groupBy("doc_id", "text_hash").count().filter("count = 1").drop("count").alias("s"), (F.col("_pick.doc_id") == F.col("s.doc_id")) & F.col("_pick.text_hash").eqNullSafe(F.col("s.text_hash")), "left_semi")
    done = first.join(pick, first["_of"].eqNullSafe(pick["_pick_of"]), "left")
    hit = F.coalesce((F.col("_pick.doc_id") == F.col("doc_id")) & F.col("_pick.text_hash").eqNullSafe(F.col("text_hash")), F.lit(False))
    copies = F.col("_whole") + F.when(hit, 1 - F.col("_extra")).otherwise(F.col("_extra"))
    return done.select("doc_id", "source", "text_hash", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def keep(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes its document; documents without words have no size and stay once."""
    mixed = stash(mix(docs, **options).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("copies")).alias("each")))
    once = mixed.select(F.xxhash64("doc_id", "text_hash").alias("_row"), F.element_at("each", 1).alias("least"), F.size("each").alias("rows"), F.aggregate("each", F.lit(0).cast("long"), lambda a, x: a + x).alias("all"))
    side = sized_side(stash(once.filter((F.col("rows") > 1) | (F.col("least") != 1))))
    marked = wrapped(docs, "doc_id", "text").withColumn("_size", word_count(F.col("text"))).withColumn("_mine", F.xxhash64("doc_id", F.xxhash64("text")))
    joined = marked.join(side, F.col("_mine") == F.col("_row"), "left")
    # repeated rows share their copies: one row stands for all of them
    single = joined.filter(F.col("rows").isNull() | (F.col("rows") == 1))
    repeated = joined.filter(F.col("rows") > 1).dropDuplicates(["_mine"])
    times = F.when(F.col("_size") == 0, F.coalesce("rows", F.lit(1)).cast("long")).otherwise(F.coalesce(F.col("all"), F.lit(1).cast("long")))
    return single.unionByName(repeated).select("row", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select("row.*")
