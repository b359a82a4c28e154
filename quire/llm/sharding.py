"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots, bytes are summed by slot, and a small versioned table says which
shard owns each slot. Rebalancing edits that table only; a record's slot never changes.

Records of equal text hash to one slot, so copies share a shard, unless the copies together outweigh a
shard's fair part or are very many: such a group is spread over slots by doc_id, and row by row where equal ids (or none)
leave it as heavy. The law is `bytes`: shards get nearly equal sums of sizes.

Defined cases: null text has no bytes and size 16; an empty table gives no rows; repeated rows are placed row
by row; extra columns of the input are ignored. Nothing is collected but totals by slot (as many as slots).
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import offsets, shared_dir, stash

SLOTS = 4096
OVERHEAD = 16
#: Rows of equal texts that always stay together, unless they outweigh a shard.
TOGETHER = 10_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and a 64-bit hash of the text."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(
        docs["doc_id"].alias("doc_id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )


def slotted(rows: DataFrame, shards: int, slots: int = SLOTS, together: int = TOGETHER) -> DataFrame:
    """rows with vslot, from 0 to slots - 1."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    fair, many = max(1, total // shards), max(together, 4 * n // slots)

    def heavy(*by: str) -> DataFrame:
        """Groups that outweigh a shard or hold very many rows: no more than shards + slots / 4 of them."""
        groups = rows.groupBy(*by).agg(F.sum("size").alias("_bytes"), F.count("*").alias("_n"))
        return F.broadcast(groups.filter((F.col("_bytes") > fair) | (F.col("_n") > many)).select(*by, F.lit(True).alias(f"_by_{by[-1]}")))

    # copies are spread by their ids; rows that repeat an id too, or have none, row by row
    placed = rows.join(heavy("text_hash"), "text_hash", "left")
    same = heavy("text_hash", "doc_id").withColumnsRenamed({"text_hash": "_text", "doc_id": "_doc"})
    placed = placed.join(same, (F.col("text_hash") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    by_id = F.when(F.col("_by_text_hash"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    by_row = F.when(F.col("_by_doc_id"), F.monotonically_increasing_id())
    return placed.withColumn("vslot", F.pmod(F.xxhash64("text_hash", by_id, by_row), F.lit(slots)).cast("int")).select(*rows.columns, "vslot")


def assign(loads: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """slot -> shard, heaviest slots first, each to the lightest shard; empty slots fill up the shards with fewest."""
    heap = [(0, 0, s) for s in range(shards)]
    owner = {}
    for slot in sorted(range(slots), key=lambda s: (-loads.get(s, 0), s)):
        load, held, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (load + loads.get(slot, 0), held + 1, shard))
    return owner


def grow(owner: dict[int, int], loads: dict[int, int], shards: int) -> dict[int, int]:
    """The map edited for one more shard: slots move to the new shard only, until it has its part."""
    have: dict[int, list[int]] = {s: [] for s in range(shards)}
    weight = dict.fromkeys(range(shards), 0)
    for slot, shard in owner.items():
        have[shard].append(slot)
        weight[shard] += loads.get(slot, 0)
    goal, new, moved = sum(weight.values()) / (shards + 1), 0, dict(owner)
    for shard in have.values():
        shard.sort(key=lambda s: (loads.get(s, 0), s))
    while new < goal:
        giver = max(weight, key=lambda s: (weight[s], -s))
        slot = next((s for s in reversed(have[giver]) if loads.get(s, 0) and new + loads[s] <= goal * 1.02), None)
        if slot is None:
            break
        have[giver].remove(slot)
        moved[slot], new = shards, new + loads[slot]
        weight[giver] -= loads[slot]
    return moved


def save_map(spark: SparkSession, owner: dict[int, int], path: str, version: int) -> None:
    rows = ",".join(f"({k},{v})" for k, v in sorted(owner.items()))
    spark.sql(f"SELECT * FROM VALUES {rows} AS t(vslot, shard)").coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def rebalance(rows: DataFrame, path: str, version: int, shards: int) -> DataFrame:
    """Reads the map of a version, gives one more shard its part of rows' bytes (vslot, size) and writes the next version."""
    spark = rows.sparkSession
    owner = {r.vslot: r.shard for r in load_map(spark, path, version).collect()}  # `slots` rows
    loads = {r.vslot: r.b for r in rows.groupBy("vslot").agg(F.sum("size").alias("b")).collect()}
    save_map(spark, grow(owner, loads, shards), path, version + 1)
    return load_map(spark, path, version + 1)


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, map_path: str | None = None, version: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard, from 0), grown_shard, vslot.

    With a version, the stored map of it is used; without one, version 1 is made and written.
    """
    spark = docs.sparkSession
    rows = stash(slotted(stash(sized(docs)), shards, slots))
    path = map_path or f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    if version is None:
        loads = {r.vslot: r.b for r in rows.groupBy("vslot").agg(F.sum("size").alias("b")).collect()}  # `slots` rows at most
        save_map(spark, assign(loads, shards, slots), path, 1)
    owner = F.broadcast(load_map(spark, path, version or 1))  # `slots` rows
    first = offsets(rows.groupBy("vslot").agg(F.count("*").alias("n")).join(owner, "vslot"), ["shard"], ["vslot"], "n", "before")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_hash"))
    return (
        rows.withColumn("_place", place)
        .join(F.broadcast(first.select("vslot", "shard", "before")), "vslot")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("before") + F.col("_place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot",
        )
    )
