"""Sharding by longest-processing-time scheduling of groups that stay together.

Rows with equal texts form a group.  Groups of at least 1/LARGE_PARTS of all
bytes are scheduled singly; the others, of which there can be billions, are
first dealt by hash into BUNDLES bundles.  At most LARGE_PARTS + BUNDLES items,
sorted by size, then go one by one to the least loaded shard through a heap, so
that the driver's part is bounded whatever the input.

Defined results: a null text has size 1 and crc 0 and is grouped with empty
ones; equal sizes are ordered by item name; repeated rows each get a slot; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.store import table, written

SHARDS = 16
BUNDLES = 1 << 14
LARGE_PARTS = 1 << 13
#: Rows of a shard that are numbered together.
CELL_ROWS = 1024


def schedule(items: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Longest first, each to the shard with the least load (ties: smaller shard)."""
    heap = [(0, s) for s in range(shards)]
    at = {}
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        at[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return at


def shard_documents(docs: DataFrame, shards: int = SHARDS, bundles: int = BUNDLES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; groups of equal texts share a shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group")), "shard-rows")
    bundle = F.pmod(F.xxhash64("group"), F.lit(bundles)).cast("string")
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    item = F.when(F.col("size") * LARGE_PARTS >= F.lit(total), F.hex("group")).otherwise(bundle).alias("item")
    items = groups.select(item, "size").groupBy("item").agg(F.sum("size").alias("size"))
    at = schedule([(r["item"], r["size"]) for r in items.collect()], shards)  # at most LARGE_PARTS + bundles rows
    # at most LARGE_PARTS + bundles rows: broadcast
    large = spark.createDataFrame([(bytearray.fromhex(k), v) for k, v in at.items() if len(k) == 64], "group binary, _large int")
    dealt = spark.createDataFrame([(k, v) for k, v in at.items() if len(k) < 64], "_bundle string, _shard int")
    placed = rows.withColumn("_bundle", bundle).join(F.broadcast(large), "group", "left").join(F.broadcast(dealt), "_bundle", "left")
    placed = placed.select("doc_id", "size", "text_crc32", F.coalesce("_large", "_shard").alias("shard"))
    return numbered(placed, "shard")


def numbered(rows: DataFrame, part: str) -> DataFrame:
    """``slot``: a gapless number from 0 in each part, got from counts of small cells and numbers inside them."""
    count = rows.count()
    cells = max(1, count // CELL_ROWS)
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)))
    sizes = rows.groupBy(part, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    # prefix sums in two steps, so that no task sees all cells of a part once there are many
    sizes = sizes.withColumn("_run", F.expr(f"_cell div {CELL_ROWS}"))
    runs = sizes.groupBy(part, "_run").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy(part).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(part, "_run", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(part, "_run").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, "_run", "_cell", F.coalesce(F.sum("_n").over(inner), F.lit(0)).alias("_in")).join(runs, [part, "_run"]).select(part, "_cell", (F.col("_base") + F.col("_in")).alias("_start"))
    inside = Window.partitionBy(part, "_cell").orderBy("doc_id", "text_crc32")
    return rows.withColumn("_rank", F.row_number().over(inside)).join(starts, [part, "_cell"]).withColumn("slot", (F.col("_start") + F.col("_rank") - 1).cast("long")).drop("_cell", "_rank", "_start")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
