"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that must stay together. Groups larger than 1/ITEMS of all bytes are items of their
own (there are fewer than ITEMS of them, whatever the input); all smaller groups fall by content hash into BUNDLES
bundles. Items and bundles, sorted by size, go through a heap to the least-loaded shard. What the driver sees is bounded
by ITEMS + BUNDLES rows. Slots are numbered in two levels: within (shard, hash bucket), then by the buckets' offsets.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmill.llm.common import stored, text_of

BUNDLES_PER_SHARD = 64
ROWS_PER_BUCKET = 2_000


def lpt(sizes: dict, shards: int) -> dict:
    """Item -> shard: items by falling size (ties by item), each to the least-loaded shard (ties by number)."""
    heap = [(0, k) for k in range(shards)]
    placed = {}
    for item, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, k = heap[0]
        heapq.heapreplace(heap, (load + size, k))
        placed[item] = k
    return placed


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) for every row of docs.

    size is the text's UTF-8 bytes plus overhead; null text has none and equals the empty text. Equal texts share a
    shard. A group heavier than a fair share makes its shard heavier than the others. Repeated rows and rows with a null
    doc_id are rows like any other and get slots of their own; ties in slot order are broken by size and checksum.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    bundles = shards * BUNDLES_PER_SHARD
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text.cast("binary"), 256).alias("grp"),
    )
    rows = stored(rows, "shard-rows")
    groups = rows.groupBy("grp").agg(F.sum("size").alias("size"))
    groups = groups.withColumn("bundle", F.pmod(F.xxhash64("grp"), F.lit(bundles)).cast("int"))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    big = F.col("size") > F.lit(total / bundles)
    # fewer than `bundles` groups can be that large, and there are `bundles` bundles: a bounded result
    items = groups.groupBy(F.when(big, F.col("grp")).alias("grp"), F.when(~big, F.col("bundle")).alias("bundle")).agg(F.sum("size").alias("size")).collect()
    placed = lpt({(r["grp"] or "", -1 if r["bundle"] is None else r["bundle"]): r["size"] for r in items}, shards)
    own = spark.createDataFrame([(g, k) for (g, _), k in placed.items() if g], "grp string, own_shard int")
    shared = spark.createDataFrame([(b, k) for (_, b), k in placed.items() if b >= 0], "bundle int, shared_shard int")
    bundled = rows.withColumn("bundle", F.pmod(F.xxhash64("grp"), F.lit(bundles)).cast("int"))
    put = bundled.join(F.broadcast(own), "grp", "left").join(F.broadcast(shared), "bundle", "left")
    buckets = max(1, n // (shards * ROWS_PER_BUCKET) + 1)
    put = put.select("doc_id", "size", "text_crc32", F.coalesce("own_shard", "shared_shard").alias("shard"), F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).alias("bucket"))
    counts = put.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    numbered = put.withColumn("k", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
