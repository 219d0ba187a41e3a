"""Operator 3: contiguous shards of near-equal bytes.

Documents are ordered by id (then size and checksum), in range partitions written once; the totals
of the partitions give each its global byte offset, and the shard of a document is the equal-sized
interval of the whole that holds its middle byte.  A shard then differs from the target by less
than the largest document.  Equal texts are documents like any others: the law knows sizes only.

A null text has no bytes; each document counts `overhead` bytes besides.  Null ids come first.
Repeated rows take places of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.base import durable, pick


def shard(df: DataFrame, shards: int = 24, overhead: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (the place in the shard, gapless from 0)."""
    rows = pick(df, doc_id=id_column, text=text_column).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(overhead)).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = ["doc_id", "size", "text_crc32"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(rows).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    ranged = durable(ranged)  # bounds of a range exchange are sampled: fixed before they are counted
    # one row per partition: their number is set by the session, not by the data
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("byte_start"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("row_start"),
        F.sum("part_bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.select("*", F.sum("size").over(within).alias("upto"), F.row_number().over(within).alias("nth"))
    placed = placed.join(F.broadcast(starts), "part")
    # middle byte times two, in decimals: no overflow at any size
    twice = ((F.col("byte_start") + F.col("upto")) * 2 - F.col("size")).cast("decimal(30,0)")
    number = F.floor(twice * F.lit(shards) / (F.col("all_bytes").cast("decimal(28,0)") * 2)).cast("int")
    placed = durable(placed.select(*order, F.least(number, F.lit(shards - 1)).alias("shard"), (F.col("row_start") + F.col("nth") - 1).alias("place")))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(*order, "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_shards(df: DataFrame, assigned: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """Writes the rows of df (unique ids) as Parquet, one folder a shard, in the shard's order."""
    places = assigned.select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows = df.join(places, df[id_column].eqNullSafe(F.col("_id"))).drop("_id")
    rows.repartition("_shard").sortWithinPartitions("_shard", "_slot").drop("_slot").write.partitionBy("_shard").parquet(path)
