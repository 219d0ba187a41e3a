"""Windowed aggregation that runs the same on a table and on a stream of it (an extra of this library)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts and sums of `value` per window and key; late rows beyond the watermark are dropped by a stream."""
    rows = df.withColumn("_time", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_time", late) if late else rows
    out = rows.groupBy(F.window("_time", width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("bin"), *keys, "n", "total")


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, late: str | None = None) -> DataFrame:
    """Rows of both sides with the same key whose right time is at most `within` behind the left one;
    of tables or of two streams, which keep rows no longer than the watermarks (`late`) and the
    interval demand.  Columns must differ but for the key."""
    a, b = left.withColumn("_left", F.col(left_time).cast("timestamp")), right.withColumn("_right", F.col(right_time).cast("timestamp"))
    if late:
        a, b = a.withWatermark("_left", late), b.withWatermark("_right", late)
    b = b.withColumnRenamed(key, "_key")
    near = (F.col("_right") >= F.col("_left")) & (F.col("_right") <= F.col("_left") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (a[key] == b["_key"]) & near, "inner").drop("_left", "_right", "_key")


def sessions(df: DataFrame, time: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    rows = df.withColumn("_time", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_time", late) if late else rows
    out = rows.groupBy(F.session_window("_time", gap), key).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").cast("timestamp_ntz").alias("began"), key, "n")
