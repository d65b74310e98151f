"""Streams: replayed sources, watermarked windows, and sinks."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import checkpoint_dir, materialised, removed

WATERMARK = "10 seconds"
#: Rows of a trigger: an instrument's share of them is one frame of a Python worker.
ROWS_A_PART = 4_000_000


def replay(df: DataFrame, parts: int = 3, stamp: str = "us", rows_a_file: int = 1_000_000) -> DataFrame:
    """A table as a stream of its own time-ordered parts, one part a trigger.

    The cuts are quantiles of the stamp, so parts are even. Each part is written before the next,
    as a fixed number of files that grows with the table, and a trigger takes that many files. A large
    table has more parts, so a trigger's rows are bounded. ``df`` is computed once and dealt into parts
    once: no part reads the whole table again.
    """
    spark = df.sparkSession
    df = materialised(df)
    rows = df.count()
    parts = max(parts, math.ceil(rows / ROWS_A_PART))
    path = f"{checkpoint_dir(spark)}/replay-{uuid.uuid4().hex}"
    edges = df.approxQuantile(stamp, [k / parts for k in range(1, parts)], 0.001)
    files = max(1, math.ceil(rows / parts / rows_a_file))
    number = sum(((F.col(stamp) > edge).cast("int") for edge in edges), F.lit(0))
    df.withColumn("_part", number).write.partitionBy("_part").parquet(f"{path}-dealt")
    dealt = spark.read.schema(df.withColumn("_part", number).schema).parquet(f"{path}-dealt")
    for k in range(parts):
        part = dealt.filter(F.col("_part") == k).drop("_part")
        part.repartition(files).write.mode("append").parquet(path)
    removed(spark, f"{path}-dealt")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def drained(stream: DataFrame, mode: str = "append", typed: bool = False) -> DataFrame:
    """Run a stream over everything there is, into Parquet, and read what it wrote.

    ``typed`` runs it on the state store that typed state and timers need.
    """
    spark = stream.sparkSession
    if typed:
        before = spark.conf.get(PROVIDER)
        spark.conf.set(PROVIDER, ROCKS)
        try:
            return drained(stream, mode)
        finally:
            spark.conf.set(PROVIDER, before)
    path = f"{checkpoint_dir(spark)}/sink-{uuid.uuid4().hex}"
    run = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{path}-checkpoint")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def recorded(stream: DataFrame, path: str) -> DataFrame:
    """Write a stream to day folders and read them back."""
    run = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{path}-checkpoint")
        .partitionBy("day")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def stamped(stream: DataFrame, delay: str = WATERMARK) -> DataFrame:
    return stream.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", delay)


def bars(stream: DataFrame, width: str, delay: str = WATERMARK) -> DataFrame:
    """Closed bars: emitted once the watermark has passed their end."""
    stamp = F.struct("us", "trade_id")
    out = stamped(stream, delay).groupBy("symbol", F.window("ts", width)).agg(
        F.min_by("price", stamp).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", stamp).alias("close"),
        F.sum("size").alias("volume"),
    )
    return out.select("symbol", F.unix_micros("window.end").alias("us"), "open", "high", "low", "close", "volume")


def sliding_stats(stream: DataFrame, width: str, step: str, delay: str = WATERMARK) -> DataFrame:
    """Additive trade statistics over sliding windows."""
    out = stamped(stream, delay).groupBy("symbol", F.window("ts", width, step)).agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum("size").alias("volume"),
        F.sum(F.col("aggressor") * F.col("size")).alias("signed"),
        F.sum(F.col("price") * F.col("size")).alias("notional"),
    )
    return out.select("symbol", F.unix_micros("window.end").alias("us"), "trades", "volume", "signed", "notional")


def deduplicated(stream: DataFrame, keys: list[str], delay: str = WATERMARK) -> DataFrame:
    """One row per key inside the watermark; later ones than that are dropped as late."""
    return stamped(stream, delay).dropDuplicatesWithinWatermark(keys).drop("ts")


def sessions(stream: DataFrame, gap: str, delay: str = WATERMARK) -> DataFrame:
    """Stretches without a pause longer than ``gap``: what lies between them is a gap."""
    out = stamped(stream, delay).groupBy("symbol", F.session_window("ts", gap)).agg(
        F.count(F.lit(1)).alias("events"), F.min("us").alias("first_us"), F.max("us").alias("last_us")
    )
    return out.select("symbol", "events", "first_us", "last_us")


