"""Venue messages: book snapshots and deltas, prints, and the raw message log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOOK_MESSAGE = (
    "topic string, type string, ts bigint, "
    "data struct<u: bigint, b: array<array<string>>, a: array<array<string>>>"
)
TRADE_MESSAGE = (
    "topic string, ts bigint, data array<struct<T: bigint, S: string, v: string, "
    "p: string, i: string, seq: bigint, RPI: boolean>>"
)


BLOCK_BITS, LINE_BITS = 20, 33


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """One JSON message a line: ``text``, ``recv`` and the partition columns of the path (``symbol=...``).

    ``recv`` orders the lines of a file: the block its task read, then the line inside the task. It
    breaks ties between messages of one stamp, which never span files.
    """
    rows = spark.read.text(path)
    block = F.shiftright(F.col("_metadata.file_block_start"), BLOCK_BITS)
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << LINE_BITS) - 1))
    recv = F.shiftleft(block, LINE_BITS) + line
    others = [c for c in rows.columns if c != "value"]
    return rows.select(*others, F.col("value").alias("text"), recv.alias("recv"))


def book_messages(raw: DataFrame, keep: tuple[str, ...] = ("symbol", "recv")) -> DataFrame:
    """Decoded book messages; other topics give no row."""
    parsed = raw.withColumn("m", F.from_json("text", BOOK_MESSAGE))
    kind = F.col("m.type").isin("snapshot", "delta")
    book = F.coalesce(F.col("m.topic"), F.lit("orderbook")).startswith("orderbook")
    return parsed.filter(kind & book).select(
        *keep,
        F.col("m.type").alias("kind"),
        (F.col("m.ts") * 1000).alias("us"),
        F.col("m.data.u").alias("update_id"),
        F.col("m.data.b").alias("b"),
        F.col("m.data.a").alias("a"),
    )


def level_changes(messages: DataFrame) -> DataFrame:
    """One row per changed level: side, price, new size (0 removes it)."""
    change = F.explode(
        F.concat(
            F.transform(
                F.coalesce("b", F.array()),
                lambda r: F.struct(
                    F.lit("b").alias("side"),
                    r[0].cast("double").alias("price"),
                    r[1].cast("double").alias("size"),
                ),
            ),
            F.transform(
                F.coalesce("a", F.array()),
                lambda r: F.struct(
                    F.lit("a").alias("side"),
                    r[0].cast("double").alias("price"),
                    r[1].cast("double").alias("size"),
                ),
            ),
        )
    )
    rest = [c for c in messages.columns if c not in ("a", "b")]
    return messages.select(*rest, change.alias("c")).select(*rest, "c.side", "c.price", "c.size")


def trade_messages(raw: DataFrame, keep: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Prints from trade messages."""
    parsed = raw.withColumn("m", F.from_json("text", TRADE_MESSAGE)).filter(
        F.col("m.topic").startswith("publicTrade")
    )
    return parsed.select(*keep, F.explode("m.data").alias("t")).select(
        *keep,
        (F.col("t.T") * 1000).alias("us"),
        F.col("t.p").cast("double").alias("price"),
        F.col("t.v").cast("double").alias("size"),
        F.when(F.col("t.S") == "Buy", 1).otherwise(-1).alias("aggressor"),
        F.col("t.i").alias("match_id"),
        F.col("t.seq").alias("seq"),
        F.coalesce("t.RPI", F.lit(False)).alias("rpi"),
    )
