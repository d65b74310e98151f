"""The prints contract, conversions, and the touch that prints alone show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.chunks import PRINTS, last_known


def checked(prints: DataFrame) -> DataFrame:
    """Prints whose every row keeps the contract; a row that does not fails the job."""
    good = (
        F.col("aggressor").isin(-1, 1)
        & (F.col("price") > 0)
        & (F.col("size") > 0)
        & ~F.isnan("price")
        & ~F.isnan("size")
        & (F.col("price") < float("inf"))
        & (F.col("size") < float("inf"))
    )
    broken = F.raise_error(F.concat(F.lit("print breaks the contract: "), F.col("trade_id")))
    return prints.withColumn(
        "price", F.when(F.coalesce(good, F.lit(False)), F.col("price")).otherwise(broken.cast("double"))
    )


def contract_findings(prints: DataFrame) -> DataFrame:
    """One row: how many prints break each rule."""
    return prints.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("aggressor").isin(-1, 1)).alias("bad_aggressor"),
        F.count_if(~(F.col("price") > 0) | F.isnan("price")).alias("bad_price"),
        F.count_if(~(F.col("size") > 0) | F.isnan("size")).alias("bad_size"),
    )


def assemble(df: DataFrame, source: str) -> DataFrame:
    """Parsed columns as a contract frame."""
    return checked(
        df.select(
            "symbol",
            F.timestamp_micros("us").alias("ts"),
            "us",
            F.col("price").cast("double").alias("price"),
            F.col("size").cast("double").alias("size"),
            F.col("aggressor").cast("tinyint").alias("aggressor"),
            F.col("trade_id").cast("long").alias("trade_id"),
            F.coalesce(F.col("rpi"), F.lit(False)).alias("rpi")
            if "rpi" in df.columns
            else F.lit(False).alias("rpi"),
            F.lit(source).alias("source"),
        )
    )


def trades_to_prints(trades: DataFrame) -> DataFrame:
    return trades.select(
        "symbol",
        "us",
        "price",
        F.col("quantity").alias("size"),
        F.when(F.col("is_buyer_maker"), -1).otherwise(1).alias("aggressor"),
        "trade_id",
    )


def prints_to_trades(prints: DataFrame) -> DataFrame:
    return prints.select(
        "symbol",
        "us",
        "price",
        F.col("size").alias("quantity"),
        (F.col("aggressor") == -1).alias("is_buyer_maker"),
        "trade_id",
    )


def touch_rows(prints: DataFrame) -> DataFrame:
    """Last buy price (ask proxy) and last sell price (bid proxy) right after each print."""
    sides = {
        "ask_proxy": F.when(F.col("aggressor") == 1, F.col("price")),
        "bid_proxy": F.when(F.col("aggressor") == -1, F.col("price")),
    }
    return last_known(prints, sides, PRINTS)


def print_grid(prints: DataFrame, grid_ms: float = 100) -> DataFrame:
    """One row per occupied interval, at its first print's stamp, with the touch proxies there.

    Prints sharing that first stamp all count, so the last of them decides the proxies.
    """
    width = round(grid_ms * 1000)
    bin_ = F.floor(F.col("us") / F.lit(width)).cast("long")
    seen = touch_rows(prints)
    first = seen.groupBy("symbol", bin_.alias("bin")).agg(F.min("us").alias("us"))
    at_stamp = seen.groupBy("symbol", "us").agg(
        F.max_by(F.struct("ask_proxy", "bid_proxy"), F.col("trade_id")).alias("p")
    )
    return first.join(at_stamp, ["symbol", "us"]).select(
        "symbol",
        "us",
        F.col("p.ask_proxy").alias("ask_proxy"),
        F.col("p.bid_proxy").alias("bid_proxy"),
        ((F.col("p.ask_proxy") + F.col("p.bid_proxy")) / 2).alias("mid_proxy"),
    )


def sweep_keys() -> list[Column]:
    """Order inside one stamp: sells first, each sweep in price order, larger first."""
    return [
        F.col("us"),
        F.col("aggressor"),
        F.col("aggressor") * F.col("price"),
        -F.col("size"),
        F.col("trade_id"),
    ]


