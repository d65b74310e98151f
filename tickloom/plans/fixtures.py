"""Market planes derived from the given tables, as DataFrames.

Rules are fixed and the same as in ``fixture_sql``: prints from ``events``, a touch from the
last buy and sell print, a five-level book around it, hourly bars, funding, and a daily
spot/perpetual pair per order priority.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.columns import US, utc_micros
from tickloom.operators.chunks import PRINTS, SameRows, last_known

LEVELS = 5
HOUR = 3600 * US


def level_columns(depth: int = LEVELS) -> list[str]:
    return [f"{s}_{k}_{i}" for i in range(depth) for s in ("bid", "ask") for k in ("price", "size")]


class Fixtures:
    """Lazily built planes over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def stamps(self) -> DataFrame:
        """Key and stamp of every print."""
        return self.events.select(
            F.col("event_type").alias("symbol"), utc_micros(F.col("ts")).alias("us")
        )

    @cached_property
    def spine(self) -> SameRows:
        """The rows of the book, which has one for each print once both sides are known."""
        return SameRows(self.stamps)

    @cached_property
    def prints(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("double")
        return self.events.select(
            F.col("event_type").alias("symbol"),
            utc_micros(F.col("ts")).alias("us"),
            (F.lit(100) + F.col("value") / 100).alias("price"),
            (k + 1).alias("size"),
            F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1).alias("aggressor"),
            F.col("event_id").alias("trade_id"),
        )

    @cached_property
    def trades(self) -> DataFrame:
        return self.prints.select(
            "symbol",
            "us",
            "price",
            F.col("size").alias("quantity"),
            (F.col("aggressor") == -1).alias("is_buyer_maker"),
            "trade_id",
        )

    @cached_property
    def touch(self) -> DataFrame:
        buy, sell = F.col("aggressor") == 1, F.col("aggressor") == -1
        both = F.struct("price", "size")
        seen = last_known(
            self.prints, {"ask": F.when(buy, both), "bid": F.when(sell, both)}, PRINTS
        )
        return seen.filter("ask IS NOT NULL AND bid IS NOT NULL").select(
            "symbol",
            "us",
            F.col("trade_id").alias("seq"),
            F.col("ask.price").alias("ask_proxy"),
            F.col("bid.price").alias("bid_proxy"),
            F.col("ask.size").alias("ask_sz"),
            F.col("bid.size").alias("bid_sz"),
        )

    @cached_property
    def book_raw(self) -> DataFrame:
        return self.touch.select(
            "symbol",
            "us",
            "seq",
            F.col("bid_proxy").alias("bid_price_0"),
            F.col("bid_sz").alias("bid_size_0"),
            F.col("ask_proxy").alias("ask_price_0"),
            F.col("ask_sz").alias("ask_size_0"),
        )

    @cached_property
    def book(self) -> DataFrame:
        bid0 = F.least("bid_proxy", "ask_proxy") - 0.01
        ask0 = F.greatest("bid_proxy", "ask_proxy") + 0.01

        def size(base: str, i: int) -> Column:
            return F.lit(1) + (F.col(base) + 3 * i) % 11

        levels: list[Column] = []
        for i in range(LEVELS):
            levels += [
                (bid0 - 0.01 * i).alias(f"bid_price_{i}"),
                (ask0 + 0.01 * i).alias(f"ask_price_{i}"),
                size("bid_sz", i).alias(f"bid_size_{i}"),
                size("ask_sz", i).alias(f"ask_size_{i}"),
            ]
        return self.touch.select("symbol", "us", "seq", *levels)

    @cached_property
    def bars(self) -> DataFrame:
        from tickloom.operators.grid import bars_from_prints

        return bars_from_prints(self.prints, 3600)

    @cached_property
    def funding(self) -> DataFrame:
        eight = 8 * HOUR
        slot = (F.floor(F.col("open_us") / F.lit(eight)) + 1) * eight
        return (
            self.bars.groupBy("symbol", slot.cast("long").alias("at"))
            .agg(((F.max_by("close", "us") / F.min_by("open", "us") - 1) / 100).alias("rate"))
            .withColumnRenamed("at", "us")
        )

    @cached_property
    def venue(self) -> DataFrame:
        name = F.when(F.col("aggressor") == 1, "A").otherwise("B")
        return self.prints.select("symbol", name.alias("venue"), "us", "price", "trade_id")

    @cached_property
    def carry(self) -> DataFrame:
        per_day = (
            self.table("orders")
            .groupBy(
                F.col("o_orderpriority").alias("coin"),
                F.col("o_orderdate").cast("date").alias("day"),
            )
            .agg(
                F.count(F.lit(1)).alias("n"),
                (F.lit(100) + F.avg("o_totalprice") / 1e4).alias("spot"),
            )
        )
        return per_day.select(
            "coin",
            "day",
            F.trunc("day", "month").alias("month"),
            "spot",
            (F.col("spot") * (F.lit(1) + (F.col("n") % 7 - 3) * 1e-4)).alias("perp"),
            ((F.col("n") % 5 - 2) * 1e-4).alias("rate"),
        )

    @cached_property
    def decisions(self) -> DataFrame:
        mid = (F.col("bid_price_0") + F.col("ask_price_0")) / 2
        imb = (F.col("bid_size_0") - F.col("ask_size_0")) / (
            F.col("bid_size_0") + F.col("ask_size_0")
        )
        p_buy = F.lit(0.5) + F.col("imb") / 2
        side = F.when(p_buy > 0.6, 1).when(F.lit(1) - p_buy > 0.6, -1).otherwise(0)
        return self.book.select(
            "symbol",
            "us",
            "seq",
            mid.alias("mid"),
            (F.lit(1e4) * (F.col("ask_price_0") - F.col("bid_price_0")) / mid).alias("spread_bp"),
            imb.alias("imb"),
        ).select(
            "*",
            p_buy.alias("p_buy"),
            (F.lit(1) - p_buy).alias("p_sell"),
            side.alias("side"),
        )

    @cached_property
    def li_trades(self) -> DataFrame:
        gross = (F.col("l_discount") - 0.05) * 1e4
        cost = F.col("l_tax") * 100
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("okey"),
            F.col("l_linenumber").alias("line"),
            F.concat("l_returnflag", "l_linestatus").alias("series"),
            F.col("l_shipdate").cast("date").alias("day"),
            gross.alias("gross_bp"),
            cost.alias("cost_bp"),
            (gross - cost).alias("net_bp"),
        )

    @cached_property
    def cells(self) -> DataFrame:
        gross = (F.col("l_discount") - 0.05) * 1e4
        axes = self.table("lineitem").select(
            F.col("l_linenumber").cast("long").alias("a_line"),
            F.col("l_returnflag").alias("a_flag"),
            F.floor((F.col("l_quantity") - 1) / 10).cast("long").alias("a_qty"),
            F.col("l_shipdate").cast("date").alias("day"),
            gross.alias("gross"),
            (gross - F.col("l_tax") * 100).alias("net"),
        )
        return axes.groupBy("a_line", "a_flag", "a_qty", "day").agg(
            F.count(F.lit(1)).alias("trades"),
            F.sum("net").alias("net_bp"),
            F.sum("gross").alias("g_bp"),
        ).select(
            F.format_string("%d|%s|%d", "a_line", "a_flag", "a_qty").alias("key"),
            "a_line",
            "a_flag",
            "a_qty",
            "day",
            "trades",
            "net_bp",
            "g_bp",
        )
