"""Exchange archive layouts as Spark readers and normalisers.

A reader loads text columns; a normaliser maps them onto a contract. Header names changed over
the years, so columns are found by alias; integer epochs are s, ms, µs or ns by magnitude.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.columns import day_of
from tickloom.sources.contracts import ContractError

# Header names the archives have used, by meaning.
AGG_TRADE_ALIASES: Mapping[str, Sequence[str]] = {
    "agg_trade_id": ("agg_trade_id", "aggregate_trade_id", "a"),
    "transact_time": ("transact_time", "transaction_time", "timestamp", "time", "t"),
    "price": ("price", "p"),
    "quantity": ("quantity", "qty", "q"),
    "is_buyer_maker": ("is_buyer_maker", "m"),
}
BOOK_TICKER_COLUMNS = (
    "update_id best_bid_price best_bid_qty best_ask_price best_ask_qty transaction_time"
).split()
METRIC_COLUMNS = (
    "sum_open_interest sum_open_interest_value count_toptrader_long_short_ratio "
    "sum_toptrader_long_short_ratio count_long_short_ratio sum_taker_long_short_vol_ratio"
).split()
DEPTH_PERCENTAGES = (-5, -4, -3, -2, -1, 1, 2, 3, 4, 5)


def read_csv(spark: SparkSession, path: str, *, header: bool = True, schema: str | None = None):
    """All columns as text: archives change types; the normaliser casts."""
    reader = spark.read.option("header", header).option("inferSchema", False)
    return (reader.schema(schema) if schema else reader).csv(path)


def renamed(df: DataFrame, aliases: Mapping[str, Sequence[str]], what: str) -> DataFrame:
    """Columns by their first alias present; a meaning with no column is an error."""
    have = {c.lower(): c for c in df.columns}
    found = {name: next((have[a] for a in names if a in have), None) for name, names in aliases.items()}
    missing = sorted(name for name, c in found.items() if c is None)
    if missing:
        raise ContractError(f"{what} archive lacks: {missing}")
    keep = [F.col(c).alias(n) for n, c in found.items()]
    others = [c for c in df.columns if c not in found.values()]
    return df.select(*keep, *others)


def _required(df: DataFrame, names: Sequence[str], what: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ContractError(f"{what} archive lacks: {missing}")
    return df


def micros_from_epoch(value: Column, magnitude: Column) -> Column:
    """Epoch microseconds, the unit read from ``magnitude`` (the archive's median stamp)."""
    v = value.cast("long")
    return (
        F.when(magnitude < 1e11, v * 1_000_000)
        .when(magnitude < 1e14, v * 1_000)
        .when(magnitude < 1e17, v)
        .otherwise(F.floor(v / F.lit(1000)))
        .cast("long")
    )


def with_micros(df: DataFrame, column: str, name: str = "us") -> DataFrame:
    """Add ``us``; the unit is decided once for the archive, by its median stamp (one row)."""
    middle = df.agg(F.percentile_approx(F.col(column).cast("double"), 0.5).alias("_median"))
    joined = df.join(F.broadcast(middle))  # one row
    return joined.withColumn(name, micros_from_epoch(F.col(column), F.col("_median"))).drop(
        "_median"
    )


def parse_bool(value: Column) -> Column:
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text == "true", True).when(text == "false", False)


def agg_trades(raw: DataFrame, symbol: Column, source: str) -> DataFrame:
    """Aggregated trades onto the trades contract."""
    df = with_micros(renamed(raw, AGG_TRADE_ALIASES, "aggTrades"), "transact_time")
    return df.select(
        F.timestamp_micros("us").alias("ts"),
        symbol.alias("symbol"),
        F.col("price").cast("double").alias("price"),
        F.col("quantity").cast("double").alias("quantity"),
        parse_bool(F.col("is_buyer_maker")).alias("is_buyer_maker"),
        F.col("agg_trade_id").cast("long").alias("trade_id"),
        F.lit(source).alias("source"),
    )


def book_ticker(raw: DataFrame, symbol: Column, source: str) -> DataFrame:
    """Best bid and ask, stamped when the book changed, not when the message was sent."""
    df = with_micros(_required(raw, BOOK_TICKER_COLUMNS, "bookTicker"), "transaction_time")
    return df.select(
        F.timestamp_micros("us").alias("ts"),
        symbol.alias("symbol"),
        F.col("update_id").cast("long").alias("sequence_id"),
        F.lit(source).alias("source"),
        F.col("best_bid_price").cast("double").alias("bid_price_0"),
        F.col("best_bid_qty").cast("double").alias("bid_size_0"),
        F.col("best_ask_price").cast("double").alias("ask_price_0"),
        F.col("best_ask_qty").cast("double").alias("ask_size_0"),
    )


def book_depth(
    raw: DataFrame, key: Sequence[str] = ("symbol",), order: str = "line"
) -> DataFrame:
    """Long cumulative depth to one wide row per stamp; the last line of a cell wins."""
    _required(raw, ["timestamp", "percentage", "depth", "notional"], "bookDepth")
    out = raw.groupBy(*key, "timestamp").agg(
        *[
            F.max_by(
                F.col(value).cast("double"),
                F.when(F.col("percentage").cast("int") == pct, F.col(order)),
            ).alias(f"{value}_{'bid' if pct < 0 else 'ask'}_{abs(pct)}pct")
            for value in ("depth", "notional")
            for pct in DEPTH_PERCENTAGES
        ]
    )
    return out


def metrics(raw: DataFrame, symbol: Column, source: str) -> DataFrame:
    """Five-minute positioning; anything that is not a number becomes missing."""
    _required(raw, ["create_time"], "metrics")
    return raw.select(
        F.to_timestamp("create_time").alias("ts"),
        *[
            F.col(c).try_cast("double").alias(c) for c in METRIC_COLUMNS if c in raw.columns
        ],
        symbol.alias("symbol"),
        F.lit(source).alias("source"),
    )


def funding_rate(raw: DataFrame, symbol: Column, source: str) -> DataFrame:
    """Settlements; the interval defaults to eight hours."""
    df = with_micros(_required(raw, ["calc_time", "last_funding_rate"], "fundingRate"), "calc_time")
    hours = (
        F.col("funding_interval_hours").try_cast("double")
        if "funding_interval_hours" in raw.columns
        else F.lit(8.0)
    )
    return df.select(
        F.timestamp_micros("us").alias("ts"),
        F.col("last_funding_rate").try_cast("double").alias("funding_rate"),
        hours.alias("funding_interval_hours"),
        symbol.alias("symbol"),
        F.lit(source).alias("source"),
    )


def klines(raw: DataFrame, symbol: Column, source: str) -> DataFrame:
    """Bars stamped at their close."""
    need = ["open_time", "open", "high", "low", "close", "volume", "close_time"]
    df = with_micros(_required(raw, need, "klines"), "close_time")
    df = with_micros(df, "open_time", "open_us")
    return df.select(
        F.timestamp_micros("us").alias("ts"),
        F.timestamp_micros("open_us").alias("open_time"),
        symbol.alias("symbol"),
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")],
        F.lit(source).alias("source"),
    )


def within_day(df: DataFrame, day: date, ts: str = "ts") -> DataFrame:
    """Rows stamped in the UTC day; a range predicate, so it prunes and is pushed down."""
    start = F.lit(f"{day.isoformat()} 00:00:00").cast("timestamp")
    return df.filter((F.col(ts) >= start) & (F.col(ts) < start + F.expr("INTERVAL 1 DAY")))


def rows_outside_day(df: DataFrame, day: date, us: str = "us") -> DataFrame:
    """How many rows of a day's file are stamped outside it."""
    return df.select(F.count_if(day_of(us) != F.lit(day)).alias("rows_outside"))


def prints_csv(raw: DataFrame, symbol: Column) -> DataFrame:
    """Prints whose side column names the aggressor; stamps are fractional seconds."""
    _required(raw, ["timestamp", "side", "size", "price"], "trades")
    us = F.round(F.col("timestamp").cast("decimal(38,9)") * 1_000_000).cast("long")
    return raw.select(
        symbol.alias("symbol"),
        us.alias("us"),
        F.col("price").cast("double").alias("price"),
        F.col("size").cast("double").alias("size"),
        F.when(F.col("side") == "Buy", 1).otherwise(-1).alias("aggressor"),
        *([F.col("trdMatchID").alias("match_id")] if "trdMatchID" in raw.columns else []),
    )
