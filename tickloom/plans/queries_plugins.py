"""Extension points exercised end to end."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import plugins
from tickloom.functions.book import FEATURES, build_features
from tickloom.functions.columns import rolling
from tickloom.functions.flow import short_volatility
from tickloom.plans.fixtures import Fixtures
from tickloom.plans.queries_book import BASE
from tickloom.plans.queries_flow import back
from tickloom.plans.registry import query

ROW = "PARTITION BY symbol ORDER BY us, seq"


@query("f6_order_flow_step", f"{BASE} SELECT symbol, us, seq, ofi AS ofi_1 FROM e", d="ofi_1")
def f6(fx: Fixtures) -> DataFrame:
    return build_features(fx.book, ["ofi_1"], spine=fx.spine)


if "imbalance_mean_8" not in FEATURES:

    @plugins.feature("imbalance_mean_8", rows_back=8, description="mean touch imbalance of 8 rows")
    def imbalance_mean(w):
        return rolling(F.avg, "_imb", w, 8)

    @plugins.timed_feature("volatility_3600s", 3600)
    def volatility(book: DataFrame) -> DataFrame:
        return short_volatility(book, 3600).select("symbol", "us", "seq", "volatility_bp")


@query(
    "u1_registered_feature",
    f"""
    {BASE} SELECT symbol, us, seq, CASE WHEN count(imb) OVER w >= 8 THEN avg(imb) OVER w END
      AS imbalance_mean_8 FROM e WINDOW w AS ({ROW} ROWS 7 PRECEDING)""",
    d="imbalance_mean_8",
)
def u1(fx: Fixtures) -> DataFrame:
    return build_features(fx.book, ["imbalance_mean_8"], spine=fx.spine)


@query(
    "u2_timed_feature",
    f"""
    WITH m AS (SELECT symbol, us, seq, (bid_price_0 + ask_price_0) / 2 AS mid FROM fx_book),
    r AS (SELECT *, (mid / lag(mid) OVER ({ROW}) - 1) * 1e4 AS ret FROM m)
    SELECT symbol, us, seq, stddev_samp(ret) OVER {back(3600)} AS volatility_bp FROM r""",
    d="volatility_bp",
)
def u2(fx: Fixtures) -> DataFrame:
    _, build = plugins.TIMED["volatility_3600s"]
    return build(fx.book)


@query(
    "u4_strategy_by_name",
    """
    WITH v AS (SELECT symbol, us, seq, (bid_size_0 - ask_size_0) / (bid_size_0 + ask_size_0) AS x
               FROM fx_book),
    t AS (SELECT quantile_cont(abs(x), 0.8) AS q FROM v WHERE us < 1705276800000000)
    SELECT symbol, us, seq, CASE WHEN abs(x) >= q THEN sign(x) ELSE 0 END AS side FROM v, t""",
    i="side",
)
def u4(fx: Fixtures) -> DataFrame:
    strategy = plugins.get("strategy", "book_imbalance", share=0.2)
    history = fx.book.filter(F.col("us") < 1_705_276_800_000_000)
    return strategy.fit(history).decide(fx.book)


@query(
    "u5_row_group_function",
    """
    SELECT symbol, us // 86400000000 AS day, max(price) - min(price) AS span, count(*) AS prints
    FROM fx_prints GROUP BY 1, 2""",
    d="span",
)
def u5(fx: Fixtures) -> DataFrame:
    # Six-hour groups: bounded by time, and several a day for a busy instrument.
    slot = F.floor(F.col("us") / F.lit(21_600_000_000)).cast("long")
    parts = fx.prints.select("symbol", slot.alias("slot"), "price")

    def summarise(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "symbol": frame["symbol"].iloc[:1],
                "slot": frame["slot"].iloc[:1],
                "low": frame["price"].min(),
                "high": frame["price"].max(),
                "n": len(frame),
            }
        )

    slots = plugins.per_group(
        parts, ["symbol", "slot"], summarise, "symbol string, slot long, low double, high double, n long"
    )
    return slots.groupBy("symbol", F.floor(F.col("slot") / 4).cast("long").alias("day")).agg(
        (F.max("high") - F.min("low")).alias("span"), F.sum("n").alias("prints")
    )
