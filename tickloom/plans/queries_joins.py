"""Joins: as-of in its variants, buckets, pairs, semi, anti, rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.book import build_features
from tickloom.functions.columns import day_of
from tickloom.operators import asof
from tickloom.plans.fixtures import Fixtures
from tickloom.plans.registry import query

BUYS = "(SELECT * FROM fx_prints WHERE aggressor = 1)"


def _asof_sql(op: str, extra: str = "true") -> str:
    return f"""
    SELECT b.symbol, b.us, b.seq,
      CASE WHEN {extra} THEN p.us END AS r_us, CASE WHEN {extra} THEN p.price END AS price
    FROM fx_book b ASOF LEFT JOIN {BUYS} p ON b.symbol = p.symbol AND {op}"""


def _buys(fx: Fixtures) -> DataFrame:
    return fx.prints.filter("aggressor = 1")


@query("j1_asof_tolerance", _asof_sql("b.us >= p.us", "b.us - p.us <= 600000000"), d="price")
def j1(fx: Fixtures) -> DataFrame:
    out = asof.asof_join(
        fx.book, _buys(fx), ["price"], right_tie="trade_id", tolerance_s=600, spine=fx.spine
    )
    return out.select("symbol", "us", "seq", "r_us", "price")


@query("j2_asof_strict", _asof_sql("b.us > p.us"), d="price")
def j2(fx: Fixtures) -> DataFrame:
    out = asof.asof_join(fx.book, _buys(fx), ["price"], right_tie="trade_id", strict=True)
    return out.select("symbol", "us", "seq", "r_us", "price")


BUCKET_SQL = """
    WITH rows_ AS (SELECT symbol, us, seq, (bid_price_0 + ask_price_0) / 2 AS mid FROM fx_book),
    placed AS (SELECT p.*, r.seq AS row_seq FROM fx_prints p ASOF JOIN rows_ r
               ON p.symbol = r.symbol AND {op}),
    s AS (SELECT symbol, row_seq AS seq,
      sum(CASE WHEN aggressor = 1 THEN size ELSE 0 END) AS buy_volume,
      sum(CASE WHEN aggressor = -1 THEN size ELSE 0 END) AS sell_volume,
      count(*) AS trade_count, sum(aggressor * size * price) AS signed_notional,
      sum(size * price) AS traded_notional, max(size * price) AS largest_trade
      FROM placed GROUP BY 1, 2)
    SELECT symbol, us, seq, mid, coalesce(buy_volume, 0) AS buy_volume,
      coalesce(sell_volume, 0) AS sell_volume, coalesce(trade_count, 0) AS trade_count,
      coalesce(signed_notional, 0) AS signed_notional,
      coalesce(traded_notional, 0) AS traded_notional,
      coalesce(largest_trade, 0) AS largest_trade,
      coalesce((traded_notional / (buy_volume + sell_volume) / mid - 1) * 1e4, 0)
        AS vwap_deviation_bp
    FROM rows_ LEFT JOIN s USING (symbol, seq)"""
BUCKET_D = (
    "mid buy_volume sell_volume trade_count signed_notional traded_notional largest_trade "
    "vwap_deviation_bp"
)


@query("j3_forward_bucket", BUCKET_SQL.format(op="p.us <= r.us"), d=BUCKET_D)
def j3(fx: Fixtures) -> DataFrame:
    return asof.bucket_prints(fx.book, fx.prints)


@query("j4_containing_bucket", BUCKET_SQL.format(op="p.us >= r.us"), d=BUCKET_D)
def j4(fx: Fixtures) -> DataFrame:
    return asof.bucket_prints(fx.book, fx.prints, containing=True)


@query(
    "j5_entry_exit_rows",
    """
    WITH e AS (SELECT d.symbol, d.us, d.seq, b.us AS entry_us FROM fx_book d
      ASOF LEFT JOIN fx_book b ON d.symbol = b.symbol AND d.us + 1000000 <= b.us)
    SELECT e.symbol, e.us, e.seq, e.entry_us, x.us AS exit_us FROM e
      ASOF LEFT JOIN fx_book x ON e.symbol = x.symbol AND e.entry_us + 1800000000 <= x.us""",
)
def j5(fx: Fixtures) -> DataFrame:
    key = fx.book.select("symbol", "us", "seq")
    out = asof.entry_exit(key, key, [], hold_s=1800, latency_ms=1000)
    return out.select("symbol", "us", "seq", "entry_us", "exit_us")


@query(
    "j6_at_or_before_lag",
    """
    SELECT d.symbol, d.us, d.seq, b.us AS lag_us,
      1e4 * ln(d.ask_price_0 / b.ask_price_0) AS change_bp
    FROM fx_book d ASOF LEFT JOIN fx_book b ON d.symbol = b.symbol AND d.us - 900000000 >= b.us""",
    d="change_bp",
)
def j6(fx: Fixtures) -> DataFrame:
    left = fx.book.select("symbol", "us", "seq", "ask_price_0")
    out = asof.asof_join(
        left,
        left,
        ["ask_price_0"],
        at=F.col("us") - 900_000_000,
        names={"ask_price_0": "was", "r_us": "lag_us"},
    )
    change = F.lit(1e4) * F.log(F.col("ask_price_0") / F.col("was"))
    return out.select("symbol", "us", "seq", "lag_us", change.alias("change_bp"))


@query(
    "j7_mid_at_horizon",
    """
    SELECT p.symbol, p.us, p.trade_id, (b.bid_price_0 + b.ask_price_0) / 2 AS later_mid
    FROM fx_prints p ASOF LEFT JOIN fx_book b ON p.symbol = b.symbol AND p.us + 60000000 >= b.us""",
    d="later_mid",
)
def j7(fx: Fixtures) -> DataFrame:
    mids = fx.book.select(
        "symbol", "us", "seq", ((F.col("bid_price_0") + F.col("ask_price_0")) / 2).alias("mid")
    )
    out = asof.asof_join(
        fx.prints, mids, ["mid"], at=F.col("us") + 60_000_000, left_tie="trade_id"
    )
    return out.select("symbol", "us", "trade_id", F.col("mid").alias("later_mid"))


@query(
    "j8_prints_through",
    """
    WITH n AS (SELECT symbol, us, row_number() OVER (PARTITION BY symbol ORDER BY us) AS k
               FROM fx_prints WHERE aggressor = -1)
    SELECT b.symbol, b.us, b.seq, coalesce(n.k, 0) AS n_before
    FROM fx_book b ASOF LEFT JOIN n ON b.symbol = n.symbol AND b.us >= n.us""",
)
def j8(fx: Fixtures) -> DataFrame:
    sells = fx.prints.filter("aggressor = -1")
    return asof.count_through(fx.book.select("symbol", "us", "seq"), sells)


@query(
    "j9_funding_backward",
    """
    SELECT b.symbol, b.us, b.close, f.rate FROM fx_bars b
    ASOF LEFT JOIN fx_funding f ON b.symbol = f.symbol AND b.us >= f.us""",
    d="close rate",
    digits=9,
)
def j9(fx: Fixtures) -> DataFrame:
    left = fx.bars.select("symbol", "us", "close", "hour")
    out = asof.asof_join(
        left, fx.funding, ["rate"], left_tie="hour", right_tie="us"
    )
    return out.select("symbol", "us", "close", "rate")


@query(
    "j10_symbol_pairs",
    """
    SELECT x.us, x.symbol AS a, y.symbol AS b, x.close AS close_a, y.close AS close_b
    FROM fx_bars x JOIN fx_bars y ON x.us = y.us AND x.symbol < y.symbol""",
    d="close_a close_b",
)
def j10(fx: Fixtures) -> DataFrame:
    return asof.symbol_pairs(fx.bars, ["close"])


@query(
    "j11_features_labels_join",
    """
    WITH m AS (SELECT symbol, us, seq, (bid_price_0 + ask_price_0) / 2 AS mid,
                 (bid_size_0 - ask_size_0) / (bid_size_0 + ask_size_0) AS queue_imbalance
               FROM fx_book)
    SELECT symbol, us, seq, queue_imbalance,
      1e4 * ln(lead(mid, 10) OVER w / mid) AS forward_bp
    FROM m WINDOW w AS (PARTITION BY symbol ORDER BY us, seq)""",
    d="queue_imbalance forward_bp",
)
def j11(fx: Fixtures) -> DataFrame:
    from tickloom.functions.labels import forward_return

    features = build_features(fx.book, ["queue_imbalance"])
    moves = forward_return(fx.book, 10, spine=fx.spine)
    return features.join(moves, ["symbol", "us", "seq"])


@query(
    "j12_full_calendar_semi",
    """
    WITH d AS (SELECT DISTINCT symbol, user_day FROM
      (SELECT symbol, us, us // 86400000000 AS user_day FROM fx_prints)),
    ok AS (SELECT symbol FROM d GROUP BY 1
           HAVING count(*) = (SELECT count(DISTINCT user_day) FROM d))
    SELECT symbol, count(*) AS rows_kept FROM fx_prints
    WHERE symbol IN (SELECT symbol FROM ok) GROUP BY 1""",
)
def j12(fx: Fixtures) -> DataFrame:
    days = fx.prints.select(day_of("us").alias("day"))
    kept = asof.with_every_day(fx.prints, days)
    return kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows_kept"))


@query(
    "j13_outside_grid_anti",
    """
    SELECT l_returnflag || l_linestatus AS series, CAST(l_shipdate AS DATE) AS day,
           count(*) AS rows_outside
    FROM lineitem WHERE CAST(l_shipdate AS DATE) NOT IN
      (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'F') GROUP BY 1, 2""",
)
def j13(fx: Fixtures) -> DataFrame:
    grid = (
        fx.table("orders")
        .filter("o_orderstatus = 'F'")
        .select(F.col("o_orderdate").cast("date").alias("day"))
        .distinct()
    )
    ledger = fx.li_trades.groupBy("series", "day").agg(F.count(F.lit(1)).alias("rows_outside"))
    return asof.refuse_outside(ledger, grid, ["day"])


@query(
    "j14_settlements_in_hold",
    """
    WITH t AS (SELECT symbol, us AS entry_us, us + 36000000000 AS exit_us, trade_id FROM fx_prints)
    SELECT t.symbol, t.trade_id, coalesce(sum(f.rate), 0) AS paid
    FROM t LEFT JOIN fx_funding f ON t.symbol = f.symbol AND f.us > t.entry_us
      AND f.us <= t.exit_us GROUP BY 1, 2""",
    d="paid",
    digits=9,
)
def j14(fx: Fixtures) -> DataFrame:
    from tickloom.operators.portfolio import settlements_between

    trades = fx.prints.select(
        "symbol",
        F.col("us").alias("entry_us"),
        (F.col("us") + 36_000_000_000).alias("exit_us"),
        F.col("trade_id").alias("seq"),
    )
    out = settlements_between(trades, fx.funding)
    return out.select("symbol", F.col("seq").alias("trade_id"), "paid")


@query(
    "j15_day_rotation",
    """
    WITH d AS (SELECT series, day, sum(net_bp) AS net_bp, dense_rank() OVER
                 (PARTITION BY series ORDER BY day) - 1 AS row FROM fx_li_trades GROUP BY 1, 2),
    n AS (SELECT series, count(*) AS n FROM d GROUP BY 1)
    SELECT d.series AS symbol, d.day, t.day AS target_day, t.net_bp AS net_bp_rotated
    FROM d JOIN n USING (series) JOIN d t ON t.series = d.series AND t.row = (d.row + 7) % n.n""",
    d="net_bp_rotated",
)
def j15(fx: Fixtures) -> DataFrame:
    daily = fx.li_trades.groupBy(F.col("series").alias("symbol"), "day").agg(
        F.sum("net_bp").alias("net_bp")
    )
    from pyspark.sql import Window

    # Days per series, not trades: a few thousand rows a key whatever the volume.
    w = Window.partitionBy("symbol")
    ranked = daily.select(
        "*",
        (F.row_number().over(w.orderBy("day")) - 1).alias("row"),
        F.count(F.lit(1)).over(w).alias("n"),
    )
    out = asof.rotated(ranked, 7, values=["day", "net_bp"])
    return out.select("symbol", "day", F.col("day_rotated").alias("target_day"), "net_bp_rotated")


@query(
    "j16_broadcast_profile",
    """
    WITH r AS (SELECT symbol, us, us // 3600000000 % 24 AS hour,
                 ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY us)) AS ret FROM fx_bars),
    p AS (SELECT hour, sqrt(avg(ret * ret)) AS rms FROM r WHERE ret IS NOT NULL GROUP BY 1)
    SELECT symbol, us, ret / rms AS scaled FROM r JOIN p USING (hour) WHERE ret IS NOT NULL""",
    d="scaled",
)
def j16(fx: Fixtures) -> DataFrame:
    from tickloom.functions.regime import hourly_returns, normalise_by_hour

    return normalise_by_hour(hourly_returns(fx.bars)).select("symbol", "us", "scaled")


@query(
    "j17_paired_tables",
    """
    WITH d AS (SELECT series, day, sum(net_bp) AS net FROM fx_li_trades GROUP BY 1, 2)
    SELECT a.day, a.net AS net_x, b.net AS net_y, a.net - b.net AS diff
    FROM d a JOIN d b ON a.day = b.day AND a.series = 'AF' AND b.series = 'NO'""",
    d="net_x net_y diff",
)
def j17(fx: Fixtures) -> DataFrame:
    daily = fx.li_trades.groupBy("series", "day").agg(F.sum("net_bp").alias("net"))
    x = daily.filter("series = 'AF'").select("day", F.col("net").alias("net_x"))
    y = daily.filter("series = 'NO'").select("day", F.col("net").alias("net_y"))
    return x.join(y, "day").withColumn("diff", F.col("net_x") - F.col("net_y"))


@query(
    "j18_left_annotation",
    """
    WITH a AS (SELECT symbol, us, rate FROM fx_funding WHERE rate > 0)
    SELECT b.symbol, b.us, b.close, a.rate, a.rate IS NOT NULL AS alarmed
    FROM fx_bars b LEFT JOIN a USING (symbol, us)""",
    d="close rate",
    digits=9,
)
def j18(fx: Fixtures) -> DataFrame:
    marks = fx.funding.filter("rate > 0").select("symbol", "us", "rate")
    out = fx.bars.select("symbol", "us", "close").join(marks, ["symbol", "us"], "left")
    return out.withColumn("alarmed", F.col("rate").isNotNull())
