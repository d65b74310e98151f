"""Grids, resampling and bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import day_of
from tickloom.operators import grid
from tickloom.plans.fixtures import Fixtures
from tickloom.plans.registry import query

TOUCH = ["bid_price_0", "ask_price_0"]


@query(
    "g1_last_per_bin",
    """
    SELECT symbol, us // 900000000 AS bin, max(us) AS us, arg_max(seq, us) AS seq,
      arg_max(bid_price_0, us) AS bid_price_0, arg_max(ask_price_0, us) AS ask_price_0
    FROM fx_book GROUP BY symbol, us // 900000000""",
    d="bid_price_0 ask_price_0",
)
def g1(fx: Fixtures) -> DataFrame:
    return grid.last_per_bin(fx.book, 900, TOUCH)


FILLED = """
    WITH b AS (SELECT symbol, us // 86400000000 AS day, us // {w} AS bin,
      arg_max(bid_price_0, us) AS bid, arg_max(ask_price_0, us) AS ask
      FROM {src} GROUP BY 1, 2, 3),
    g AS (SELECT symbol, day, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY 1, 2)
"""


@query(
    "g2_filled_grid",
    FILLED.format(w=600000000, src="fx_book")
    + """SELECT symbol, (bin + 1) * 600000000 AS us,
      last_value(bid IGNORE NULLS) OVER w AS bid_price_0,
      last_value(ask IGNORE NULLS) OVER w AS ask_price_0
    FROM g LEFT JOIN b USING (symbol, day, bin)
    WINDOW w AS (PARTITION BY symbol, day ORDER BY bin)""",
    d="bid_price_0 ask_price_0",
)
def g2(fx: Fixtures) -> DataFrame:
    out = grid.filled_grid(fx.book, 600, TOUCH, label="right")
    return out.select("symbol", "us", *TOUCH)


@query(
    "g3_first_per_bin",
    """
    SELECT symbol, us // 900000000 AS bin, min(us) AS us, arg_min(trade_id, us) AS trade_id,
      arg_min(price, us) AS price FROM fx_prints GROUP BY symbol, us // 900000000""",
    d="price",
)
def g3(fx: Fixtures) -> DataFrame:
    return grid.first_per_bin(fx.prints, 900, ["price"], order=("us", "trade_id"))


@query(
    "g4_fixed_boundaries",
    """
    WITH r AS (SELECT symbol, us // 86400000000 AS day,
        greatest(1, (us % 86400000000 + 1799999999) // 1800000000) AS slot,
        arg_max(bid_price_0, us) AS bid FROM fx_book GROUP BY 1, 2, 3),
    g AS (SELECT symbol, day, unnest(range(min(slot), 49)) AS slot FROM r GROUP BY 1, 2)
    SELECT symbol, day * 86400000000 + slot * 1800000000 AS us,
      last_value(bid IGNORE NULLS) OVER (PARTITION BY symbol, day ORDER BY slot) AS bid_price_0
    FROM g LEFT JOIN r USING (symbol, day, slot)""",
    d="bid_price_0",
)
def g4(fx: Fixtures) -> DataFrame:
    out = grid.boundary_grid(fx.book, 1800, ["bid_price_0"])
    return out.select("symbol", "us", "bid_price_0")


@query(
    "g5_boundary_sums",
    """
    SELECT symbol, (us + 599999999) // 600000000 * 600000000 AS boundary,
      count(*) AS trade_count, sum(size) AS total_trade_volume,
      count_if(aggressor < 0) AS sell_count, sum(-aggressor * size) AS signed_volume
    FROM fx_prints GROUP BY 1, 2""",
    d="total_trade_volume signed_volume",
    i="sell_count",
)
def g5(fx: Fixtures) -> DataFrame:
    return grid.boundary_sums(fx.prints, 600)


@query(
    "g6_minute_bars_carry_limit",
    """
    WITH b AS (SELECT symbol, (us - 1) // 86400000000 AS day, (us - 1) // 60000000 AS bin,
      arg_max(bid_price_0, us) AS bid, arg_max(ask_price_0, us) AS ask,
      arg_max(bid_size_0, us) AS bs, arg_max(ask_size_0, us) AS sz
      FROM fx_book GROUP BY 1, 2, 3),
    g AS (SELECT symbol, day, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY 1, 2),
    f AS (SELECT symbol, bin, last_value(bid IGNORE NULLS) OVER w AS bid,
        last_value(ask IGNORE NULLS) OVER w AS ask, last_value(bs IGNORE NULLS) OVER w AS bs,
        last_value(sz IGNORE NULLS) OVER w AS sz,
        bin - last_value(CASE WHEN bid IS NOT NULL THEN bin END IGNORE NULLS) OVER w AS age
      FROM g LEFT JOIN b USING (symbol, day, bin)
      WINDOW w AS (PARTITION BY symbol, day ORDER BY bin))
    SELECT symbol, (bin + 1) * 60000000 AS us,
      CASE WHEN age <= 5 THEN (bid + ask) / 2 END AS mid,
      CASE WHEN age <= 5 THEN (ask - bid) / ((bid + ask) / 2) * 1e4 END AS spread_bp,
      CASE WHEN age <= 5 THEN (bs - sz) / (bs + sz) END AS imbalance FROM f""",
    d="mid spread_bp imbalance",
)
def g6(fx: Fixtures) -> DataFrame:
    return grid.minute_bars(fx.book).select("symbol", "us", "mid", "spread_bp", "imbalance")


@query(
    "g7_complete_panel",
    """
    WITH d AS (SELECT symbol, hour // 24 AS day, count(*) AS bars FROM fx_bars GROUP BY 1, 2),
    ok AS (SELECT symbol FROM d GROUP BY 1
           HAVING count(*) = (SELECT count(DISTINCT day) FROM d))
    SELECT symbol, us, close FROM fx_bars WHERE symbol IN (SELECT symbol FROM ok)""",
    d="close",
)
def g7(fx: Fixtures) -> DataFrame:
    from tickloom.operators.asof import with_every_day

    opened = fx.bars.select("symbol", F.col("open_us").alias("us"), F.col("us").alias("at"), "close")
    days = opened.select(day_of("us").alias("day"))
    kept = with_every_day(opened, days)
    return kept.select("symbol", F.col("at").alias("us"), "close")


@query(
    "g8_clock_alignment",
    """
    WITH s AS (SELECT us, count(*) AS n FROM fx_bars GROUP BY 1)
    SELECT (SELECT count(DISTINCT symbol) FROM fx_bars) AS n_symbols, count(*) AS stamps,
      (max(us) - min(us)) // 3600000000 + 1 - count(*) AS missing_stamps,
      min(n) = (SELECT count(DISTINCT symbol) FROM fx_bars) AS same_bars FROM s""",
    i="missing_stamps",
)
def g8(fx: Fixtures) -> DataFrame:
    return grid.aligned(fx.bars, 3600, refuse=False)


@query(
    "g8_common_clock",
    """
    WITH s AS (SELECT us FROM fx_bars GROUP BY us HAVING count(*) = (SELECT count(DISTINCT symbol) FROM fx_bars))
    SELECT symbol, us, close, volume FROM fx_bars SEMI JOIN s USING (us)""",
    d="close volume",
)
def g8b(fx: Fixtures) -> DataFrame:
    return grid.common_clock(fx.bars, ["close", "volume"])


@query(
    "g9_hourly_closes",
    """
    WITH g AS (SELECT symbol, unnest(range(min(us), max(us) + 1, 3600000000)) AS us
               FROM fx_bars GROUP BY 1)
    SELECT symbol, us, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY us)
      AS close, close IS NULL AS missing FROM g LEFT JOIN fx_bars USING (symbol, us)""",
    d="close",
)
def g9(fx: Fixtures) -> DataFrame:
    return grid.hourly_closes(fx.bars)


@query(
    "g10_every_nth_row",
    """
    SELECT symbol, us, seq FROM (SELECT symbol, us, seq, row_number() OVER
      (PARTITION BY symbol, us // 86400000000 ORDER BY us, seq) - 1 AS n FROM fx_book)
    WHERE n % 10 = 0""",
)
def g10(fx: Fixtures) -> DataFrame:
    return grid.every_nth(fx.book, 10).select("symbol", "us", "seq")


@query(
    "g10_thin_evenly",
    """
    WITH r AS (SELECT symbol, us, seq, row_number() OVER (PARTITION BY symbol ORDER BY us, seq) - 1
                 AS n, count(*) OVER (PARTITION BY symbol) AS total FROM fx_book),
    k AS (SELECT DISTINCT symbol, i * total // 150 AS n
          FROM (SELECT DISTINCT symbol, total FROM r), range(150) t(i))
    SELECT symbol, us, seq FROM r WHERE total <= 150
    UNION ALL SELECT r.symbol, us, seq FROM r JOIN k USING (symbol, n) WHERE total > 150""",
)
def g10b(fx: Fixtures) -> DataFrame:
    return grid.thin_evenly(fx.book, 150).select("symbol", "us", "seq")


@query(
    "g11_bars_from_prints",
    "SELECT symbol, hour, open_us, us, open, high, low, close, volume FROM fx_bars",
    d="open high low close volume",
)
def g11(fx: Fixtures) -> DataFrame:
    return fx.bars


@query(
    "g12_sparse_to_hours",
    """
    WITH g AS (SELECT symbol, unnest(range(min(us), max(us) + 1, 3600000000)) AS us
               FROM fx_bars GROUP BY 1)
    SELECT g.symbol, g.us, last_value(b.close IGNORE NULLS) OVER
      (PARTITION BY g.symbol ORDER BY g.us) AS close, coalesce(f.rate, 0) AS rate
    FROM g LEFT JOIN fx_bars b USING (symbol, us) LEFT JOIN fx_funding f USING (symbol, us)""",
    d="close rate",
    digits=9,
)
def g12(fx: Fixtures) -> DataFrame:
    hours = grid.hourly_closes(fx.bars).select("symbol", "us")
    return grid.sparse_to_hours(hours, fx.bars.select("symbol", "us", "close"), fx.funding)
