"""Data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import quality
from tickloom.plans.fixtures import Fixtures
from tickloom.plans.registry import query

#: Prints as they arrived: every 50th comes 60 places late.
ARRIVED = """
    a AS (SELECT symbol, CASE WHEN trade_id % 97 = 0 THEN NULL ELSE us END AS us,
      CASE WHEN trade_id % 83 = 0 THEN 0 ELSE price END AS price, size AS quantity,
      trade_id - CASE WHEN trade_id % 71 = 0 THEN 5 ELSE 0 END AS trade_id,
      trade_id * 2 + CASE WHEN trade_id % 50 = 0 THEN 121 ELSE 0 END AS recv FROM fx_prints)"""


def arrived(fx: Fixtures) -> DataFrame:
    t = F.col("trade_id")
    return fx.prints.select(
        "symbol",
        F.when(t % 97 != 0, F.col("us")).alias("us"),
        F.when(t % 83 == 0, F.lit(0.0)).otherwise(F.col("price")).alias("price"),
        F.col("size").alias("quantity"),
        (t - F.when(t % 71 == 0, 5).otherwise(0)).alias("trade_id"),
        (t * 2 + F.when(t % 50 == 0, 121).otherwise(0)).alias("recv"),
    )


@query(
    "q1_schema_and_empty",
    """
    SELECT 'prints' AS plane, count(*) AS rows, count(*) = 0 AS is_empty,
      true AS has_columns FROM fx_prints""",
)
def q1(fx: Fixtures) -> DataFrame:
    from tickloom.sources.contracts import ContractError, check_contract
    from tickloom.sources.prints import assemble
    from tickloom.sources.contracts import PRINTS as CONTRACT

    frame = assemble(fx.prints, "events")
    try:
        check_contract(frame, CONTRACT)
        ok = True
    except ContractError:
        ok = False
    rows = frame.agg(F.count(F.lit(1)).alias("rows"))
    return rows.select(
        F.lit("prints").alias("plane"),
        "rows",
        (F.col("rows") == 0).alias("is_empty"),
        F.lit(ok).alias("has_columns"),
    )


@query(
    "q2_timestamps",
    f"""
    WITH {ARRIVED},
    s AS (SELECT *, us < lag(us) OVER (PARTITION BY symbol ORDER BY recv) AS back FROM a
          WHERE us IS NOT NULL)
    SELECT symbol, (SELECT count(*) FROM a WHERE a.symbol = s.symbol AND us IS NULL)
        AS timestamp_null, count_if(back) AS timestamp_monotonic, min(us) AS first_us,
      max(us) AS last_us FROM s GROUP BY symbol""",
    i="timestamp_monotonic",
)
def q2(fx: Fixtures) -> DataFrame:
    return quality.timestamp_checks(arrived(fx), "recv")


@query(
    "q3_positive_values",
    f"""
    WITH {ARRIVED}
    SELECT symbol, 'price' AS "column", count_if(price IS NULL OR price <= 0) AS bad
    FROM a GROUP BY 1 UNION ALL
    SELECT symbol, 'quantity', count_if(quantity IS NULL OR quantity <= 0) FROM a GROUP BY 1""",
    i="bad",
)
def q3(fx: Fixtures) -> DataFrame:
    return quality.positive_checks(arrived(fx), ["price", "quantity"])


@query(
    "q4_trade_ids",
    f"""
    WITH {ARRIVED},
    s AS (SELECT *, trade_id - lag(trade_id) OVER (PARTITION BY symbol ORDER BY recv) AS step
          FROM a)
    SELECT symbol, count(*) - count(DISTINCT trade_id) AS duplicates,
      count_if(step < 0) AS decreasing, count_if(step <= 0) AS not_increasing,
      count_if(step > 1) AS gaps, sum(CASE WHEN step > 1 THEN step - 1 ELSE 0 END) AS missing
    FROM s GROUP BY 1""",
    i="decreasing not_increasing gaps missing",
)
def q4(fx: Fixtures) -> DataFrame:
    return quality.id_checks(arrived(fx), "trade_id", "recv")


@query(
    "q4_trade_findings",
    f"""
    WITH {ARRIVED},
    s AS (SELECT *, trade_id - lag(trade_id) OVER (PARTITION BY symbol ORDER BY recv) AS step
          FROM a),
    u AS (SELECT symbol, us < lag(us) OVER (PARTITION BY symbol ORDER BY recv) AS back FROM a
          WHERE us IS NOT NULL),
    f AS (
      SELECT 'timestamp_null' AS "check", 'error' AS severity, symbol, count_if(us IS NULL) AS n
        FROM a GROUP BY symbol
      UNION ALL SELECT 'timestamp_monotonic', 'error', symbol, count_if(back) FROM u GROUP BY symbol
      UNION ALL SELECT 'positive_values', 'error', symbol,
        count_if(price <= 0) + count_if(quantity <= 0) FROM a GROUP BY symbol
      UNION ALL SELECT 'trade_id_unique', 'error', symbol, count(*) - count(DISTINCT trade_id)
        FROM s GROUP BY symbol
      UNION ALL SELECT 'trade_id_gaps', 'info', symbol, count_if(step > 1) FROM s GROUP BY symbol
      UNION ALL SELECT 'trade_id_monotonic', 'error', symbol, count_if(step < 0)
        FROM s GROUP BY symbol)
    SELECT "check", severity, symbol, n AS count FROM f WHERE n > 0""",
    i="count",
)
def q4b(fx: Fixtures) -> DataFrame:
    return quality.validate_trades(arrived(fx), "recv")


@query(
    "q5_bar_rules",
    """
    WITH b AS (SELECT symbol, us, open_us, open, close,
      CASE WHEN hour % 7 = 0 THEN close + 1 ELSE low END AS low, high FROM fx_bars
      UNION ALL SELECT symbol, us, us AS open_us, open, close, low, high FROM fx_bars
      WHERE hour % 11 = 0)
    SELECT symbol, count_if(low > least(open, close) OR high < greatest(open, close)) AS bar_range,
      count_if(open_us >= us) AS bar_order, count(*) - count(DISTINCT us) AS bar_unique
    FROM b GROUP BY 1""",
    i="bar_range bar_order",
)
def q5(fx: Fixtures) -> DataFrame:
    low = F.when(F.col("hour") % 7 == 0, F.col("close") + 1).otherwise(F.col("low"))
    bad = fx.bars.withColumn("low", low)
    twice = fx.bars.filter("hour % 11 = 0").withColumn("open_us", F.col("us"))
    return quality.bar_checks(bad.unionByName(twice))


@query(
    "q6_crossed_locked",
    """
    SELECT symbol, count_if(bid_price_0 > ask_price_0) AS not_crossed,
      count_if(bid_price_0 = ask_price_0) AS not_locked FROM fx_book_raw GROUP BY 1""",
    i="not_crossed not_locked",
)
def q6(fx: Fixtures) -> DataFrame:
    return quality.crossed_checks(fx.book_raw)


@query(
    "q7_level_order",
    "WITH b AS (SELECT * REPLACE (CASE WHEN seq % 13 = 0 THEN bid_price_1 ELSE bid_price_2 END AS "
    "bid_price_2, CASE WHEN seq % 17 = 0 THEN ask_price_4 ELSE ask_price_3 END AS ask_price_3) "
    "FROM fx_book) "
    + " UNION ALL ".join(
        f"SELECT symbol, {i} AS level, count_if(bid_price_{i} <= bid_price_{i + 1}) AS bad_bids, "
        f"count_if(ask_price_{i} >= ask_price_{i + 1}) AS bad_asks FROM b GROUP BY symbol"
        for i in range(4)
    ),
    i="level bad_bids bad_asks",
)
def q7(fx: Fixtures) -> DataFrame:
    bid = F.when(F.col("seq") % 13 == 0, F.col("bid_price_1")).otherwise(F.col("bid_price_2"))
    ask = F.when(F.col("seq") % 17 == 0, F.col("ask_price_4")).otherwise(F.col("ask_price_3"))
    return quality.level_order_checks(fx.book.withColumns({"bid_price_2": bid, "ask_price_3": ask}), 5)


@query(
    "q8_sequence",
    """
    WITH s AS (SELECT symbol, seq, seq - lag(seq) OVER (PARTITION BY symbol ORDER BY us, seq)
      AS step FROM fx_book)
    SELECT symbol, count(*) - count(DISTINCT seq) AS duplicates, count_if(step < 0) AS decreasing,
      count_if(step <= 0) AS not_increasing, count_if(step > 1) AS gaps,
      sum(CASE WHEN step > 1 THEN step - 1 ELSE 0 END) AS missing FROM s GROUP BY 1""",
    i="decreasing not_increasing gaps missing",
)
def q8(fx: Fixtures) -> DataFrame:
    # The book arrives in stamp order, so the stamp is the arrival counter here.
    book = fx.book.select("symbol", "seq", F.col("us").alias("at"))
    from tickloom.operators.quality import id_checks

    return id_checks(book.withColumn("at", F.floor(F.col("at") / 1_000).cast("long")), "seq", "at")


@query(
    "q9_time_gaps",
    """
    WITH g AS (SELECT symbol, us, us - lag(us) OVER (PARTITION BY symbol ORDER BY us, seq) AS gap
               FROM fx_book),
    t AS (SELECT symbol, max(us) - min(us) AS span,
      greatest(1000.0, least(30e6, (max(us) - min(us)) * 0.05)) AS threshold,
      median(gap) AS median_gap FROM g GROUP BY 1)
    SELECT symbol, threshold, count_if(gap > threshold) AS pauses, max(gap) AS longest,
      any_value(median_gap) AS median_gap,
      sum(CASE WHEN gap > threshold THEN gap ELSE 0 END) / any_value(span) AS share_lost
    FROM g JOIN t USING (symbol) WHERE gap IS NOT NULL GROUP BY 1, 2""",
    d="threshold median_gap share_lost",
    i="pauses",
)
def q9(fx: Fixtures) -> DataFrame:
    return quality.time_gaps(fx.book)


@query(
    "q9_longest_gaps",
    """
    WITH g AS (SELECT symbol, us, us - lag(us) OVER (PARTITION BY symbol ORDER BY us, seq) AS gap
               FROM fx_book),
    r AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY gap DESC, us) AS rank,
          us, gap FROM g WHERE gap IS NOT NULL)
    SELECT * FROM r WHERE rank <= 3""",
)
def q9b(fx: Fixtures) -> DataFrame:
    return quality.longest_gaps(fx.book)


EXCLUDED = """
    s AS (SELECT symbol, us // 86400000000 AS d, bid_price_0, ask_price_0,
      seq - lag(seq) OVER (PARTITION BY symbol ORDER BY us, seq) AS step FROM fx_book_raw),
    f AS (SELECT symbol, d, count_if(bid_price_0 <= 0 OR ask_price_0 <= 0) AS np,
      count_if(abs(round(bid_price_0 / 0.05) * 0.05 - bid_price_0) > 5e-8
            OR abs(round(ask_price_0 / 0.05) * 0.05 - ask_price_0) > 5e-8) AS og,
      count_if(step > 1) AS gaps FROM s GROUP BY 1, 2)"""


@query(
    "q10_day_exclusions",
    f"""
    WITH {EXCLUDED}
    SELECT reason, count(*) AS days FROM (
      SELECT 'non_positive_price' AS reason FROM f WHERE np > 0
      UNION ALL SELECT 'off_grid_price' FROM f WHERE og > 0
      UNION ALL SELECT 'sequence_gaps' FROM f WHERE gaps > 50) GROUP BY 1""",
)
def q10(fx: Fixtures) -> DataFrame:
    return quality.exclusion_counts(quality.day_exclusions(fx.book_raw, 0.05, 50))


@query(
    "q10_block_unreadable",
    f"""
    WITH {EXCLUDED}
    SELECT symbol, count(*) AS days, count_if(og > 0 OR gaps > 50 OR np > 0) AS excluded,
      count_if(og > 0 OR gaps > 50 OR np > 0) * 4 > count(*) AS unreadable FROM f GROUP BY 1""",
    i="excluded",
)
def q10b(fx: Fixtures) -> DataFrame:
    return quality.block_unreadable(quality.day_exclusions(fx.book_raw, 0.05, 50))


@query(
    "q11_price_tick",
    """
    WITH v AS (SELECT DISTINCT symbol, CAST(round(price * 1e8) AS BIGINT) AS v FROM fx_prints),
    d AS (SELECT symbol, v - lag(v) OVER (PARTITION BY symbol ORDER BY v) AS d FROM v)
    SELECT symbol, list_reduce(list(d), lambda x, y: gcd(x, y)) / 1e8 AS tick
    FROM d WHERE d IS NOT NULL GROUP BY 1""",
    d="tick",
    digits=9,
)
def q11(fx: Fixtures) -> DataFrame:
    return quality.grid_step(fx.prints, F.col("price"), "tick")


@query(
    "q11_size_lot",
    """
    SELECT symbol, list_reduce(list(v), lambda x, y: gcd(x, y)) / 1e8 AS lot FROM
      (SELECT DISTINCT symbol, CAST(round(size * 1e8) AS BIGINT) AS v FROM fx_prints) GROUP BY 1""",
    d="lot",
    digits=9,
)
def q11b(fx: Fixtures) -> DataFrame:
    return quality.grid_step(fx.prints, F.col("size"), "lot", differences=False)


@query(
    "q11_off_grid_rows",
    """
    SELECT symbol, count_if(abs(round(price / 0.05) * 0.05 - price) > 5e-8) AS off_grid
    FROM fx_prints GROUP BY 1""",
    i="off_grid",
)
def q11c(fx: Fixtures) -> DataFrame:
    steps = fx.prints.select("symbol").distinct().withColumn("tick", F.lit(0.05))
    return quality.off_grid_rows(fx.prints, "price", steps, "tick")


@query(
    "q12_gap_allowance",
    f"""
    WITH {EXCLUDED}
    SELECT CAST(ceil(round(quantile_cont(gaps, 0.95), 9)) AS BIGINT) AS max_sequence_gaps
    FROM f""",
)
def q12(fx: Fixtures) -> DataFrame:
    return quality.gap_allowance(quality.day_exclusions(fx.book_raw, 0.05, 50))


@query(
    "q13_settlement_interval",
    """
    WITH g AS (SELECT symbol, us, us - lag(us) OVER (PARTITION BY symbol ORDER BY us) AS gap
               FROM fx_funding)
    SELECT symbol, CASE WHEN min(gap) = max(gap) AND min(gap) % 3600000000 = 0
      AND min(us) % min(gap) = 0 THEN min(gap) // 3600000000 WHEN min(gap) IS NOT NULL THEN -1 END
      AS interval_h FROM g GROUP BY 1""",
    i="interval_h",
)
def q13(fx: Fixtures) -> DataFrame:
    return quality.settlement_interval(fx.funding, refuse=False)


@query(
    "q14_coverage",
    """
    SELECT avg(CASE WHEN l THEN 1.0 ELSE 0.0 END) AS coverage FROM (
      SELECT lag(bid_price_0, 20) OVER (PARTITION BY symbol ORDER BY us, seq) IS NOT NULL AS l
      FROM fx_book)""",
    d="coverage",
)
def q14(fx: Fixtures) -> DataFrame:
    from tickloom.functions.book import build_features

    names = ["spread_bp", "mid_return_20_bp"]
    return quality.coverage(build_features(fx.book, names, spine=fx.spine), names)


CLOCK_PROFILE = """
    WITH s AS (SELECT symbol, us, 1 AS side, bid_price_0 AS px, bid_size_0 AS sz,
        lag(bid_price_0) OVER w AS was, lag(bid_size_0) OVER w AS sz_was FROM fx_book_raw
        WINDOW w AS (PARTITION BY symbol ORDER BY us, seq)
      UNION ALL SELECT symbol, us, -1, ask_price_0, ask_size_0, lag(ask_price_0) OVER w,
        lag(ask_size_0) OVER w FROM fx_book_raw
        WINDOW w AS (PARTITION BY symbol ORDER BY us, seq)),
    p AS (SELECT symbol, us + d * 1000 AS at, d, -aggressor AS side, price, size
          FROM fx_prints, (VALUES (-600000), (0), (600000)) t(d)),
    k AS (SELECT p.symbol, b.us, p.side, p.d, p.price, sum(p.size) AS traded FROM p ASOF JOIN
          fx_book_raw b ON p.symbol = b.symbol AND p.at <= b.us GROUP BY ALL),
    r AS (SELECT s.side, d.d, s.sz_was - coalesce(k.traded, 0) - s.sz AS res FROM s
          CROSS JOIN (VALUES (-600000), (0), (600000)) d(d)
          LEFT JOIN k ON k.symbol = s.symbol AND k.us = s.us AND k.side = s.side AND k.d = d.d
            AND k.price = s.px WHERE s.px = s.was),
    m AS (SELECT side, d, avg(res * res) AS q, avg(CASE WHEN res < -1e-12 THEN 1.0 ELSE 0.0 END)
          AS n FROM r GROUP BY 1, 2)
    SELECT d AS delta_ms, avg(q) AS mean_sq_residual, avg(n) AS share_negative FROM m GROUP BY 1"""


@query(
    "q15_clock_offset",
    CLOCK_PROFILE,
    d="mean_sq_residual share_negative",
    i="delta_ms",
)
def q15(fx: Fixtures) -> DataFrame:
    # Prints are minutes apart in these tables, so the shifts are minutes too.
    return quality.clock_offset_profile(fx.book_raw, fx.prints, (-600_000, 0, 600_000))


@query(
    "q15_best_clock_offset",
    f"SELECT delta_ms FROM ({CLOCK_PROFILE}) ORDER BY mean_sq_residual, delta_ms LIMIT 1",
    i="delta_ms",
)
def q15b(fx: Fixtures) -> DataFrame:
    return quality.best_clock_offset(q15(fx))
