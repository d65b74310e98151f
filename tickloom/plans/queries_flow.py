"""Trade-flow, timed and generated features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import flow
from tickloom.operators.asof import bucket_prints
from tickloom.plans.fixtures import Fixtures
from tickloom.plans.queries_joins import BUCKET_SQL
from tickloom.plans.registry import query

WS = (600, 3600)
ROW = "PARTITION BY symbol ORDER BY us, seq"


def back(seconds: float, order: str = "us") -> str:
    return (
        f"(PARTITION BY symbol ORDER BY {order} RANGE BETWEEN "
        f"{round(seconds * 1e6) - 1} PRECEDING AND CURRENT ROW)"
    )


@query(
    "t1_trade_columns",
    """
    SELECT symbol, us, trade_id, price, quantity,
      CASE WHEN is_buyer_maker THEN -quantity ELSE quantity END AS signed,
      price * quantity AS notional, NOT is_buyer_maker AS is_buy, 1.0 AS count FROM fx_trades""",
    d="price quantity signed notional count",
)
def t1(fx: Fixtures) -> DataFrame:
    return flow.trade_columns(fx.trades)


def stats_sql() -> str:
    parts = []
    for s in WS:
        o = f"OVER {back(s)}"
        parts.append(
            f"count(*) {o} AS trade_count_{s}s, sum(quantity) {o} AS trade_volume_{s}s, "
            f"sum(signed) {o} AS signed_volume_{s}s, "
            f"sum(signed) {o} / sum(quantity) {o} AS trade_imbalance_{s}s, "
            f"sum(CASE WHEN is_buyer_maker THEN 0 ELSE 1 END) {o} / count(*) {o} AS buy_share_{s}s, "
            f"sum(price * quantity) {o} / sum(quantity) {o} AS trade_vwap_{s}s, "
            f"stddev_samp(price) {o} AS trade_price_std_{s}s"
        )
    return (
        "SELECT symbol, us, trade_id, " + ", ".join(parts) + " FROM (SELECT *, CASE WHEN "
        "is_buyer_maker THEN -quantity ELSE quantity END AS signed FROM fx_trades)"
    )


STAT_NAMES = [
    f"{n}_{s}s"
    for s in WS
    for n in (
        "trade_count",
        "trade_volume",
        "signed_volume",
        "trade_imbalance",
        "buy_share",
        "trade_vwap",
        "trade_price_std",
    )
]


PRICES = [n for n in STAT_NAMES if n.startswith("trade_vwap")]


@query(
    "t2_rolling_trade_stats",
    f"SELECT * REPLACE ({', '.join(f'ln({n}) AS {n}' for n in PRICES)}) FROM ({stats_sql()})",
    d=" ".join(STAT_NAMES),
    digits=6,
)
def t2(fx: Fixtures) -> DataFrame:
    made = flow.rolling_trade_stats(fx.trades, WS, spine=fx.spine)
    # Average prices over round volumes end in exact halves; their logs round the same everywhere.
    return made.withColumns({n: F.log(n) for n in PRICES})


def features_sql() -> str:
    names = ", ".join(f"CASE WHEN b.us - s.us <= 1800000000 THEN s.{n} END AS {n}" for n in STAT_NAMES)
    cols = []
    for s in WS:
        cols.append(
            f"trade_imbalance_{s}s, buy_share_{s}s, ln(1 + trade_count_{s}s) AS log_trade_count_{s}s, "
            f"ln(1 + trade_volume_{s}s) AS log_trade_volume_{s}s, "
            f"(trade_vwap_{s}s - mid) / mid * 1e4 AS vwap_dev_bp_{s}s, "
            f"trade_price_std_{s}s / mid * 1e4 AS trade_disp_bp_{s}s"
        )
    move = f"1e4 * ln(mid / lag(mid, 10) OVER ({ROW}))"
    f = "signed_volume_600s / trade_volume_600s"
    return f"""
    WITH s AS ({stats_sql()}),
    j AS (SELECT b.symbol, b.us, b.seq, (b.bid_price_0 + b.ask_price_0) / 2 AS mid, {names}
          FROM fx_book b ASOF LEFT JOIN s ON b.symbol = s.symbol AND b.us >= s.us)
    SELECT symbol, us, seq, {', '.join(cols)},
      {move} / (CASE WHEN abs({f}) > 1e-9 THEN {f} END) AS impact_600s FROM j"""


@query(
    "t3_trade_features_on_book",
    features_sql(),
    d=" ".join(
        f"{n}_{s}s"
        for s in WS
        for n in (
            "trade_imbalance buy_share log_trade_count log_trade_volume vwap_dev_bp trade_disp_bp"
        ).split()
    )
    + " impact_600s",
    digits=5,
)
def t3(fx: Fixtures) -> DataFrame:
    return flow.trade_features(
        fx.book, fx.trades, WS, tolerance_s=1800, impact=((600, 10),), spine=fx.spine
    )


@query(
    "t4_flow_buckets",
    BUCKET_SQL.format(op="p.us <= r.us"),
    d="mid buy_volume sell_volume trade_count signed_notional traded_notional largest_trade "
    "vwap_deviation_bp",
)
def t4(fx: Fixtures) -> DataFrame:
    return bucket_prints(fx.book, fx.prints)


def flow_sql() -> str:
    def w(n: int) -> str:
        return f"OVER ({ROW} ROWS {n - 1} PRECEDING)"

    cols = []
    for n in (6, 24, 120):
        b, s = f"sum(buy_volume) {w(n)}", f"sum(sell_volume) {w(n)}"
        cols.append(
            f"CASE WHEN {b} + {s} > 0 THEN ({b} - {s}) / ({b} + {s}) ELSE 0 END AS "
            f"flow_imbalance_{n}, avg(trade_count) {w(n)} AS trade_intensity_{n}"
        )
    big = f"sum(traded_notional) {w(120)}"
    mid_ = f"sum(traded_notional) {w(24)}"
    return f"""
    WITH b AS ({BUCKET_SQL.format(op="p.us <= r.us")}),
    c AS (SELECT *, CASE WHEN trade_count > 0 THEN traded_notional / trade_count END AS size_,
          sign(signed_notional) AS sg FROM b)
    SELECT symbol, us, seq, {', '.join(cols)},
      CASE WHEN {big} > 0 THEN sum(traded_notional) {w(6)} / ({big} * 0.05 + 1e-12) ELSE 1 END
        AS volume_surge,
      CASE WHEN {mid_} > 0 THEN max(largest_trade) {w(24)} / {mid_} ELSE 0 END
        AS trade_concentration,
      coalesce(CASE WHEN count(size_) {w(120)} >= 10 THEN size_ / median(size_) {w(120)} END, 1)
        AS trade_size_shock,
      vwap_deviation_bp, avg(sg) {w(24)} AS flow_persistence_24 FROM c"""


@query(
    "t5_flow_set",
    flow_sql(),
    d="flow_imbalance_6 flow_imbalance_24 flow_imbalance_120 trade_intensity_6 trade_intensity_24 "
    "trade_intensity_120 volume_surge trade_concentration trade_size_shock vwap_deviation_bp "
    "flow_persistence_24",
)
def t5(fx: Fixtures) -> DataFrame:
    return flow.flow_features(bucket_prints(fx.book, fx.prints), spine=fx.spine)


MIDS = "m AS (SELECT symbol, us, seq, (bid_price_0 + ask_price_0) / 2 AS mid FROM fx_book)"


@query(
    "t6_short_volatility",
    f"""
    WITH {MIDS},
    r AS (SELECT *, (mid / lag(mid) OVER ({ROW}) - 1) * 1e4 AS ret FROM m),
    p AS (SELECT *, sign(ret) * sign(lag(ret) OVER ({ROW})) AS prod FROM r)
    SELECT symbol, us, seq, stddev_samp(ret) OVER {back(1800)} AS volatility_bp,
      avg(prod) OVER {back(1800)} AS return_sign_autocorr FROM p""",
    d="volatility_bp return_sign_autocorr",
)
def t6(fx: Fixtures) -> DataFrame:
    return flow.short_volatility(fx.book, 1800, spine=fx.spine)


@query(
    "t7_turn_counts",
    f"""
    WITH {MIDS},
    d AS (SELECT *, sign(mid - lag(mid) OVER ({ROW})) AS dir FROM m),
    mv AS (SELECT symbol, us, seq, dir, lag(dir) OVER ({ROW}) AS pd, lag(us) OVER ({ROW}) AS pu
           FROM d WHERE dir <> 0),
    t AS (SELECT symbol, us, pu FROM mv WHERE dir = -pd)
    SELECT d.symbol, d.us, d.seq,
      count(CASE WHEN t.pu > d.us - 1800000000 THEN 1 END) AS turn_count_1800s,
      count(CASE WHEN t.pu > d.us - 7200000000 THEN 1 END) AS turn_count_7200s
    FROM d LEFT JOIN t ON t.symbol = d.symbol AND t.us <= d.us AND t.us > d.us - 7200000000
    GROUP BY 1, 2, 3""",
    d="turn_count_1800s turn_count_7200s",
)
def t7(fx: Fixtures) -> DataFrame:
    return flow.turn_counts(fx.book, (1800, 7200), spine=fx.spine)


@query(
    "t8_lag_log_changes",
    """
    SELECT d.symbol, d.us, d.seq, 1e4 * ln(d.ask_price_0 / b.ask_price_0) AS ask0_log_change_bp_600s,
      1e4 * ln(d.ask_price_0 / c.ask_price_0) AS ask0_log_change_bp_3600s,
      1e4 * ln(d.bid_price_0 / b.bid_price_0) AS bid0_log_change_bp_600s,
      1e4 * ln(d.bid_price_0 / c.bid_price_0) AS bid0_log_change_bp_3600s,
      1e4 * ln((d.bid_price_0 + d.ask_price_0) / (b.bid_price_0 + b.ask_price_0))
        AS mid_log_change_bp_600s,
      1e4 * ln((d.bid_price_0 + d.ask_price_0) / (c.bid_price_0 + c.ask_price_0))
        AS mid_log_change_bp_3600s
    FROM fx_book d ASOF LEFT JOIN fx_book b ON d.symbol = b.symbol AND d.us - 600000000 >= b.us
    ASOF LEFT JOIN fx_book c ON d.symbol = c.symbol AND d.us - 3600000000 >= c.us""",
    d="ask0_log_change_bp_600s ask0_log_change_bp_3600s bid0_log_change_bp_600s "
    "bid0_log_change_bp_3600s mid_log_change_bp_600s mid_log_change_bp_3600s",
)
def t8(fx: Fixtures) -> DataFrame:
    return flow.lag_log_changes(fx.book, (600, 3600))


@query(
    "t9_trade_run_length",
    """
    WITH p AS (SELECT symbol, us, aggressor, row_number() OVER w AS i,
        CASE WHEN aggressor = lag(aggressor) OVER w THEN 0 ELSE 1 END AS st FROM fx_prints
        WINDOW w AS (PARTITION BY symbol ORDER BY us, trade_id)),
    q AS (SELECT *, max(CASE WHEN st = 1 THEN i END) OVER (PARTITION BY symbol ORDER BY us, i) AS s0
          FROM p),
    n AS (SELECT b.symbol, b.us, b.seq, count(p.i) AS inside FROM fx_book b LEFT JOIN p
          ON p.symbol = b.symbol AND p.us <= b.us AND p.us > b.us - 3600000000 GROUP BY 1, 2, 3)
    SELECT n.symbol, n.us, n.seq, CASE WHEN inside > 0
        THEN (q.i - greatest(s0, q.i - inside + 1) + 1) * q.aggressor ELSE 0 END
        AS trade_run_length
    FROM n ASOF LEFT JOIN q ON n.symbol = q.symbol AND n.us >= q.us""",
    d="trade_run_length",
)
def t9(fx: Fixtures) -> DataFrame:
    return flow.run_lengths(fx.book, fx.prints, 3600, spine=fx.spine)


@query(
    "t10_inter_trade_time",
    """
    WITH p AS (SELECT symbol, us, lag(us) OVER (PARTITION BY symbol ORDER BY us) AS pu FROM
               (SELECT DISTINCT symbol, us FROM fx_prints))
    SELECT b.symbol, b.us, b.seq, CASE WHEN p.pu > b.us - 3600000000 THEN (p.us - p.pu) / 1e6 END
      AS inter_trade_time_s
    FROM fx_book b ASOF LEFT JOIN p ON b.symbol = p.symbol AND b.us >= p.us""",
    d="inter_trade_time_s",
)
def t10(fx: Fixtures) -> DataFrame:
    return flow.inter_trade_time(fx.book, fx.prints, 3600, spine=fx.spine)


@query(
    "t11_time_since_trade",
    """
    SELECT b.symbol, b.us, b.seq, least(coalesce((b.us - p.us) / 1e6, 900), 900)
      AS time_since_trade_s
    FROM fx_book b ASOF LEFT JOIN (SELECT * FROM fx_prints WHERE aggressor = 1) p
      ON b.symbol = p.symbol AND b.us >= p.us""",
    d="time_since_trade_s",
)
def t11(fx: Fixtures) -> DataFrame:
    buys = fx.prints.filter("aggressor = 1")
    return flow.time_since_trade(fx.book, buys, 900.0, spine=fx.spine)


@query(
    "t12_winsorised",
    f"""
    SELECT symbol, us, seq, least(greatest(x, quantile_cont(x, 0.1) OVER w),
      quantile_cont(x, 0.9) OVER w) AS x
    FROM (SELECT symbol, us, seq, ask_price_0 AS x FROM fx_book)
    WINDOW w AS {back(21600)}""",
    d="x",
)
def t12(fx: Fixtures) -> DataFrame:
    rows = fx.book.select("symbol", "us", "seq", F.col("ask_price_0").alias("x"))
    return flow.winsorise(rows, "x", 21600, (0.1, 0.9), spine=fx.spine)


@query(
    "t13_touch_size_scale",
    """
    WITH m AS (SELECT median(v) AS t FROM (SELECT bid_size_0 AS v FROM fx_book UNION ALL
               SELECT ask_size_0 FROM fx_book))
    SELECT symbol, us, seq, bid_size_0 / t AS bid_size_0, ask_size_0 / t AS ask_size_0
    FROM fx_book, m""",
    d="bid_size_0 ask_size_0",
)
def t13(fx: Fixtures) -> DataFrame:
    from tickloom.sources.store import median_touch_size

    sizes = fx.book.select("symbol", "us", "seq", "bid_size_0", "ask_size_0")
    scale = median_touch_size(fx.book)
    return sizes.join(F.broadcast(scale)).select(  # one row
        "symbol",
        "us",
        "seq",
        (F.col("bid_size_0") / F.col("touch_size")).alias("bid_size_0"),
        (F.col("ask_size_0") / F.col("touch_size")).alias("ask_size_0"),
    )


@query(
    "t14_day_with_history",
    f"""
    WITH r AS (SELECT symbol, us, trade_id, sum(size) OVER {back(3600)} AS volume FROM fx_prints)
    SELECT * FROM r WHERE us >= 1704844800000000 AND us < 1704931200000000""",
    d="volume",
)
def t14(fx: Fixtures) -> DataFrame:
    def build(prints: DataFrame) -> DataFrame:
        from tickloom.sources.prints import prints_to_trades

        stats = flow.rolling_trade_stats(prints_to_trades(prints), (3600,))
        return stats.select("symbol", "us", "trade_id", F.col("trade_volume_3600s").alias("volume"))

    return flow.day_features(fx.prints, 1_704_844_800_000_000, 3600, build)


BASE_SQL = """
    SELECT symbol, us, seq, (bid_price_0 + ask_price_0) / 2 AS mid,
      ln((bid_price_0 + ask_price_0) / 2) AS log_mid,
      1e4 * (ask_price_0 - bid_price_0) / ((bid_price_0 + ask_price_0) / 2) AS spread_bp,
      (bid_size_0 - ask_size_0) / (bid_size_0 + ask_size_0) AS queue_imbalance,
      ln(1 + bid_size_0) AS log_bid_size, ln(1 + ask_size_0) AS log_ask_size,
      ln(1 + bid_size_0 + ask_size_0) AS log_total_size, ln(bid_size_0 / ask_size_0)
        AS log_size_ratio,
      1e4 * ((bid_price_0 * ask_size_0 + ask_price_0 * bid_size_0) / (bid_size_0 + ask_size_0)
        / ((bid_price_0 + ask_price_0) / 2) - 1) AS microprice_dev_bp FROM fx_book"""
BASE_D = (
    "mid log_mid spread_bp queue_imbalance log_bid_size log_ask_size log_total_size "
    "log_size_ratio microprice_dev_bp"
)


@query("t15_base_quantities", BASE_SQL, d=BASE_D)
def t15(fx: Fixtures) -> DataFrame:
    return flow.base_quantities(fx.book)


LEVELS, DIFFS = ("spread_bp", "queue_imbalance", "microprice_dev_bp"), (
    "log_mid", "log_bid_size", "log_ask_size", "log_total_size"
)
WINDOWS, LAGS = (5, 10, 20, 50, 100, 200, 500, 1000), (1, 5, 20, 50)


def expand_sql() -> tuple[str, list[str]]:
    cols, names = [], []

    def add(expr: str, name: str) -> None:
        cols.append(f"{expr} AS {name}")
        names.append(name)

    for c in LEVELS:
        add(c, c)
        for k in LAGS:
            add(f"lag({c}, {k}) OVER w", f"{c}_lag{k}")
            add(f"{c} - lag({c}, {k}) OVER w", f"{c}_chg{k}")
        for n in WINDOWS:
            f = f"OVER ({ROW} ROWS {n - 1} PRECEDING)"
            ok = f"count({c}) {f} >= {n}"
            add(f"CASE WHEN {ok} THEN avg({c}) {f} END", f"{c}_mean{n}")
            add(f"CASE WHEN {ok} THEN stddev_samp({c}) {f} END", f"{c}_std{n}")
            add(
                f"CASE WHEN {ok} AND stddev_samp({c}) {f} > 1e-9 THEN ({c} - avg({c}) {f}) / "
                f"stddev_samp({c}) {f} WHEN {ok} THEN 0 END",
                f"{c}_z{n}",
            )
    for c in DIFFS:
        s = "1e4 * " if c == "log_mid" else ""
        for k in LAGS:
            add(f"{s}({c} - lag({c}, {k}) OVER w)", f"{c}_ret{k}")
        for n in WINDOWS:
            f = f"OVER ({ROW} ROWS {n - 1} PRECEDING)"
            ok = f"count(d_{c}) {f} >= {n}"
            add(f"CASE WHEN {ok} THEN {s}stddev_samp(d_{c}) {f} END", f"{c}_vol{n}")
            add(f"CASE WHEN {ok} THEN {s}avg(d_{c}) {f} END", f"{c}_drift{n}")
            add(f"CASE WHEN {ok} THEN {s}avg(abs(d_{c})) {f} END", f"{c}_absmean{n}")
    sql = f"""
    WITH b AS ({BASE_SQL}),
    d AS (SELECT *, {', '.join(f'{c} - lag({c}) OVER ({ROW}) AS d_{c}' for c in DIFFS)} FROM b)
    SELECT symbol, us, seq, {', '.join(cols)} FROM d WINDOW w AS ({ROW})"""
    return sql, names


EXPAND, EXPAND_NAMES = expand_sql()


@query("t16_generated_expansion", EXPAND, d=" ".join(EXPAND_NAMES))
def t16(fx: Fixtures) -> DataFrame:
    return flow.expand(
        flow.base_quantities(fx.book),
        windows=WINDOWS,
        lags=LAGS,
        levels=LEVELS,
        diffs=DIFFS,
        spine=fx.spine,
    )


EWM_SQL = f"""
    SELECT symbol, us, seq, CASE WHEN len(xs) >= 20 THEN
      list_reduce(xs, lambda y, x: y * (1 - 2.0 / 21) + x * 2.0 / 21) END AS spread_bp_ewm20
    FROM (SELECT symbol, us, seq, list(spread_bp) OVER ({ROW} ROWS UNBOUNDED PRECEDING) AS xs
          FROM ({BASE_SQL}))"""


@query("t17_exponential_mean", EWM_SQL, d="spread_bp_ewm20")
def t17(fx: Fixtures) -> DataFrame:
    return flow.ewm(flow.base_quantities(fx.book), ["spread_bp"], [20], spine=fx.spine)


TIME_SQL = """
    SELECT symbol, us, seq, sin(2 * pi() * (us // 1000000 % 86400) / 86400.0) AS tod_sin,
      cos(2 * pi() * (us // 1000000 % 86400) / 86400.0) AS tod_cos,
      sin(2 * pi() * ((us // 86400000000 + 3) % 7) / 7.0) AS dow_sin,
      cos(2 * pi() * ((us // 86400000000 + 3) % 7) / 7.0) AS dow_cos FROM fx_book"""


@query("t18_time_of_day", TIME_SQL, d="tod_sin tod_cos dow_sin dow_cos")
def t18(fx: Fixtures) -> DataFrame:
    return flow.time_of_day(fx.book)


@query(
    "t19_generated_set",
    f"""
    WITH e AS ({EXPAND.replace('WITH b AS', 'WITH b AS', 1)}), c AS ({TIME_SQL}), x AS ({EWM_SQL})
    SELECT symbol, us, seq, spread_bp_z50, queue_imbalance_mean5, log_mid_vol50, log_mid_ret20,
      spread_bp_ewm20, tod_sin, dow_cos
    FROM e JOIN c USING (symbol, us, seq) JOIN x USING (symbol, us, seq)""",
    d="spread_bp_z50 queue_imbalance_mean5 log_mid_vol50 log_mid_ret20 spread_bp_ewm20 tod_sin dow_cos",
)
def t19(fx: Fixtures) -> DataFrame:
    made = flow.generate(
        fx.book,
        fx.trades,
        windows=(5, 20, 50),
        lags=(1, 20),
        trade_windows_s=WS,
        tolerance_s=1800,
        spine=fx.spine,
    )
    return made.select(
        "symbol",
        "us",
        "seq",
        "spread_bp_z50",
        "queue_imbalance_mean5",
        "log_mid_vol50",
        "log_mid_ret20",
        "spread_bp_ewm20",
        "tod_sin",
        "dow_cos",
    )


@query(
    "t31_per_second_volatility",
    f"""
    WITH r AS (SELECT symbol, us // 86400000000 AS day,
        greatest(1, (us % 86400000000 + 899999999) // 900000000) AS slot,
        arg_max((bid_price_0 + ask_price_0) / 2, us) AS mid FROM fx_book GROUP BY 1, 2, 3),
    g AS (SELECT symbol, day, unnest(range(min(slot), 97)) AS slot FROM r GROUP BY 1, 2),
    f AS (SELECT symbol, day, slot,
        last_value(mid IGNORE NULLS) OVER (PARTITION BY symbol, day ORDER BY slot) AS mid
        FROM g LEFT JOIN r USING (symbol, day, slot)),
    c AS (SELECT *, pow(ln(mid / lag(mid) OVER (PARTITION BY symbol, day ORDER BY slot)), 2) AS sq
          FROM f),
    l AS (SELECT *, list(sq) FILTER (sq IS NOT NULL) OVER (PARTITION BY symbol, day ORDER BY slot
          ROWS UNBOUNDED PRECEDING) AS xs FROM c)
    SELECT symbol, day * 86400000000 + slot * 900000000 AS us, mid,
      sqrt(list_reduce(xs, lambda y, x: y * exp(-ln(2) / 60) + x * (1 - exp(-ln(2) / 60))) * 60)
        * 1e4 AS vol_bp FROM l""",
    d="mid vol_bp",
    digits=5,
)
def t31(fx: Fixtures) -> DataFrame:
    return flow.per_second(fx.book, 60.0, 900)
