"""Cross-sectional, positioning, normalised and tensor features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import panel, regime, tensor
from tickloom.functions.book import available_depth
from tickloom.operators.grid import hourly_closes
from tickloom.operators.asof import bucket_prints
from tickloom.plans.fixtures import Fixtures
from tickloom.plans.queries_book import roll
from tickloom.plans.queries_flow import back
from tickloom.plans.queries_joins import BUCKET_SQL
from tickloom.plans.registry import query

ROW = "PARTITION BY symbol ORDER BY us, seq"

CLOCK = """
    lim AS (SELECT max(a) AS a, min(b) AS b FROM
            (SELECT min(us) AS a, max(us) AS b FROM fx_bars GROUP BY symbol)),
    hg AS (SELECT symbol, unnest(range(min(us), max(us) + 1, 3600000000)) AS us
           FROM fx_bars GROUP BY 1),
    hf AS (SELECT symbol, us, last_value(close IGNORE NULLS) OVER
             (PARTITION BY symbol ORDER BY us) AS close
           FROM hg LEFT JOIN fx_bars USING (symbol, us)),
    hp AS (SELECT symbol, us, close, ln(close) AS log_price FROM hf, lim WHERE us >= a AND us <= b)"""


def clock_prices(fx: Fixtures) -> DataFrame:
    """Hourly closes of every symbol on the stamps they all cover."""
    filled = hourly_closes(fx.bars)
    spans = filled.groupBy("symbol").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    lim = spans.agg(F.max("a").alias("a"), F.min("b").alias("b"))
    return (
        filled.join(F.broadcast(lim))  # one row
        .filter("us >= a AND us <= b")
        .select("symbol", "us", "close", F.log("close").alias("log_price"))
    )


def cross_sql() -> tuple[str, list[str]]:
    names, cols, moves, at = [], [], [], []
    h = "OVER (PARTITION BY symbol ORDER BY us)"
    for n in (6, 24):
        moves.append(
            f"(log_price - lag(log_price, {n}) {h}) * 1e4 AS own_{n}, "
            f"(lead_log - lag(lead_log, {n}) {h}) * 1e4 AS lr_{n}"
        )
        at.append(
            f"count(own_{n}) OVER u AS n_{n}, sum(own_{n}) OVER u AS s_{n}, "
            f"rank() OVER (PARTITION BY us ORDER BY own_{n}) + (count(*) OVER "
            f"(PARTITION BY us, own_{n}) - 1) / 2.0 AS rk_{n}"
        )
        # The dispersion is checked against its definition: the deviation of the others' moves.
        cols.append(
            f"lr_{n} AS leader_return_{n}, (s_{n} - own_{n}) / (n_{n} - 1) AS index_return_{n}, "
            f"lr_{n} - own_{n} AS catch_up_leader_{n}, "
            f"(s_{n} - own_{n}) / (n_{n} - 1) - own_{n} AS catch_up_index_{n}, "
            f"(SELECT stddev_samp(o.own_{n}) FROM m o WHERE o.us = q.us AND o.symbol <> q.symbol) "
            f"AS dispersion_{n}, CASE WHEN own_{n} IS NOT NULL THEN rk_{n} / n_{n} END "
            f"AS relative_rank_{n}"
        )
        names += [
            f"{x}_{n}"
            for x in (
                "leader_return index_return catch_up_leader catch_up_index dispersion relative_rank"
            ).split()
        ]
    beta = "CASE WHEN nb >= 30 THEN least(5, greatest(-5, cv / vr)) END"
    f = "OVER (PARTITION BY symbol ORDER BY us ROWS 119 PRECEDING)"
    sql = f"""
    WITH {CLOCK},
    ld AS (SELECT symbol, (SELECT min(symbol) FROM fx_bars o WHERE o.symbol <> b.symbol) AS leader
           FROM (SELECT DISTINCT symbol FROM fx_bars) b),
    j AS (SELECT hp.symbol, hp.us, hp.log_price, t.log_price AS lead_log FROM hp JOIN ld USING
          (symbol) LEFT JOIN hp t ON t.symbol = ld.leader AND t.us = hp.us),
    m AS (SELECT symbol, us, {', '.join(moves)}, (log_price - lag(log_price) {h}) * 1e4 AS sa,
          (lead_log - lag(lead_log) {h}) * 1e4 AS sb FROM j),
    e AS (SELECT *, covar_samp(sa, sb) {f} AS cv, var_samp(sb) {f} AS vr, count(sa) {f} AS nb
          FROM m),
    q AS (SELECT *, {', '.join(at)} FROM e WINDOW u AS (PARTITION BY us))
    SELECT symbol, us, {', '.join(cols)}, {beta} AS beta_to_leader,
      ({beta}) * lr_24 - own_24 AS beta_adjusted_catch_up,
      CASE WHEN abs(own_24) < 1e-8 THEN 1.0 ELSE 0.0 END AS own_stale FROM q"""
    return sql, [*names, "beta_to_leader", "beta_adjusted_catch_up", "own_stale"]


CROSS, CROSS_NAMES = cross_sql()


@query("t20_cross_features", CROSS, d=" ".join(CROSS_NAMES))
def t20(fx: Fixtures) -> DataFrame:
    return panel.cross_features(
        clock_prices(fx).drop("close"), windows=(6, 24), beta_window=120
    )


def past_z(x: str, n: int) -> str:
    f = f"OVER (PARTITION BY symbol ORDER BY us ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    iqr = f"(quantile_cont({x}, 0.75) {f} - quantile_cont({x}, 0.25) {f})"
    return (
        f"CASE WHEN count({x}) {f} >= {min(n, max(3, n // 4))} AND {iqr} > 0 THEN "
        f"({x} - median({x}) {f}) / ({iqr} / 1.349) END"
    )


@query(
    "t21_positioning",
    f"""
    WITH m AS (SELECT b.symbol, b.us, ln(volume) AS oi, ln(close / 100) AS c, ln(high / low + 1)
        AS s, f.rate * 1e4 AS fb FROM fx_bars b ASOF LEFT JOIN fx_funding f
        ON b.symbol = f.symbol AND b.us >= f.us)
    SELECT symbol, us, oi AS log_open_interest,
      oi - lag(oi, 12) OVER (PARTITION BY symbol ORDER BY us) AS open_interest_change_12,
      {past_z('oi', 12)} AS open_interest_z12, c AS log_crowd_ratio,
      {past_z('c', 12)} AS crowd_ratio_z12, s AS log_size_ratio, {past_z('s', 12)} AS size_ratio_z12,
      c - s AS crowd_minus_size, {past_z('(c - s)', 12)} AS crowd_minus_size_z12,
      fb AS funding_bp, {past_z('fb', 24)} AS funding_bp_z24 FROM m""",
    d="log_open_interest open_interest_change_12 open_interest_z12 log_crowd_ratio crowd_ratio_z12 "
    "log_size_ratio size_ratio_z12 crowd_minus_size crowd_minus_size_z12 funding_bp funding_bp_z24",
)
def t21(fx: Fixtures) -> DataFrame:
    metrics = fx.bars.select(
        "symbol",
        "us",
        F.col("volume").alias("sum_open_interest"),
        (F.col("close") / 100).alias("count_long_short_ratio"),
        (F.col("high") / F.col("low") + 1).alias("sum_toptrader_long_short_ratio"),
    )
    return panel.positioning_features(
        metrics, funding=fx.funding, windows=(12,), funding_window=24
    )


def normal_sql(x: str, n: int, least: int, src: str, floor: str | None = None) -> str:
    f = f"({ROW} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"

    def past(fn: str, y: str, *more: str) -> str:
        args = ", ".join([y, *more])
        return f"CASE WHEN count({y}) OVER {f} >= {least} THEN {fn}({args}) OVER {f} END"

    scale = "CASE WHEN sc > 0 THEN sc ELSE fb END"
    if floor:
        scale = f"greatest({scale}, {floor})"
    return f"""
    a AS (SELECT symbol, us, seq, {x} AS x, {past('median', x)} AS ce,
      (({past('quantile_cont', x, '0.75')}) - ({past('quantile_cont', x, '0.25')})) / 1.349 AS sc
      FROM {src}),
    b AS (SELECT *, abs(x - ce) AS dv FROM a),
    c AS (SELECT *, ({past('avg', 'dv')}) * 1.4826 AS fb FROM b),
    n AS (SELECT symbol, us, seq, CASE WHEN ce IS NOT NULL THEN
      least(8, greatest(-8, coalesce((x - ce) / (CASE WHEN ({scale}) > 0 THEN {scale} END), 0)))
      END AS {x} FROM c)"""


@query(
    "t22_rolling_normaliser",
    f"WITH {normal_sql('bid_size_0', 60, 15, 'fx_book')} SELECT * FROM n",
    d="bid_size_0",
    digits=8,
)
def t22(fx: Fixtures) -> DataFrame:
    return panel.normalised(fx.book, ["bid_size_0"], window=60, spine=fx.spine)


SCALES = f"""
    sc AS (SELECT ({roll('quantile_cont(bid_size_0, 0.75)', 60, 15)}
      - {roll('quantile_cont(bid_size_0, 0.25)', 60, 15)}) / 1.349 AS s FROM fx_book)"""


@query(
    "t23_scale_floors",
    f"""
    WITH {SCALES} SELECT greatest(quantile_cont(s, 0.1), 0.05 * median(s), 1e-6) AS bid_size_0
    FROM sc""",
    d="bid_size_0",
)
def t23(fx: Fixtures) -> DataFrame:
    return panel.scale_floors(fx.book, ["bid_size_0"], window=60, spine=fx.spine)


@query(
    "t24_pooled_normalisation",
    f"""
    WITH {SCALES}, fl AS (SELECT greatest(quantile_cont(s, 0.1), 0.05 * median(s), 1e-6) AS v
      FROM sc), {normal_sql('bid_size_0', 60, 15, 'fx_book', '(SELECT v FROM fl)')}
    SELECT symbol, us, seq, bid_size_0 FROM n""",
    d="bid_size_0",
    digits=8,
)
def t24(fx: Fixtures) -> DataFrame:
    floors = panel.scale_floors(fx.book, ["bid_size_0"], window=60, spine=fx.spine)
    return panel.normalised(
        fx.book, ["bid_size_0"], window=60, floors=floors, spine=fx.spine
    )


PANEL = f"""
    WITH {CLOCK},
    p AS (SELECT hp.symbol, hp.us, hp.close AS mid, 5 + hp.close % 3 AS spread_bp,
      hp.close % 1 - 0.5 AS imbalance, ln(hp.close) AS lm FROM hp),
    r AS (SELECT *, (lm - lag(lm) OVER h) * 1e4 AS r1, (lead(lm, 7) OVER h - lead(lm, 1) OVER h) * 1e4
      AS fwd, lead(spread_bp, 1) OVER h / 2 + lead(spread_bp, 7) OVER h / 2 + 11 AS cost
      FROM p WINDOW h AS (PARTITION BY symbol ORDER BY us)),
    x AS (SELECT *, avg(r1) OVER u AS idx, fwd - avg(fwd) OVER u AS target, r1 - avg(r1) OVER u
      AS rel_1 FROM r WINDOW u AS (PARTITION BY us))"""


def panel_input(fx: Fixtures) -> DataFrame:
    close = F.col("close")
    return clock_prices(fx).select(
        "symbol",
        "us",
        close.alias("mid"),
        (F.lit(5) + close % 3).alias("spread_bp"),
        (close % 1 - 0.5).alias("imbalance"),
    )


def hroll(fn: str, n: int) -> str:
    inner = fn[fn.index("(") + 1 : -1]
    f = f"OVER (PARTITION BY symbol ORDER BY us ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({inner}) {f} >= {n} THEN {fn} {f} END"


@query(
    "t25_minute_cross_section",
    f"""
    {PANEL}
    SELECT symbol, us, rel_1, {hroll('sum(rel_1)', 5)} AS rel_5, {hroll('sum(rel_1)', 10)} AS rel_10,
      {hroll('sum(idx)', 10)} AS idx_10, {hroll('stddev_samp(rel_1)', 20)} AS vol_20,
      {hroll('stddev_samp(idx)', 20)} AS idx_vol_20, spread_bp, imbalance,
      {hroll('avg(imbalance)', 10)} AS imbalance_10, target, fwd, cost FROM x""",
    d="rel_1 rel_5 rel_10 idx_10 vol_20 idx_vol_20 spread_bp imbalance imbalance_10 target fwd cost",
)
def t25(fx: Fixtures) -> DataFrame:
    return panel.minute_inputs(
        panel_input(fx), sums=(5, 10), index_sums=(10,), vol=20, smooth=10, hold=6
    )


@query(
    "t26_cross_section_z",
    f"""
    {PANEL},
    z AS (SELECT symbol, us, target, rel_1, (target - avg(target) OVER u) / (CASE WHEN
      stddev_pop(target) OVER u > 0 THEN stddev_pop(target) OVER u ELSE 1 END) AS z
      FROM x WINDOW u AS (PARTITION BY us)),
    k AS (SELECT avg(rel_1) AS m, stddev_pop(rel_1) AS s FROM z)
    SELECT symbol, us, CASE WHEN z IS NULL THEN 0 ELSE least(3, greatest(-3, z)) END AS target_z,
      CASE WHEN rel_1 IS NULL THEN 0 ELSE least(5, greatest(-5, (rel_1 - m) / s)) END AS rel_1
    FROM z, k""",
    d="target_z rel_1",
)
def t26(fx: Fixtures) -> DataFrame:
    inputs = panel.minute_inputs(
        panel_input(fx), sums=(5,), index_sums=(5,), vol=5, smooth=5, hold=6
    ).select("symbol", "us", "rel_1", "target")
    scored = panel.cross_section_z(inputs, "target")
    scaler = panel.training_scaler(inputs, ["rel_1"])
    return panel.scaled(scored.drop("target"), scaler, ["rel_1"])


@query(
    "t27_monthly_features",
    """
    WITH s AS (SELECT *, (perp / spot - 1) * 1e4 AS basis,
        CASE WHEN lag(month) OVER w = month THEN ln(spot / lag(spot) OVER w) END AS step
        FROM fx_carry WINDOW w AS (PARTITION BY coin ORDER BY day)),
    m AS (SELECT coin, month, sum(rate) * 1e4 AS paid, count(*) AS n, count_if(rate > 0) AS pos,
        avg(basis) AS basis_1, avg(CASE WHEN day = last_day(month) THEN basis END) AS basis_end,
        arg_min(spot, day) AS s0, arg_max(spot, day) AS s1, stddev_samp(step) AS vol,
        day(last_day(month)) AS days, list(rate * 1e4) AS rates FROM s GROUP BY coin, month),
    f AS (SELECT coin, month, row_number() OVER w AS k, lag(paid) OVER w / lag(days) OVER w AS f1,
        sum(paid) OVER p / sum(days) OVER p AS f3,
        list_aggregate(flatten(list(rates) OVER p), 'stddev_samp') AS f_sd,
        sum(pos) OVER p / sum(n) OVER p AS f_pos, lag(basis_1) OVER w AS basis_1,
        lag(basis_end) OVER w AS basis_end, ln(lag(s1) OVER w / lag(s0) OVER w) AS ret_1,
        ln(lag(s1) OVER w / lag(s0, 3) OVER w) AS ret_3, lag(vol) OVER w * 1e4 AS vol_1,
        paid / days AS target FROM m
        WINDOW w AS (PARTITION BY coin ORDER BY month),
          p AS (PARTITION BY coin ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
    g AS (SELECT * FROM f WHERE k > 3)
    SELECT coin, month, f1, f3, f1 - f3 AS f_trend, f_sd, f_pos, basis_1, basis_end, ret_1, ret_3,
      vol_1, (rank() OVER (PARTITION BY month ORDER BY round(f3, 9)) +
        (count(*) OVER (PARTITION BY month, round(f3, 9)) - 1) / 2.0) / count(*) OVER (PARTITION BY month)
        AS rank_f3, target FROM g""",
    d="f1 f3 f_trend f_sd f_pos basis_1 basis_end ret_1 ret_3 vol_1 rank_f3 target",
)
def t27(fx: Fixtures) -> DataFrame:
    return panel.monthly_features(fx.carry)


@query(
    "t28_trailing_autocorrelation",
    f"""
    WITH {CLOCK},
    i AS (SELECT us, avg(log_price) AS x, row_number() OVER (ORDER BY us) - 1 AS r FROM hp
          GROUP BY us),
    p AS (SELECT r, (x - lag(x, 3) OVER (ORDER BY r)) * 1e4 AS past,
          (lead(x, 3) OVER (ORDER BY r) - x) * 1e4 AS nxt FROM i),
    d AS (SELECT unnest(range(0, 60)) AS d, (SELECT max(r) FROM i) AS last)
    SELECT 'index' AS symbol, d, d * 24 + 96 AS start_row, count(*) AS pairs,
      corr(past, nxt) AS autocorrelation
    FROM d JOIN p ON r >= d * 24 + 96 - 96 - 3 AND r < d * 24 + 96 - 3 AND past IS NOT NULL
      AND nxt IS NOT NULL AND d * 24 + 96 <= last GROUP BY d HAVING count(*) >= 50""",
    d="autocorrelation",
)
def t28(fx: Fixtures) -> DataFrame:
    index = clock_prices(fx).groupBy("us").agg(F.avg("log_price").alias("index")).select(
        F.lit("index").alias("symbol"), "us", "index"
    )
    from tickloom.operators.chunks import BARS

    out = panel.trailing_autocorrelation(
        index, 3, 96, 24, least=50, known_at_open=True, layout=BARS
    )
    return out.select("symbol", "d", "start_row", "pairs", "autocorrelation")


@query(
    "t28_index_autocorrelation",
    f"""
    WITH {CLOCK},
    i AS (SELECT us, avg(log_price) AS x FROM hp GROUP BY us),
    p AS (SELECT (x - lag(x, 3) OVER w) * 1e4 AS past, (lead(x, 3) OVER w - x) * 1e4 AS nxt FROM i
          WINDOW w AS (ORDER BY us))
    SELECT 'index' AS symbol, corr(past, nxt) AS autocorrelation FROM p""",
    d="autocorrelation",
)
def t28b(fx: Fixtures) -> DataFrame:
    index = clock_prices(fx).groupBy("us").agg(F.avg("log_price").alias("index")).select(
        F.lit("index").alias("symbol"), "us", "index"
    )
    return panel.index_autocorrelation(index, 3)


@query(
    "t29_hour_profile",
    """
    SELECT us // 3600000000 % 24 AS hour, sqrt(avg(ret * ret)) AS rms FROM
      (SELECT us, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY us)) AS ret FROM fx_bars)
    WHERE ret IS NOT NULL GROUP BY 1""",
    d="rms",
    digits=9,
)
def t29(fx: Fixtures) -> DataFrame:
    return regime.hour_profile(regime.hourly_returns(fx.bars))


@query(
    "t30_windows_of_rows",
    f"""
    SELECT symbol, us, seq, len(xs) AS length, list_sum(xs) AS total, xs[1] AS first_value
    FROM (SELECT symbol, us, seq, list(bid_price_0) OVER ({ROW} ROWS 15 PRECEDING) AS xs
          FROM fx_book) WHERE len(xs) = 16""",
    d="total first_value",
    i="length",
)
def t30(fx: Fixtures) -> DataFrame:
    built = tensor.windows_of_rows(fx.book, ["bid_price_0"], 16, spine=fx.spine)
    xs = F.col("bid_price_0")
    return built.select(
        "symbol",
        "us",
        "seq",
        F.size(xs).alias("length"),
        F.aggregate(xs, F.lit(0.0), lambda a, x: a + x).alias("total"),
        xs[0].alias("first_value"),
    )


# ------------------------------------------------------------------------------ tensors


@query("f22_available_depth", "SELECT 5 AS depth, count(*) AS rows FROM fx_book", i="depth")
def f22(fx: Fixtures) -> DataFrame:
    depth = available_depth(fx.book.columns)
    return fx.book.agg(F.count(F.lit(1)).alias("rows")).withColumn("depth", F.lit(depth))


SIGMA = f"""
    g AS (SELECT *, ln(mid / lag(mid) OVER ({ROW})) AS chg FROM
      (SELECT *, (bid_price_0 + ask_price_0) / 2 AS mid FROM fx_book)),
    s AS (SELECT *, stddev_samp(chg) OVER {back(7200)} AS sigma FROM g)"""
CALIBRATION = (
    "cal AS (SELECT median(round(ask_price_0 - bid_price_0, 8)) AS fl, "
    + ", ".join(
        f"avg(ln(1 + {c})) AS m_{c}, stddev_pop(ln(1 + {c})) AS d_{c}"
        for c in tensor.size_columns(3)
    )
    + " FROM fx_book)"
)


@query(
    "f23_lob_tensor",
    f"WITH {SIGMA}, {CALIBRATION} SELECT symbol, us, seq, "
    + ", ".join(
        f"({sg} * ({sd}_price_{i} - {sd}_price_0)) / (CASE WHEN sigma IS NOT NULL THEN "
        f"greatest(sigma * mid, fl) END) AS lob_{sd}_dist_{i}, (ln(1 + {sd}_size_{i}) - "
        f"m_{sd}_size_{i}) / d_{sd}_size_{i} AS lob_{sd}_size_{i}"
        for sd, sg in (("ask", "1"), ("bid", "-1"))
        for i in range(3)
    )
    + " FROM s, cal",
    d=" ".join(f"lob_{s}_{k}_{i}" for s in ("ask", "bid") for k in ("dist", "size") for i in range(3)),
)
def f23(fx: Fixtures) -> DataFrame:
    calibration = tensor.tensor_calibration(fx.book, 3)
    return tensor.lob_tensor(fx.book, calibration, 3, sigma_s=7200, spine=fx.spine)


@query(
    "f24_tensor_calibration",
    f"WITH {CALIBRATION} SELECT fl AS spread_floor, m_ask_size_0 AS ask_size_0_mean, "
    "d_ask_size_0 AS ask_size_0_sd, d_bid_size_2 AS bid_size_2_sd FROM cal",
    d="spread_floor ask_size_0_mean ask_size_0_sd bid_size_2_sd",
)
def f24(fx: Fixtures) -> DataFrame:
    return tensor.tensor_calibration(fx.book, 3).select(
        "spread_floor", "ask_size_0_mean", "ask_size_0_sd", "bid_size_2_sd"
    )


@query("f25_log_change_std", f"WITH {SIGMA} SELECT symbol, us, seq, sigma FROM s", d="sigma", digits=9)
def f25(fx: Fixtures) -> DataFrame:
    from tickloom.functions.flow import log_change_std

    return log_change_std(fx.book, 7200, spine=fx.spine)


def replicated_sql(levels: int = 2) -> tuple[str, list[str]]:
    p = f"({ROW} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)"
    v = f"({ROW} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)"

    def sd(x: str, f: str) -> str:
        return f"sqrt(greatest(var_pop({x}) OVER {f}, 1e-12))"

    sizes = tensor.size_columns(levels)
    stats = ", ".join(f"avg({c}) OVER {v} AS m_{c}, {sd(c, v)} AS s_{c}" for c in sizes)
    floors = ", ".join(
        f"greatest(quantile_cont(s_{c}, 0.1), 0.05 * median(s_{c}), 1e-6) AS f_{c}" for c in sizes
    )
    cols, names = [], []
    for side, sign in (("ask", 1), ("bid", -1)):
        scale = f"greatest({side[0]}s, 0.5 * (CASE WHEN sm > 0 THEN sm ELSE whole END))"
        cols.append(f"({side}_price_0 - {side[0]}m) / {scale} AS {side}_px_0")
        names.append(f"{side}_px_0")
        for i in range(1, levels):
            cols.append(f"{sign} * ({side}_price_{i} - {side}_price_0) / {scale} AS {side}_px_{i}")
            names.append(f"{side}_px_{i}")
        for i in range(levels):
            c = f"{side}_size_{i}"
            cols.append(f"({c} - m_{c}) / greatest(s_{c}, f_{c}) AS {side}_sz_{i}")
            names.append(f"{side}_sz_{i}")
    sql = f"""
    WITH a AS (SELECT *, count(*) OVER {v} AS nn, avg(ask_price_0) OVER {p} AS am,
      {sd('ask_price_0', p)} AS as_, avg(bid_price_0) OVER {p} AS bm, {sd('bid_price_0', p)} AS bs,
      avg(ask_price_0 - bid_price_0) OVER {p} AS sm, {stats} FROM fx_book),
    k AS (SELECT * FROM a WHERE nn >= 100),
    fl AS (SELECT symbol, {floors} FROM k GROUP BY 1),
    w AS (SELECT symbol, median(ask_price_0 - bid_price_0) AS whole FROM fx_book
          WHERE ask_price_0 > bid_price_0 GROUP BY 1)
    SELECT symbol, us, seq, {', '.join(cols)} FROM k JOIN fl USING (symbol) JOIN w USING (symbol)"""
    return sql.replace("greatest(as,", "greatest(as_,"), names


REPLICATED, REPLICATED_NAMES = replicated_sql()


@query("f26_trailing_z_book", REPLICATED, d=" ".join(REPLICATED_NAMES))
def f26(fx: Fixtures) -> DataFrame:
    return tensor.replicated_book(fx.book, 2, spine=fx.spine)


AUX_ROWS = f"""
    k AS ({BUCKET_SQL.format(op="p.us <= r.us")}),
    z AS (SELECT b.*, k.sell_volume - k.buy_volume AS signed_volume,
          k.buy_volume + k.sell_volume AS total_trade_volume
          FROM fx_book b JOIN k USING (symbol, us, seq))"""


def aux_sql() -> str:
    def lagged(x: str) -> str:
        return f"round(coalesce(ln(({x} + 1e-6) / (lag({x}) OVER w + 1e-6)), 0), 9)"

    at = " + ".join(f"ask_size_{i}" for i in range(5))
    bt = " + ".join(f"bid_size_{i}" for i in range(5))

    def score(x: str) -> str:
        f = f"OVER ({ROW} ROWS 99 PRECEDING)"
        sd = f"stddev_samp({x}) {f}"
        return (
            f"round(coalesce(({x} - avg({x}) {f}) / ((CASE WHEN {sd} = 0 THEN 1e-9 ELSE {sd} END) "
            f"+ 1e-9), 0), 9) AS {x}"
        )

    names = ["ask_rate_lvl0_lag_1_log", "bid_depth_total_lag_1_log", "queue_imbalance", "ofi"]
    return f"""
    WITH {AUX_ROWS},
    i AS (SELECT symbol, us, seq, {lagged('ask_price_0')} AS ask_rate_lvl0_lag_1_log,
      {lagged('(' + bt + ')')} AS bid_depth_total_lag_1_log,
      (bid_size_0 - ask_size_0) / (bid_size_0 + ask_size_0 + 1e-12) AS queue_imbalance,
      coalesce(bid_size_0 - lag(bid_size_0) OVER w, 0)
        - coalesce(ask_size_0 - lag(ask_size_0) OVER w, 0) AS ofi,
      sum(signed_volume) OVER ({ROW} ROWS 9 PRECEDING) AS trade_flow_imbalance_1s,
      round((({bt}) - ({at})) / (({bt}) + ({at})), 9) AS book_imbalance
      FROM z WINDOW w AS ({ROW}))
    SELECT symbol, us, seq, {', '.join(score(n) for n in [*names, 'trade_flow_imbalance_1s'])},
      book_imbalance FROM i"""


@query(
    "f27_auxiliary_inputs",
    aux_sql(),
    d="ask_rate_lvl0_lag_1_log bid_depth_total_lag_1_log queue_imbalance ofi "
    "trade_flow_imbalance_1s book_imbalance",
    digits=5,
)
def f27(fx: Fixtures) -> DataFrame:
    sums = bucket_prints(fx.book, fx.prints).select(
        "symbol",
        "us",
        "seq",
        (F.col("sell_volume") - F.col("buy_volume")).alias("signed_volume"),
        (F.col("buy_volume") + F.col("sell_volume")).alias("total_trade_volume"),
        F.lit(0).alias("sell_count"),
    )
    rows = fx.book.join(sums, ["symbol", "us", "seq"])
    names = [
        "ask_rate_lvl0_lag_1_log",
        "bid_depth_total_lag_1_log",
        "queue_imbalance",
        "ofi",
        "trade_flow_imbalance_1s",
        "book_imbalance",
    ]
    return tensor.auxiliary_inputs(rows, 5, names=names, spine=fx.spine).select("symbol", "us", "seq", *names)


def walk_sql(side: str, size: float, levels: int = 5) -> str:
    """Levels as rows, so the walk is checked by a running sum instead of a chain."""
    rows = " UNION ALL ".join(
        f"SELECT symbol, us, seq, {i} AS lv, {side}_price_{i} AS px, {side}_size_{i} AS sz "
        "FROM fx_book"
        for i in range(levels)
    )
    return f"""(SELECT symbol, us, seq, sum(take * px) AS paid, sum(sz) AS visible,
        sum(take) AS taken, arg_max(px, lv) AS deepest, count_if(take > 0) AS levels,
        sum(px * sz) / sum(sz) AS whole FROM (SELECT *, greatest(0, least(sz, {size} - (sum(sz) OVER
          (PARTITION BY symbol, us, seq ORDER BY lv) - sz))) AS take FROM ({rows})) GROUP BY 1, 2, 3)"""


@query(
    "f28_executed_price",
    f"""
    SELECT symbol, us, seq, CASE WHEN visible >= 12 THEN round_even(paid / 12 / 0.01, 0) * 0.01
      ELSE whole END AS price FROM {walk_sql('ask', 12)}""",
    d="price",
)
def f28(fx: Fixtures) -> DataFrame:
    return fx.book.select("symbol", "us", "seq", tensor.exec_price("ask", 5, 12.0, 0.01).alias("price"))


@query(
    "f29_imbalance_share_rule",
    """
    WITH v AS (SELECT symbol, us, seq, (bid_size_0 - ask_size_0) / (bid_size_0 + ask_size_0) AS x
               FROM fx_book),
    t AS (SELECT quantile_cont(abs(x), 0.9) AS q FROM v WHERE us < 1705276800000000)
    SELECT symbol, us, seq, CASE WHEN abs(x) >= q THEN sign(x) ELSE 0 END AS side FROM v, t""",
    i="side",
)
def f29(fx: Fixtures) -> DataFrame:
    training = fx.book.filter(F.col("us") < 1_705_276_800_000_000)
    return tensor.imbalance_rule(training, fx.book, 0.1)
