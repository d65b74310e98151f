"""Pairs, carry, basis and cross-venue portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import portfolio, stats
from tickloom.operators.asof import symbol_pairs
from tickloom.operators.bands import band_positions
from tickloom.plans.fixtures import Fixtures
from tickloom.plans.queries_panel import CLOCK, clock_prices
from tickloom.plans.registry import query

PAIRS = f"""
    {CLOCK}, pr AS (SELECT x.symbol AS a, y.symbol AS b, x.us, x.log_price AS la, y.log_price AS lb
      FROM hp x JOIN hp y ON x.us = y.us AND x.symbol < y.symbol)"""
HEDGE = f"""
    {PAIRS}, hd AS (SELECT a, b, count(*) AS n, regr_intercept(la, lb) AS alpha, regr_slope(la, lb)
      AS beta, sqrt(greatest(var_pop(la) - regr_slope(la, lb) * covar_pop(la, lb), 0)) AS residual_sd
      FROM pr GROUP BY 1, 2)"""
RESID = f"""
    {HEDGE}, rs AS (SELECT pr.*, la - alpha - beta * lb AS r FROM pr JOIN hd USING (a, b)),
    ar AS (SELECT a, b, r, lag(r) OVER (PARTITION BY a, b ORDER BY us) AS x FROM rs),
    ou AS (SELECT a, b, regr_slope(r, x) AS sl, regr_intercept(r, x) AS ic, regr_r2(r, x) AS r2,
      var_pop(CASE WHEN x IS NOT NULL THEN r END) AS vy, avg(r) AS m, stddev_pop(r) AS sd
      FROM ar GROUP BY 1, 2),
    uf AS (SELECT a, b, CASE WHEN sl > 0 AND sl < 1 THEN ic / (1 - sl) ELSE m END AS mu,
      CASE WHEN sl > 0 AND sl < 1 THEN -ln(sl) ELSE 0 END AS theta, CASE WHEN sl > 0 AND sl < 1 THEN
      sqrt(greatest(vy * (1 - r2), 0)) ELSE sd END AS sigma, CASE WHEN sl > 0 AND sl < 1 THEN ln(2) /
      -ln(sl) ELSE 'infinity'::DOUBLE END AS half_life, r2 AS r_squared FROM ou)"""


def pairs(fx: Fixtures) -> DataFrame:
    prices = clock_prices(fx).select("symbol", "us", "log_price")
    joined = symbol_pairs(prices, ["log_price"])
    return joined.select(
        "a", "b", "us", F.col("log_price_a").alias("la"), F.col("log_price_b").alias("lb")
    )


KEYS = ["a", "b"]


@query("r1_hedge_ratio", f"WITH {HEDGE} SELECT * FROM hd", d="alpha beta residual_sd", digits=9)
def r1(fx: Fixtures) -> DataFrame:
    return portfolio.hedges(pairs(fx), KEYS)


def residual_rows(fx: Fixtures) -> DataFrame:
    rows = pairs(fx)
    return portfolio.residuals(rows, portfolio.hedges(rows, KEYS), KEYS)


@query(
    "r2_mean_reversion_fit",
    f"WITH {RESID} SELECT * FROM uf",
    d="mu theta sigma half_life r_squared",
)
def r2(fx: Fixtures) -> DataFrame:
    return portfolio.mean_reversion(residual_rows(fx), KEYS)


@query(
    "r3_fitted_z_score",
    f"WITH {RESID} SELECT rs.a, rs.b, us, (r - mu) / sigma AS z FROM rs JOIN uf USING (a, b)",
    d="z",
)
def r3(fx: Fixtures) -> DataFrame:
    rows = residual_rows(fx)
    fits = portfolio.mean_reversion(rows, KEYS)
    z = F.try_divide(F.col("r") - F.col("mu"), F.col("sigma"))
    return rows.join(fits, KEYS).select("a", "b", "us", z.alias("z"))


@query(
    "r4_rank_pairs",
    f"""
    WITH {RESID} SELECT a, b, beta, half_life, r_squared, row_number() OVER (ORDER BY half_life, a, b)
      AS rank FROM uf JOIN hd USING (a, b)""",
    d="beta half_life r_squared",
)
def r4(fx: Fixtures) -> DataFrame:
    from pyspark.sql import Window

    rows = pairs(fx)
    fits = portfolio.hedges(rows, KEYS)
    pulls = portfolio.mean_reversion(portfolio.residuals(rows, fits, KEYS), KEYS)
    # One row per pair of instruments.
    order = Window.partitionBy(F.lit(0)).orderBy("half_life", "a", "b")
    return pulls.join(fits, KEYS).select(
        "a", "b", "beta", "half_life", "r_squared", F.row_number().over(order).alias("rank")
    )


ADF = f"""
    {RESID}, l1 AS (SELECT a, b, us, r, lag(r) OVER w AS x FROM rs
      WINDOW w AS (PARTITION BY a, b ORDER BY us)),
    l2 AS (SELECT *, r - x AS y, lag(r - x) OVER (PARTITION BY a, b ORDER BY us) AS z FROM l1),
    sm AS (SELECT a, b, count(*) AS n, sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz,
      sum(x * y) AS xy, sum(z * y) AS zy, sum(y * y) AS yy FROM l2 WHERE z IS NOT NULL GROUP BY 1, 2),
    bt AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) /
      (xx * zz - xz * xz) AS b2 FROM sm),
    df AS (SELECT a, b, b1 / sqrt((yy - b1 * xy - b2 * zy) / (n - 2) * zz / (xx * zz - xz * xz))
      AS adf_t FROM bt)"""


@query("r5_dickey_fuller", f"WITH {ADF} SELECT * FROM df", d="adf_t")
def r5(fx: Fixtures) -> DataFrame:
    return portfolio.dickey_fuller(residual_rows(fx), KEYS)


@query(
    "r6_engle_granger",
    f"""
    WITH {ADF} SELECT a, b, adf_t, -3.33613 - 6.1101 / n - 6.823 / (n * n) AS critical_5,
      adf_t <= -3.33613 - 6.1101 / n - 6.823 / (n * n) AS cointegrated FROM df JOIN hd USING (a, b)""",
    d="adf_t critical_5",
)
def r6(fx: Fixtures) -> DataFrame:
    rows = pairs(fx)
    fits = portfolio.hedges(rows, KEYS)
    tests = portfolio.dickey_fuller(portfolio.residuals(rows, fits, KEYS), KEYS)
    joined = tests.join(fits, KEYS)
    bar = portfolio.critical_value(F.col("n").cast("double"))
    return joined.select("a", "b", "adf_t", bar.alias("critical_5"), (F.col("adf_t") <= bar).alias("cointegrated"))


@query("r7_pair_screen", None)
def r7(fx: Fixtures) -> DataFrame:
    null = portfolio.null_statistics(fx.spark, 400, 240)
    return portfolio.screen(pairs(fx), KEYS, null)


def windowed(fx: Fixtures) -> DataFrame:
    from tickloom.operators.chunks import Layout, numbered

    layout = Layout(key=("a", "b"), order=("us",), bucket_s=86_400.0 * 7)
    rows = numbered(pairs(fx), layout, "row").withColumn("row", F.col("row") - 1)
    return portfolio.formation_windows(rows, KEYS, 240, 48)


def scored_windows(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    by = [*KEYS, "window"]
    rows = windowed(fx)
    formed = rows.filter(~F.col("trading"))
    fits = portfolio.hedges(formed, by)
    tests = portfolio.dickey_fuller(portfolio.residuals(formed, fits, by), by)
    return rows, fits.join(tests, by)


FORMED = f"""
    {PAIRS}, rw AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY us) - 1 AS row,
      count(*) OVER (PARTITION BY a, b) - 1 AS last FROM pr),
    wn AS (SELECT rw.*, w AS window_ FROM rw, range(0, 20) t(w) WHERE row >= w * 48 AND row < w * 48
      + 288 AND w * 48 + 241 < last),
    fh AS (SELECT a, b, window_, count(*) AS n, regr_slope(la, lb) AS beta, regr_intercept(la, lb)
      AS alpha, sqrt(greatest(var_pop(la) - regr_slope(la, lb) * covar_pop(la, lb), 0))
      AS residual_sd FROM wn WHERE row < window_ * 48 + 240 GROUP BY 1, 2, 3)"""


@query(
    "r8_walk_forward_windows",
    f"""
    WITH {FORMED} SELECT a, b, window_ AS "window", alpha, beta, residual_sd FROM fh""",
    d="alpha beta residual_sd",
    digits=9,
)
def r8(fx: Fixtures) -> DataFrame:
    _, fits = scored_windows(fx)
    return fits.select("a", "b", "window", "alpha", "beta", "residual_sd")


def pair_trades(fx: Fixtures) -> DataFrame:
    from pyspark.sql import Window

    rows, fits = scored_windows(fx)
    by = [*KEYS, "window"]
    joined = rows.filter("trading").join(fits, by)
    z = (F.col("la") - F.col("alpha") - F.col("beta") * F.col("lb")) / F.col("residual_sd")
    ahead = Window.partitionBy(*by).orderBy("row")  # one window's 48 bars
    priced = joined.select(
        *by,
        "row",
        "beta",
        z.alias("z"),
        F.coalesce(F.exp(F.lead("la").over(ahead)), F.exp("la")).alias("oa1"),
        F.coalesce(F.exp(F.lead("lb").over(ahead)), F.exp("lb")).alias("ob1"),
    )
    return portfolio.trade_bands(priced, portfolio.BandRule(entry_z=1.5, exit_z=0.3, max_hold=12))


@query("r8_band_trades", None)
def r8b(fx: Fixtures) -> DataFrame:
    return pair_trades(fx)


@query("r9_daily_pair_result", None)
def r9(fx: Fixtures) -> DataFrame:
    day = F.floor(F.col("exit_row") / 24).cast("long").alias("day")
    return pair_trades(fx).groupBy("a", "b", day).agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum("net_bp").alias("net_bp"),
        F.sum("gross_bp").alias("gross_bp"),
    )


@query("r10_weekly_selection", None)
def r10(fx: Fixtures) -> DataFrame:
    _, fits = scored_windows(fx)
    scored = portfolio.null_p(fits, portfolio.null_statistics(fx.spark, 400, 240))
    picked = portfolio.weekly_choice(scored, 3, 0.05).select("window", "a", "b", "slot", "p_value")
    drawn = portfolio.random_choice(scored, picked, 7)
    return picked.select("window", "a", "b", F.lit("picked").alias("kind")).unionByName(
        drawn.select("window", "a", "b", F.lit("drawn").alias("kind"))
    )


@query(
    "r11_funding_on_legs",
    """
    WITH t AS (SELECT symbol, trade_id, us AS a, us + 72000000000 AS b, aggressor AS side
      FROM fx_prints)
    SELECT t.symbol, t.trade_id, -side * coalesce(sum(f.rate), 0) * 1e4 AS funding_bp FROM t LEFT JOIN
      fx_funding f ON f.symbol = t.symbol AND f.us > a AND f.us <= b GROUP BY t.symbol, t.trade_id,
      side""",
    d="funding_bp",
)
def r11(fx: Fixtures) -> DataFrame:
    trades = fx.prints.select(
        "symbol",
        F.col("us").alias("entry_us"),
        (F.col("us") + 72_000_000_000).alias("exit_us"),
        F.col("trade_id").alias("seq"),
        "aggressor",
    )
    paid = portfolio.settlements_between(trades, fx.funding)
    return paid.select(
        "symbol",
        F.col("seq").alias("trade_id"),
        (-F.col("aggressor") * F.col("paid") * 1e4).alias("funding_bp"),
    )


SCORES = """
    mo AS (SELECT coin, month, sum(rate) AS paid, day(last_day(month)) AS days FROM fx_carry
      GROUP BY 1, 2),
    sc AS (SELECT coin, month, CASE WHEN lag(month, 2) OVER w = month - INTERVAL 2 MONTH THEN
      sum(paid) OVER p * 1e4 / sum(days) OVER p END AS score FROM mo
      WINDOW w AS (PARTITION BY coin ORDER BY month), p AS (PARTITION BY coin ORDER BY month ROWS
      BETWEEN 2 PRECEDING AND 1 PRECEDING))"""


@query(
    "r12_carry_scores",
    f"WITH {SCORES} SELECT coin, month, score FROM sc WHERE score IS NOT NULL",
    d="score",
)
def r12(fx: Fixtures) -> DataFrame:
    return portfolio.carry_scores(fx.carry, 2)


CHOSEN = f"""
    {SCORES}, ch AS (SELECT * FROM (SELECT month, coin, round(score, 9) AS score, row_number() OVER
      (PARTITION BY month ORDER BY round(score, 9) DESC, coin) AS slot FROM sc WHERE round(score, 9)
      > 0) WHERE slot <= 2)"""


def chosen(fx: Fixtures) -> DataFrame:
    scores = portfolio.carry_scores(fx.carry, 2).withColumn("score", F.round("score", 9))
    return portfolio.choose_top(scores, 2, 0.0)


@query("r13_choose_top", f"WITH {CHOSEN} SELECT month, coin, score, slot FROM ch", d="score")
def r13(fx: Fixtures) -> DataFrame:
    return chosen(fx).select("month", "coin", "score", "slot")


PNL = """
    pl AS (SELECT coin, day, month, coalesce((spot - lag(spot) OVER w) - (perp - lag(perp) OVER w), 0)
      + rate * perp AS pnl, spot FROM fx_carry WINDOW w AS (PARTITION BY coin, month ORDER BY day)),
    mp AS (SELECT coin, month, arg_min(spot, day) AS open, arg_max(spot, day) AS close, sum(pnl) AS pnl
      FROM pl GROUP BY 1, 2)"""


@query("r14_carry_pnl", f"WITH {PNL} SELECT coin, day, pnl FROM pl", d="pnl")
def r14(fx: Fixtures) -> DataFrame:
    return portfolio.carry_pnl(fx.carry).select("coin", "day", "pnl")


@query(
    "r15_carry_holdings",
    f"""
    WITH {PNL}, {CHOSEN}, h AS (SELECT c.coin, c.month, mp.open, mp.close, mp.pnl FROM ch c JOIN mp
      USING (coin, month)),
    n AS (SELECT *, CASE WHEN lag(month) OVER w = month - INTERVAL 1 MONTH THEN 0 ELSE 1 END AS fresh FROM h
      WINDOW w AS (PARTITION BY coin ORDER BY month)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY coin ORDER BY month) AS spell FROM n),
    g AS (SELECT coin, min(month) AS entry_month, max(month) AS last_month, count(*) AS months,
      arg_min(open, month) AS entry_price, arg_max(close, month) AS cl, sum(pnl) AS pnl FROM s
      GROUP BY coin, spell)
    SELECT 'top2' AS rule, g.coin, entry_month, last_month, months, entry_price, coalesce(a.open, cl) AS
      exit_price, (g.pnl - 19 / 1e4 * (entry_price + coalesce(a.open, cl))) / entry_price * 1e4 AS net_bp
    FROM g LEFT JOIN mp a ON a.coin = g.coin AND a.month = g.last_month + INTERVAL 1 MONTH""",
    d="entry_price exit_price net_bp",
)
def r15(fx: Fixtures) -> DataFrame:
    picks = chosen(fx).withColumn("rule", F.lit("top2"))
    return portfolio.carry_holdings(portfolio.carry_months(fx.carry), picks)


@query(
    "r16_return_summary",
    f"""
    WITH {PNL}, r AS (SELECT coin, month, pnl / open AS r FROM mp),
    c AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY coin ORDER BY month)) AS e FROM r),
    p AS (SELECT *, greatest(1, max(e) OVER (PARTITION BY coin ORDER BY month)) AS pk FROM c)
    SELECT coin, (exp(sum(ln(1 + r))) - 1) * 100 AS total_pct, (pow(exp(sum(ln(1 + r))), 12.0 /
      count(*)) - 1) * 100 AS a_year_pct, least(min(e / pk - 1), 0) * 100 AS worst_drawdown_pct,
      avg(r) / stddev_samp(r) * sqrt(12) AS sharpe, count_if(r < 0) AS losing_months, count(*)
      AS months FROM p GROUP BY 1""",
    d="total_pct a_year_pct worst_drawdown_pct sharpe",
    i="losing_months",
)
def r16(fx: Fixtures) -> DataFrame:
    returns = portfolio.carry_months(fx.carry).select(
        "coin", "month", (F.col("pnl") / F.col("open") * 100).alias("return_pct")
    )
    return portfolio.return_summary(returns, ["coin"])


DEVIATION = """
    bs AS (SELECT coin, day, (perp / spot - 1) * 1e4 AS basis FROM fx_carry),
    dv AS (SELECT *, basis - CASE WHEN count(basis) OVER w >= 30 THEN median(basis) OVER w END
      AS deviation FROM bs WINDOW w AS (PARTITION BY coin ORDER BY day ROWS BETWEEN 60 PRECEDING AND
      1 PRECEDING))"""


@query(
    "r17_basis_deviation",
    f"WITH {DEVIATION} SELECT coin, day, basis, deviation FROM dv",
    d="basis deviation",
)
def r17(fx: Fixtures) -> DataFrame:
    return portfolio.basis_deviation(fx.carry, 60).select("coin", "day", "basis", "deviation")


@query(
    "r18_basis_holdings",
    f"""
    WITH {DEVIATION}, j AS (SELECT dv.coin, dv.day, dv.deviation, c.spot, c.perp, c.rate FROM dv JOIN
      fx_carry c USING (coin, day)),
    o AS (SELECT *, coalesce(last_value(CASE WHEN deviation > 2 THEN 1 WHEN deviation <= 0 THEN 0 END
      IGNORE NULLS) OVER w, 0) AS lit, (spot - lag(spot) OVER w) - (perp - lag(perp) OVER w) AS chg FROM j
      WINDOW w AS (PARTITION BY coin ORDER BY day)),
    p AS (SELECT *, coalesce(lag(lit) OVER (PARTITION BY coin ORDER BY day), 0) AS was FROM o),
    s AS (SELECT *, sum(CASE WHEN lit = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY coin ORDER BY
      day) AS spell, CASE WHEN was = 1 THEN chg + rate * perp ELSE 0 END AS e FROM p)
    SELECT coin, spell, min(day) AS entry_day, max(day) AS last_day, (sum(e) - 19 / 1e4 * (arg_min(spot,
      day) + arg_max(spot, day))) / arg_min(spot, day) * 1e4 AS net_bp
    FROM s WHERE lit = 1 OR was = 1 GROUP BY coin, spell""",
    d="net_bp",
    i="spell",
)
def r18(fx: Fixtures) -> DataFrame:
    base = portfolio.basis_deviation(fx.carry, 60).select("coin", "day", "spot", "perp", "rate", "deviation")
    return portfolio.basis_holdings(base, entry_bp=2.0, exit_bp=0.0, key=[])


@query(
    "r19_shifted_signal",
    f"""
    WITH {DEVIATION}, n AS (SELECT *, row_number() OVER (PARTITION BY coin ORDER BY day) - 1 AS i,
      count(*) OVER (PARTITION BY coin) AS c FROM dv)
    SELECT a.coin, a.day, b.deviation FROM n a JOIN n b ON a.coin = b.coin AND b.i = (a.i - 100 + a.c)
      % a.c""",
    d="deviation",
)
def r19(fx: Fixtures) -> DataFrame:
    rows = portfolio.basis_deviation(fx.carry, 60).select("coin", "day", "deviation")
    return portfolio.shifted_signal(rows, "deviation", 100)


@query(
    "r20_venue_spread_choice",
    """
    WITH m AS (SELECT coin, month, sum(rate) AS a, sum(-rate / 2) AS b, count(*) AS n,
      day(last_day(month)) AS days FROM fx_carry GROUP BY 1, 2),
    s AS (SELECT coin, month, CASE WHEN sum(n) OVER p >= sum(days) OVER p * 0.5 THEN round((sum(a)
      OVER p - sum(b) OVER p) * 1e4 / sum(days) OVER p, 9) END AS spread FROM m
      WINDOW p AS (PARTITION BY coin ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
    SELECT * FROM (SELECT month, coin, sign(spread) AS sign, row_number() OVER (PARTITION BY month
      ORDER BY abs(spread) DESC, coin) AS slot FROM s WHERE abs(spread) > 0.2) WHERE slot <= 2""",
    i="sign",
)
def r20(fx: Fixtures) -> DataFrame:
    venues = fx.carry.select(
        "coin", "day", "month", F.col("rate").alias("rate_a"), (-F.col("rate") / 2).alias("rate_b")
    )
    spreads = portfolio.venue_spread(venues, 3, 0.5).withColumn("spread", F.round("spread", 9))
    return portfolio.choose_spreads(spreads, 2, 0.2)


@query(
    "r21_carry_against_universe",
    f"""
    WITH {CHOSEN}, {PNL}, c AS (SELECT coin, month, pnl / open * 1e4 AS carry_bp FROM mp),
    r AS (SELECT *, avg(carry_bp) OVER (PARTITION BY month) AS universe_bp, rank() OVER (PARTITION BY
      month ORDER BY carry_bp DESC) AS place FROM c)
    SELECT r.coin, r.month, carry_bp, universe_bp, place, carry_bp > universe_bp AS beats FROM r JOIN
      ch USING (coin, month) WHERE slot = 1""",
    d="carry_bp universe_bp",
)
def r21(fx: Fixtures) -> DataFrame:
    return portfolio.carry_against_universe(
        portfolio.carry_months(fx.carry), chosen(fx).filter("slot = 1")
    )


@query(
    "r22_month_rank_correlation",
    f"""
    WITH {SCORES}, k AS (SELECT sc.month, round(score, 9) AS x, round(paid, 9) AS y FROM sc JOIN mo
      USING (coin, month) WHERE score IS NOT NULL),
    r AS (SELECT month, rank() OVER (PARTITION BY month ORDER BY x) + (count(*) OVER (PARTITION BY
      month, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY month ORDER BY y) + (count(*) OVER
      (PARTITION BY month, y) - 1) / 2.0 AS ry FROM k)
    SELECT month, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS rank_ic,
      count(*) AS n FROM r GROUP BY 1""",
    d="rank_ic",
)
def r22(fx: Fixtures) -> DataFrame:
    realised = fx.carry.groupBy("coin", "month").agg(F.sum("rate").alias("y"))
    rows = portfolio.carry_scores(fx.carry, 2).join(realised, ["coin", "month"]).select(
        "month", F.round("score", 9).alias("x"), F.round("y", 9).alias("y")
    )
    return stats.rank_ic(rows, ["month"], "x", "y")


@query(
    "r23_top_score_pick",
    f"""
    WITH {CHOSEN} SELECT ch.month, coin, paid * 1e4 / days AS target FROM ch JOIN mo USING (coin,
      month) WHERE slot = 1""",
    d="target",
)
def r23(fx: Fixtures) -> DataFrame:
    realised = fx.carry.groupBy("coin", "month").agg(F.sum("rate").alias("paid"))
    days = F.day(F.last_day("month"))
    return chosen(fx).filter("slot = 1").join(realised, ["coin", "month"]).select(
        "month", "coin", (F.col("paid") * 1e4 / days).alias("target")
    )


@query("r3_band_positions", None)
def r3b(fx: Fixtures) -> DataFrame:
    from tickloom.operators.chunks import Layout

    rows = residual_rows(fx)
    fits = portfolio.mean_reversion(rows, KEYS)
    z = F.try_divide(F.col("r") - F.col("mu"), F.col("sigma"))
    scored = rows.join(fits, KEYS).select("a", "b", "us", z.alias("z"))
    layout = Layout(key=("a", "b"), order=("us",), bucket_s=86_400.0 * 30)
    return band_positions(scored, entry=2.0, exit_at=0.5, layout=layout)
