"""Decisions: thresholds, gates, events, baskets, members, sizing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import labels
from tickloom.functions.costs import TakerCosts
from tickloom.functions.flow import base_quantities, expand
from tickloom.operators import decide
from tickloom.plans.fixtures import Fixtures
from tickloom.plans.queries_book import BASE
from tickloom.plans.queries_panel import CLOCK, clock_prices
from tickloom.plans.registry import query

ROW = "PARTITION BY symbol ORDER BY us, seq"
JOINED = f"""
    z AS (SELECT *, 1e4 * ln(lead(mid, 10) OVER ({ROW}) / mid) AS forward_bp FROM fx_decisions)"""


def joined(fx: Fixtures) -> DataFrame:
    moves = labels.forward_return(fx.book, 10, spine=fx.spine)
    return fx.decisions.join(moves, ["symbol", "us", "seq"])


@query(
    "d1_decide",
    """
    SELECT symbol, us, seq, CASE WHEN p_buy >= 0.55 AND p_buy > p_sell THEN 1
      WHEN p_sell >= 0.55 AND p_sell > p_buy THEN -1 ELSE 0 END AS decision FROM fx_decisions""",
    i="decision",
)
def d1(fx: Fixtures) -> DataFrame:
    side = decide.decide(F.col("p_sell"), F.col("p_buy"), 0.55)
    return fx.decisions.select("symbol", "us", "seq", side.alias("decision"))


def evaluated_sql(src: str, by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"""
    SELECT {head}count_if(ok) AS rows, count_if(tr) AS trades,
      coalesce(sum(CASE WHEN tr THEN decision * forward_bp END), 0) AS gross_bp,
      coalesce(sum(CASE WHEN tr THEN spread_bp + 11 END), 0) AS cost_bp,
      avg(CASE WHEN tr THEN CASE WHEN decision * forward_bp > 0 THEN 1.0 ELSE 0.0 END END)
        AS hit_rate,
      count_if(tr) / greatest(count_if(ok), 1) AS trade_rate,
      coalesce(sum(CASE WHEN tr THEN decision * forward_bp - spread_bp - 11 END), 0) AS net_bp,
      coalesce(avg(CASE WHEN tr THEN decision * forward_bp - spread_bp - 11 END), 0)
        AS net_per_trade_bp
    FROM (SELECT *, forward_bp IS NOT NULL AS ok, forward_bp IS NOT NULL AND decision <> 0 AS tr
          FROM {src}) {group}"""


EVAL_D = "gross_bp cost_bp hit_rate trade_rate net_bp net_per_trade_bp"


@query(
    "d2_evaluate",
    f"WITH {JOINED}, q AS (SELECT *, side AS decision FROM z) " + evaluated_sql("q", "symbol"),
    d=EVAL_D,
    i="rows trades",
    digits=4,
)
def d2(fx: Fixtures) -> DataFrame:
    rows = joined(fx).withColumnRenamed("side", "decision")
    return decide.evaluate(rows, TakerCosts(), by=["symbol"])


SEEN = "PARTITION BY symbol ORDER BY us, seq ROWS BETWEEN"


@query(
    "d8_strategy_inputs",
    f"""
    WITH r AS (SELECT symbol, us, seq, abs(p_buy - 0.5) / 100 AS rv, mid, CASE WHEN seq % 7 <> 0 THEN spread_bp * mid / 1e4
      END AS spread FROM fx_decisions),
    x AS (SELECT *, spread * 1e4 / (mid + 1e-12) AS raw FROM r)
    SELECT symbol, us, seq, round(greatest(rv * 1e4, 0), 6) AS rv_bp, round(greatest(coalesce(
      last_value(raw IGNORE NULLS) OVER ({SEEN} UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(raw IGNORE NULLS) OVER ({SEEN} CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 0), 3) AS spread_input_bp
    FROM x""",
    d="rv_bp spread_input_bp",
)
def d8_inputs(fx: Fixtures) -> DataFrame:
    rows = fx.decisions.select(
        "symbol", "us", "seq", (F.abs(F.col("p_buy") - 0.5) / 100).alias("rv"), "mid",
        F.when(F.col("seq") % 7 != 0, F.col("spread_bp") * F.col("mid") / 1e4).alias("spread"),
    )
    found = decide.strategy_inputs(rows, "rv", "mid", "spread")
    return found.select("symbol", "us", "seq", "rv_bp", "spread_input_bp")


GRID = (0.52, 0.6, 0.7, 0.8, 0.9)


@query(
    "d3_choose_confidence",
    f"""
    WITH {JOINED}, q AS (SELECT z.*, c AS min_confidence, CASE WHEN p_buy >= c AND p_buy > p_sell
      THEN 1 WHEN p_sell >= c AND p_sell > p_buy THEN -1 ELSE 0 END AS decision FROM z,
      (VALUES {', '.join(f'({g})' for g in GRID)}) t(c)),
    e AS ({evaluated_sql('q', 'min_confidence')})
    SELECT coalesce((SELECT min_confidence FROM e WHERE trades >= 50 ORDER BY net_bp DESC,
      min_confidence LIMIT 1), 1.9) AS min_confidence""",
    d="min_confidence",
)
def d3(fx: Fixtures) -> DataFrame:
    return decide.choose_confidence(decide.confidence_curve(joined(fx), GRID, TakerCosts()))


@query(
    "d4_hold_first",
    """
    WITH l AS (SELECT p_buy AS p FROM fx_decisions WHERE p_buy > p_sell ORDER BY 1 DESC LIMIT 300),
    s AS (SELECT p_sell AS p FROM fx_decisions WHERE p_sell > p_buy ORDER BY 1 DESC LIMIT 300)
    SELECT symbol, us, seq, CASE WHEN p_sell >= (SELECT min(p) FROM s) AND p_sell > p_buy THEN -1
      WHEN p_buy >= (SELECT min(p) FROM l) AND p_buy > p_sell THEN 1 ELSE 0 END AS decision
    FROM fx_decisions""",
    i="decision",
)
def d4(fx: Fixtures) -> DataFrame:
    bars = decide.hold_first_thresholds(fx.decisions, 30, 20)
    return decide.hold_first(fx.decisions, bars).select("symbol", "us", "seq", "decision")


EV = """
    ev AS (SELECT symbol, us, seq, CASE WHEN -imb * 60 - 8 > 11 + spread_bp THEN -1
      WHEN imb * 60 - 8 > 11 + spread_bp THEN 1 ELSE 0 END AS side FROM fx_decisions)"""


def ev(fx: Fixtures) -> DataFrame:
    side = decide.ev_sides(F.col("imb") * 60, F.lit(8.0), F.col("spread_bp"), 10.0, 1.0, 1.0)
    return fx.decisions.select("symbol", "us", "seq", side.alias("side"))


@query("d5_ev_gate", f"WITH {EV} SELECT * FROM ev", i="side")
def d5(fx: Fixtures) -> DataFrame:
    return ev(fx)


EVENTS = f"""
    es AS (SELECT *, CASE WHEN side <> 0 AND coalesce(lag(side) OVER ({ROW}), 0) = 0 THEN 1 ELSE 0
      END AS st FROM ev),
    events_ AS (SELECT symbol, us, seq, side, CASE WHEN side <> 0 THEN sum(st) OVER ({ROW}) - 1
      ELSE -1 END AS event FROM es)"""


@query("d6_event_ids", f"WITH {EV}, {EVENTS} SELECT * FROM events_", i="side event")
def d6(fx: Fixtures) -> DataFrame:
    return decide.event_ids(ev(fx), "side")


@query("d7_one_per_event_cooldown", f"""
    WITH RECURSIVE s0 AS (SELECT symbol, us, seq, side, lag(side) OVER ({ROW}) AS ps,
        us - lag(us) OVER ({ROW}) AS gap FROM fx_decisions),
    s1 AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> side OR gap > 1800000000 THEN 1 ELSE 0 END)
      OVER ({ROW}) AS run FROM s0),
    r AS (SELECT symbol, run, min(us) AS a, max(us) AS b, arg_min(side, us) AS side,
      arg_min(seq, us) AS seq FROM s1 GROUP BY 1, 2),
    c AS (SELECT symbol, a, b, side, seq FROM r WHERE side <> 0),
    n AS (SELECT c.*, x.a AS nxt FROM c ASOF LEFT JOIN c x ON c.symbol = x.symbol
      AND c.b + 3600000000 <= x.a),
    p AS (SELECT n.* FROM n JOIN (SELECT symbol, min(a) AS a FROM c GROUP BY 1) USING (symbol, a)
      UNION ALL SELECT n.* FROM p JOIN n ON n.symbol = p.symbol AND n.a = p.nxt)
    SELECT symbol, a AS us, seq, side FROM p""", i="side")
def d7(fx: Fixtures) -> DataFrame:
    from tickloom.operators.events import first_of_events

    return first_of_events(fx.decisions, "side", max_gap_s=1800, cooldown_s=3600)


@query(
    "d8_probability_gate",
    """
    WITH p AS (SELECT symbol, us, seq, spread_bp, 40.0 AS rv, p_buy * 0.8 AS u, p_sell * 0.8 AS dn,
      0.2 AS fl FROM fx_decisions),
    e AS (SELECT *, (u - dn) * rv - (2 * 1 + spread_bp + 0.5) AS eu, -(u - dn) * rv
      - (2 * 1 + spread_bp + 0.5) AS ed FROM p)
    SELECT symbol, us, seq, CASE WHEN greatest(eu, ed) <= 1 OR 1 - fl < 0.5 OR abs(u - dn) < 0.1
      OR rv / greatest(spread_bp, 1e-9) < 0.5 THEN 1 WHEN eu > ed THEN 2 ELSE 0 END AS label
    FROM e""",
    i="label",
)
def d8(fx: Fixtures) -> DataFrame:
    label = decide.probability_gate(
        F.col("p_sell") * 0.8,
        F.lit(0.2),
        F.col("p_buy") * 0.8,
        F.lit(40.0),
        F.col("spread_bp"),
        fee_bp=1,
        slippage_bp=0.5,
        t_min=0.5,
        buffer_bp=1,
        tau_move=0.5,
        min_margin=0.1,
    )
    return fx.decisions.select("symbol", "us", "seq", label.alias("label"))


SIGNAL = f"""
    {CLOCK},
    ix AS (SELECT symbol, us, log_price, (sum(log_price) OVER u - log_price) / (count(*) OVER u - 1)
      AS iw FROM hp WINDOW u AS (PARTITION BY us)),
    sg AS (SELECT symbol, us, log_price, (iw - lag(iw, 3) OVER (PARTITION BY symbol ORDER BY us))
      * 1e4 AS signal_bp FROM ix)"""


def index_signal(fx: Fixtures) -> DataFrame:
    return decide.index_signal(clock_prices(fx).drop("close"), 3)


@query(
    "d9_reversion_decisions",
    f"""
    WITH {SIGNAL},
    t AS (SELECT symbol, quantile_cont(abs(signal_bp), 1.0 - least(0.999, greatest(1, floor(
      4.0 * count(*) / 24)) / count(signal_bp))) AS th FROM sg GROUP BY 1)
    SELECT symbol, us, signal_bp, CASE WHEN abs(signal_bp) >= th THEN -sign(signal_bp) ELSE 0 END
      AS decision FROM sg JOIN t USING (symbol)""".replace(
        "quantile_cont(abs(signal_bp), 1.0 - least(0.999, greatest(1, floor(\n      4.0 * count(*) / 24)) / count(signal_bp)))",
        "(SELECT quantile_cont(abs(o.signal_bp), 1.0 - 120.0 / 717) FROM sg o WHERE o.symbol = sg.symbol)",
    ),
    d="signal_bp",
    i="decision",
)
def d9(fx: Fixtures) -> DataFrame:
    # 720 hours on the common clock, less the three of the look-back.
    signals = index_signal(fx)
    bars = decide.rate_threshold(signals, 4.0, 24.0)
    out = signals.join(bars, "symbol")
    side = decide.against_move(F.col("signal_bp"), F.col("threshold"))
    return out.select("symbol", "us", "signal_bp", F.coalesce(side, F.lit(0)).alias("decision"))


DEV = f"""
    {CLOCK},
    mv AS (SELECT symbol, us, (log_price - lag(log_price, 6) OVER w) * 1e4 AS r,
      (lead(log_price, 6) OVER w - log_price) * 1e4 AS forward FROM hp
      WINDOW w AS (PARTITION BY symbol ORDER BY us)),
    dv AS (SELECT *, r - avg(r) OVER (PARTITION BY us) AS deviation FROM mv),
    wt AS (SELECT *, CASE WHEN deviation IS NOT NULL AND n >= 4 THEN CASE WHEN rk > n - 2 THEN -0.25
      WHEN rk <= 2 THEN 0.25 ELSE 0 END ELSE 0 END AS weight FROM (SELECT *, count(deviation) OVER
      (PARTITION BY us) AS n, row_number() OVER (PARTITION BY us ORDER BY deviation NULLS LAST,
      symbol) AS rk FROM dv))"""


@query(
    "d10_basket_weights",
    f"WITH {DEV} SELECT symbol, us, deviation, weight FROM wt",
    d="deviation weight",
)
def d10(fx: Fixtures) -> DataFrame:
    moved = decide.relative_returns(clock_prices(fx).drop("close"), 6)
    return decide.basket_weights(moved, 2).select("symbol", "us", "deviation", "weight")


@query(
    "d11_basket_backtest",
    f"""
    WITH {DEV},
    c AS (SELECT us, row_number() OVER (ORDER BY us) - 1 AS start_row, count(*) OVER () AS n FROM
      (SELECT DISTINCT us FROM hp))
    SELECT start_row, count(*) AS names, sum(weight * forward) AS gross_bp, sum(abs(weight)) * 8 AS cost_bp,
      sum(weight * forward) - sum(abs(weight)) * 8 AS net_bp FROM wt JOIN c USING (us)
    WHERE start_row >= 6 AND start_row < c.n - 6 AND (start_row - 6) % 6 = 0 AND weight <> 0 AND forward IS NOT NULL
    GROUP BY 1""",
    d="gross_bp cost_bp net_bp",
)
def d11(fx: Fixtures) -> DataFrame:
    return decide.basket_backtest(
        clock_prices(fx).drop("close"), lookback=6, hold=6, basket=2, cost_bp=8
    )


@query(
    "d12_leg_decisions",
    f"""
    WITH {DEV},
    k AS (SELECT us, symbol, forward AS fwd, rank() OVER (PARTITION BY us ORDER BY -deviation) +
      (count(*) OVER (PARTITION BY us, deviation) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY us
      ORDER BY forward) + (count(*) OVER (PARTITION BY us, forward) - 1) / 2.0 AS rt,
      row_number() OVER (PARTITION BY us ORDER BY -deviation, symbol) AS lo,
      count(*) OVER (PARTITION BY us) AS n FROM dv WHERE deviation IS NOT NULL
      AND forward IS NOT NULL)
    SELECT us, corr(rs, rt) AS ic, avg(sd * fwd) AS gross, avg(CASE WHEN sd IS NOT NULL THEN 9 END)
      AS cost, avg(sd * fwd) - 9 AS net FROM (SELECT *, CASE WHEN lo > n - 2 THEN 1 WHEN lo <= 2
      THEN -1 END AS sd FROM k) GROUP BY 1""",
    d="ic gross cost net",
)
def d12(fx: Fixtures) -> DataFrame:
    from tickloom.operators.chunks import BARS, chunked, own

    prices = clock_prices(fx).drop("close")
    moved = decide.relative_returns(prices, 6)
    cut = chunked(moved, BARS, rows_ahead=6, spine=prices)
    x = F.col("log_price")
    rows = own(
        cut.select(
            "symbol",
            "us",
            "_chunk",
            "_own",
            (-F.col("deviation")).alias("score"),
            ((F.lead(x, 6).over(BARS.window()) - x) * 1e4).alias("fwd"),
            F.lit(9.0).alias("cost"),
        )
    ).withColumn("target", F.col("fwd"))
    return decide.leg_decisions(rows.filter("fwd IS NOT NULL"), 2)


def rule_rows(fx: Fixtures) -> DataFrame:
    made = expand(
        base_quantities(fx.book),
        windows=(50,),
        lags=(20, 50),
        levels=("spread_bp", "queue_imbalance"),
        diffs=("log_mid",),
        spine=fx.spine,
    )
    return made.select(
        "symbol", "us", "seq", "spread_bp", "queue_imbalance", "log_mid_ret20", "log_mid_ret50", "log_mid_vol50"
    )


RULE_SQL = f"""
    {BASE}, r AS (SELECT symbol, us, seq, spread, imb, (ln(mid) - ln(lag(mid, 20) OVER ({ROW})))
      * 1e4 AS r20, (ln(mid) - ln(lag(mid, 50) OVER ({ROW}))) * 1e4 AS r50,
      CASE WHEN count(step) OVER v >= 50 THEN stddev_samp(step) OVER v END AS v50 FROM e
      WINDOW v AS ({ROW} ROWS 49 PRECEDING)),
    s AS (SELECT symbol, us, seq, r20 AS momentum, -r20 AS mean_reversion, imb AS order_flow,
      CASE WHEN v50 > 0 THEN r50 / v50 ELSE 0 END AS breakout,
      CASE WHEN spread <= (SELECT quantile_cont(spread, 0.3) FROM r) THEN imb ELSE 0 END
        AS spread_capture FROM r),
    k AS (SELECT 2 * stddev_pop(momentum) AS a, 2 * stddev_pop(order_flow) AS b,
      2 * stddev_pop(breakout) AS c, 2 * stddev_pop(spread_capture) AS d FROM s)"""


@query(
    "d13_rule_scores",
    f"""
    {RULE_SQL}
    SELECT symbol, us, seq, momentum / a AS momentum, mean_reversion / a AS mean_reversion,
      order_flow / b AS order_flow, CASE WHEN abs(breakout / c) >= 1 THEN breakout / c ELSE 0 END
        AS breakout, spread_capture / d AS spread_capture FROM s, k""",
    d="momentum mean_reversion order_flow breakout spread_capture",
)
def d13(fx: Fixtures) -> DataFrame:
    signals = decide.rule_signals(rule_rows(fx))
    return decide.rule_scores(signals, decide.rule_scales(signals))


MEMBERS = """
    v AS (SELECT symbol, us, seq, p_buy AS b1, p_sell AS s1, 0.5 + (p_buy - 0.5) * 0.5
      + (spread_bp % 1 - 0.5) * 0.2 AS b2 FROM fx_decisions),
    mm AS (SELECT *, 1 - b2 AS s2, CASE WHEN b1 >= s1 THEN 1 ELSE -1 END AS d1,
      CASE WHEN b2 >= 1 - b2 THEN 1 ELSE -1 END AS d2 FROM v)"""


@query(
    "d14_member_agreement",
    f"""
    WITH {MEMBERS}
    SELECT symbol, us, seq, d1 AS side, CASE WHEN d1 = d2 THEN least(greatest(b1, s1),
      greatest(b2, s2)) ELSE 0 END AS agreed, CASE WHEN d1 = d2 THEN greatest(b2, s2) ELSE 0 END
      AS gated, (b1 * 0.75 + b2 * 0.25) AS averaged_buy FROM mm""",
    d="agreed gated averaged_buy",
    i="side",
)
def d14(fx: Fixtures) -> DataFrame:
    b2 = F.lit(0.5) + (F.col("p_buy") - 0.5) * 0.5 + (F.col("spread_bp") % 1 - 0.5) * 0.2
    rows = fx.decisions.withColumn("b2", b2).withColumn("s2", F.lit(1) - F.col("b2"))
    one, two = (F.col("p_sell"), F.col("p_buy")), (F.col("s2"), F.col("b2"))
    side, agreed = decide.agreement([one, two])
    _, gated = decide.endorsed(one, two)
    mean = decide.averaged([one, two], [3.0, 1.0])
    return rows.select(
        "symbol",
        "us",
        "seq",
        side.alias("side"),
        agreed.alias("agreed"),
        gated.alias("gated"),
        mean[1].alias("averaged_buy"),
    )


@query(
    "d15_bound_and_expected_value",
    """
    WITH m AS (SELECT symbol, us, seq, imb * 60 AS mu, 5 + spread_bp / 10 AS sd FROM fx_decisions)
    SELECT symbol, us, seq, CASE WHEN mu - sd > 12 THEN 1 WHEN mu + sd < -12 THEN -1 ELSE 0 END
      AS bound_side, CASE WHEN abs(mu) > 18 THEN sign(mu) ELSE 0 END AS value_side,
      CASE WHEN abs(mu) > 18 THEN 1.0 / 3 + (0.9 - 1.0 / 3) * tanh((abs(mu) - 18) / 12) ELSE 1.0 / 3
      END AS confidence FROM m""",
    d="confidence",
    i="bound_side value_side",
)
def d15(fx: Fixtures) -> DataFrame:
    mu, sd = F.col("imb") * 60, F.lit(5) + F.col("spread_bp") / 10
    acts = F.abs(mu) > 18
    return fx.decisions.select(
        "symbol",
        "us",
        "seq",
        decide.bound_side(mu, sd, 12, 1.0).alias("bound_side"),
        decide.expected_value_side(mu, 18).alias("value_side"),
        decide.surplus_confidence(F.abs(mu) - 18, acts, 12.0).alias("confidence"),
    )


@query(
    "d16_sizing",
    """
    SELECT symbol, us, seq, least(3, greatest(0, 10 / greatest(spread_bp / 4, 1))) AS vol_size,
      least(1, greatest(0, (p_buy - 0.34) / 0.26)) AS ramp_size,
      least(2, greatest(0, 0.25 * imb * 60 / pow(greatest(spread_bp / 4, 1e-9), 2))) AS kelly_size
    FROM fx_decisions""",
    d="vol_size ramp_size kelly_size",
)
def d16(fx: Fixtures) -> DataFrame:
    vol = F.col("spread_bp") / 4
    return fx.decisions.select(
        "symbol",
        "us",
        "seq",
        decide.volatility_scale(vol).alias("vol_size"),
        decide.confidence_scale(F.col("p_buy")).alias("ramp_size"),
        decide.kelly_scale(F.col("imb") * 60, vol).alias("kelly_size"),
    )


@query(
    "d17_candidate_tape",
    """
    WITH l AS (SELECT p_buy AS p FROM fx_decisions WHERE p_buy > p_sell ORDER BY 1 DESC LIMIT 1200),
    s AS (SELECT p_sell AS p FROM fx_decisions WHERE p_sell > p_buy ORDER BY 1 DESC LIMIT 1200)
    SELECT symbol, us, seq, p_buy AS p_long, p_sell AS p_short, spread_bp <= 30 AS tight,
      CASE WHEN p_sell >= (SELECT min(p) FROM s) AND p_sell > p_buy THEN -1 ELSE 1 END AS side
    FROM fx_decisions WHERE (p_buy >= (SELECT min(p) FROM l) AND p_buy > p_sell)
      OR (p_sell >= (SELECT min(p) FROM s) AND p_sell > p_buy)""",
    d="p_long p_short",
    i="side",
)
def d17(fx: Fixtures) -> DataFrame:
    # The loosest cell of the grid decides which rows any cell could enter.
    loosest = decide.hold_first_thresholds(fx.decisions, 30, 80)
    tape = decide.hold_first(fx.decisions.drop("side"), loosest).filter("decision != 0")
    return tape.select(
        "symbol",
        "us",
        "seq",
        F.col("p_buy").alias("p_long"),
        F.col("p_sell").alias("p_short"),
        (F.col("spread_bp") <= 30).alias("tight"),
        F.col("decision").alias("side"),
    )
