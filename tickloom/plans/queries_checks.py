"""Splits, searches, causality checks, breaks and regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import labels
from tickloom.functions.book import build_features
from tickloom.functions.columns import day_of
from tickloom.functions.costs import TakerCosts
from tickloom.functions.flow import turn_counts
from tickloom.functions.regime import hourly_returns
from tickloom.operators import breaks, causality, search, splits
from tickloom.operators.trades import ExitRules
from tickloom.plans.fixtures import Fixtures
from tickloom.plans.queries_decide import JOINED
from tickloom.plans.queries_panel import CLOCK, clock_prices
from tickloom.plans.queries_trades import RULES, candidates
from tickloom.plans.registry import query

ROW = "PARTITION BY symbol ORDER BY us, seq"
CUT = 1_705_276_800_000_000
#: Predicted basis points from which the retrained model takes a position.
EDGE = 1.0


def days(fx: Fixtures) -> DataFrame:
    return fx.stamps.select(day_of("us").alias("day")).distinct()


SPAN = """
    dd AS (SELECT DISTINCT CAST(make_timestamp(us) AS DATE) AS day FROM fx_prints),
    sp AS (SELECT count(*) AS days, min(day) AS first, max(day) AS last FROM dd)"""
FOLDS = f"""
    {SPAN}, fl AS (SELECT f AS fold, b AS block, first + CAST(f * 3 + a AS INT) AS first_day, first +
      CAST(f * 3 + a + n - 1 AS INT) AS last_day FROM sp, range(0, 40) t(f), (VALUES ('train', 0, 10),
      ('validation', 10, 4), ('test', 14, 4)) v(b, a, n) WHERE f * 3 + 18 <= days)"""


@query("v1_walk_forward_folds", f"WITH {FOLDS} SELECT * FROM fl", i="fold")
def v1(fx: Fixtures) -> DataFrame:
    return splits.walk_forward(days(fx), 10, 4, 4, 3)


@query(
    "v2_purged_folds",
    f"""
    WITH {FOLDS}, j AS (SELECT symbol, us, seq, fold, block, row_number() OVER (PARTITION BY symbol,
      fold, block ORDER BY us DESC, seq DESC) AS r FROM fx_book JOIN fl ON CAST(make_timestamp(us) AS
      DATE) BETWEEN first_day AND last_day)
    SELECT fold, block, symbol, count(*) AS rows, max(us) AS last_us FROM j WHERE block = 'test' OR
      r > 24 GROUP BY 1, 2, 3""",
    i="fold",
)
def v2(fx: Fixtures) -> DataFrame:
    folds = splits.walk_forward(days(fx), 10, 4, 4, 3)
    rows = splits.assign(fx.book.select("symbol", "us", "seq"), folds, 24)
    return rows.groupBy("fold", "block", "symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.max("us").alias("last_us")
    )


@query(
    "v3_retrain_windows",
    f"""
    WITH {SPAN} SELECT w AS "window", first + CAST(w * 5 AS INT) AS train_first, first + CAST(w * 5 + 9
      AS INT) AS train_last, first + CAST(w * 5 + 10 AS INT) AS use_first, least(first + CAST(w * 5 +
      14 AS INT), last) AS use_last FROM sp, range(0, 40) t(w) WHERE w * 5 + 11 <= days""",
    i="window",
)
def v3(fx: Fixtures) -> DataFrame:
    return splits.retrain_windows(days(fx), 10, 5)


@query(
    "v3_split_span",
    f"""
    WITH {SPAN} SELECT part, first + CAST(floor(a * days) AS INT) AS first_day, first +
      CAST(floor(b * days) - 1 AS INT) AS last_day FROM sp, (VALUES (0, 0.0, 0.6), (1, 0.6, 0.8),
      (2, 0.8, 1.0)) v(part, a, b)""",
    i="part",
)
def v3b(fx: Fixtures) -> DataFrame:
    return splits.split_span(days(fx), (0.6, 0.2, 0.2))


@query(
    "v4_forward_chaining",
    f"""
    WITH {SPAN} SELECT k AS fold, first AS fit_first, first + CAST(days * k // 5 - 2 AS INT) AS fit_last,
      first + CAST(days * k // 5 AS INT) AS predict_first, first + CAST(days * (k + 1) // 5 - 1 AS INT)
      AS predict_last FROM sp, range(1, 5) t(k)""",
    i="fold",
)
def v4(fx: Fixtures) -> DataFrame:
    return splits.forward_chain(days(fx), 4, 1)


@query(
    "v5_cross_section_folds",
    f"""
    WITH {FOLDS.replace('f * 3', 'f * 7').replace("('train', 0, 10),", "('train', 0, 14),").replace("('validation', 10, 4), ('test', 14, 4)", "('test', 14, 7)").replace('+ 18 <=', '+ 21 <=')}
    SELECT * FROM fl""",
    i="fold",
)
def v5(fx: Fixtures) -> DataFrame:
    return splits.walk_forward(days(fx), 14, 0, 7, 7).filter("block != 'validation'")


FEATURES = ["spread_bp", "queue_imbalance", "microprice_dev_bp", "log_depth_ratio", "log_total_depth"]


def feature_rows(fx: Fixtures) -> DataFrame:
    moves = labels.forward_return(fx.book, 10, spine=fx.spine)
    return build_features(fx.book, FEATURES).join(moves, ["symbol", "us", "seq"])


FEATURE_SQL = f"""
    f0 AS (SELECT *, (bid_price_0 + ask_price_0) / 2 AS mid FROM fx_book),
    ft AS (SELECT 1e4 * (ask_price_0 - bid_price_0) / mid AS spread_bp, (bid_size_0 - ask_size_0) /
      (bid_size_0 + ask_size_0) AS queue_imbalance, ln(bid_size_0 / ask_size_0) AS log_depth_ratio,
      ln(bid_size_0 + ask_size_0) AS log_total_depth, 1e4 * ln(lead(mid, 10) OVER ({ROW}) / mid) AS y
      FROM f0)"""


@query(
    "v6_feature_scores",
    f"WITH {FEATURE_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, var_samp({f}) AS variance, corr({f}, y) AS ic FROM ft"
        for f in ("spread_bp", "queue_imbalance", "log_depth_ratio", "log_total_depth")
    ),
    d="variance ic",
)
def v6(fx: Fixtures) -> DataFrame:
    names = [f for f in FEATURES if f != "microprice_dev_bp"]
    return search.feature_scores(feature_rows(fx), names, "forward_bp")


@query("v6_selected_features", None)
def v6b(fx: Fixtures) -> DataFrame:
    rows = feature_rows(fx)
    kept = search.select_features(rows, FEATURES, "forward_bp", limit=0.9, top=3)
    return search.feature_scores(rows, kept, "forward_bp")


@query(
    "v6_binned_information",
    f"""
    WITH {FEATURE_SQL}, e AS (SELECT min(queue_imbalance) AS fl, max(queue_imbalance) AS fh, min(y) AS
      tl, max(y) AS th FROM ft),
    c AS (SELECT least(floor((queue_imbalance - fl) / ((fh - fl) / 10)), 9) AS i, least(floor((y - tl) /
      ((th - tl) / 10)), 9) AS j, count(*) AS n FROM ft, e WHERE y IS NOT NULL GROUP BY 1, 2)
    SELECT sum(n / t * ln(n * t / (ni * nj))) AS information FROM (SELECT n, sum(n) OVER () AS t,
      sum(n) OVER (PARTITION BY i) AS ni, sum(n) OVER (PARTITION BY j) AS nj FROM c)""",
    d="information",
    digits=4,
)
def v6c(fx: Fixtures) -> DataFrame:
    return search.binned_information(feature_rows(fx), "queue_imbalance", "forward_bp")


@query("v7_exit_search", None)
def v7(fx: Fixtures) -> DataFrame:
    policies = [RULES, ExitRules(hold=10, take_profit_bp=40), ExitRules(hold=10, stop_loss_bp=40)]
    return search.exit_search(candidates(fx), policies, TakerCosts(), 50)


REFITS = f"""
    {JOINED}, u AS (SELECT CAST(make_timestamp(us) AS DATE) AS day, p_buy AS x, forward_bp AS y,
      spread_bp + 11 AS cost FROM z WHERE p_buy IS NOT NULL AND forward_bp IS NOT NULL AND spread_bp IS NOT NULL),
    c AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM u)),
    sw AS (SELECT a AS train_days, b AS apply_days, w, i0.n FROM (VALUES (3, 1), (7, 1), (14, 1), (21, 1), (7, 3),
      (14, 3), (14, 7), (21, 7)) t(a, b), (SELECT max(n) AS n FROM c) i0,
      (SELECT unnest(range(0, 400)) AS w) WHERE (w + 1) * b + a <= i0.n),
    ft AS (SELECT train_days, apply_days, w, count(*) AS train_rows, regr_slope(y, x) AS slope,
      regr_intercept(y, x) AS base FROM sw JOIN c ON c.i >= w * apply_days AND c.i < w * apply_days + train_days
      JOIN u ON u.day = c.day GROUP BY ALL),
    sv AS (SELECT ft.*, u.y, u.cost, CASE WHEN base + slope * x > {EDGE} THEN 1
      WHEN base + slope * x < -{EDGE} THEN -1 ELSE 0 END AS s FROM ft
      JOIN c ON c.i >= w * apply_days + train_days AND c.i < (w + 1) * apply_days + train_days JOIN u ON u.day = c.day
      WHERE slope IS NOT NULL),
    rw AS (SELECT train_days, apply_days, w, count(*) AS rows, count(*) FILTER (s <> 0) AS trades,
      sum(CASE WHEN s <> 0 THEN s * y - cost END) AS net_sum FROM sv GROUP BY ALL),
    wd AS (SELECT ft.train_days, ft.apply_days, ft.w AS "window", train_rows, base, slope,
      coalesce(rows, 0) AS rows, coalesce(trades, 0) AS trades, net_sum
      FROM ft LEFT JOIN rw USING (train_days, apply_days, w))"""


def refits(fx: Fixtures) -> DataFrame:
    from tickloom.plans.queries_decide import joined

    rows = joined(fx).select(
        day_of("us").alias("day"), "p_buy", "forward_bp", (F.col("spread_bp") + 11).alias("cost")
    )
    return search.refit_windows(rows, "day", ["p_buy"], "forward_bp", "cost", EDGE)


@query(
    "v8_refit_windows",
    f"WITH {REFITS} SELECT * FROM wd",
    d="base slope net_sum",
    i="train_days apply_days window train_rows rows trades",
    digits=4,
)
def v8w(fx: Fixtures) -> DataFrame:
    at = lambda k: F.element_at("coefficients", k)
    return refits(fx).select("*", at(1).alias("base"), at(2).alias("slope")).drop("coefficients")


@query(
    "v8_retrain_search",
    f"""
    WITH {REFITS}, s AS (SELECT train_days, apply_days, count(*) AS refits, count(*) FILTER (slope IS NULL) AS skipped,
      sum(rows) AS rows, sum(trades) AS trades, sum(net_sum) / nullif(sum(trades), 0) AS net_per_trade_bp
      FROM wd GROUP BY ALL),
    a AS (SELECT *, refits - skipped >= 3 AND net_per_trade_bp IS NOT NULL AS able FROM s)
    SELECT * EXCLUDE (able), able AND row_number() OVER (ORDER BY CASE WHEN able THEN net_per_trade_bp END DESC
      NULLS LAST, train_days, apply_days) = 1 AS chosen FROM a""",
    d="net_per_trade_bp",
    i="train_days apply_days refits skipped rows trades",
    digits=4,
)
def v8(fx: Fixtures) -> DataFrame:
    return search.retrain_search(refits(fx))


@query("v9_successive_halving", None)
def v9(fx: Fixtures) -> DataFrame:
    months = fx.cells.groupBy("key", F.trunc("day", "month").alias("month")).agg(
        F.avg("net_bp").alias("net_bp")
    )
    return search.halving(months, "key", "month", "net_bp", first=10)


CHECKED = ["ofi_20_norm", "mid_return_20_bp", "realized_vol_50_bp", "touch_persistence_20"]


@query(
    "v10_truncation_check",
    f"SELECT (SELECT count(*) FROM fx_book WHERE us < {CUT}) AS rows, c AS \"column\", 0 AS differing "
    f"FROM (VALUES {', '.join(repr((c,)).replace(',)', ')') for c in CHECKED)}) t(c)",
    i="differing",
)
def v10(fx: Fixtures) -> DataFrame:
    return causality.truncation_check(fx.book, lambda df: build_features(df, CHECKED), CHECKED, CUT)


@query(
    "v11_lookback_check",
    "SELECT count(DISTINCT symbol) AS rows, 'ofi_20_norm' AS \"column\", 0 AS differing FROM fx_book",
    i="differing",
)
def v11(fx: Fixtures) -> DataFrame:
    names = ["ofi_20_norm"]
    return causality.lookback_check(fx.book, lambda df: build_features(df, names), names, 70)


@query(
    "v12_timed_causal_check",
    f"SELECT (SELECT count(*) FROM fx_book WHERE us < {CUT}) AS rows, 'turn_count_1800s' AS \"column\", "
    "0 AS differing",
    i="differing",
)
def v12(fx: Fixtures) -> DataFrame:
    rows = fx.book.select("symbol", "us", "seq", "bid_price_0", "ask_price_0")
    return causality.truncation_check(rows, lambda df: turn_counts(df, (1800,)), ["turn_count_1800s"], CUT)


@query(
    "v13_mutation_check",
    f"SELECT count(*) AS rows, true AS equal FROM fx_book WHERE us < {CUT}",
)
def v13(fx: Fixtures) -> DataFrame:
    return causality.mutation_check(
        fx.book, lambda df: build_features(df, CHECKED), CHECKED, CUT, "bid_size_0"
    )


# ------------------------------------------------------------------------------- breaks

BLOCKS = f"""
    b0 AS (SELECT symbol, us, seq, (bid_price_0 + ask_price_0) / 2 AS mid, (ask_price_0 - bid_price_0)
      / ((bid_price_0 + ask_price_0) / 2) * 1e4 AS sp, (row_number() OVER ({ROW}) - 1) // 50 AS block
      FROM fx_book),
    b1 AS (SELECT *, ln(mid / lag(mid) OVER ({ROW})) AS ret FROM b0),
    b2 AS (SELECT *, CASE WHEN lag(block) OVER ({ROW}) = block THEN lag(ret) OVER ({ROW}) END AS was
      FROM b1),
    b3 AS (SELECT symbol, block, max(us) AS end_us, stddev_pop(ret) AS volatility, avg(sp) AS spread,
      avg(CASE WHEN abs(ret) > 0 THEN 1.0 ELSE 0.0 END) AS intensity, corr(ret, was) AS
      autocorrelation FROM b2 GROUP BY 1, 2 HAVING count(*) = 50)"""


@query(
    "b1_block_statistics",
    f"WITH {BLOCKS} SELECT * FROM b3",
    d="volatility spread intensity autocorrelation",
)
def b1(fx: Fixtures) -> DataFrame:
    return breaks.block_statistics(fx.book, 50, spine=fx.spine)


def break_rows(fx: Fixtures) -> DataFrame:
    scores = breaks.block_scores(breaks.block_statistics(fx.book, 50, spine=fx.spine), 10)
    return breaks.changepoints(scores, threshold=4.0, minimum_gap=3)


@query("b1_changepoints", None)
def b1b(fx: Fixtures) -> DataFrame:
    return break_rows(fx)


@query("b2_segments", None)
def b2(fx: Fixtures) -> DataFrame:
    totals = fx.book.groupBy("symbol").agg(F.floor(F.count(F.lit(1)) / 50).cast("long").alias("total"))
    return breaks.segments(break_rows(fx), totals, 5)


KILL = """
    hr AS (SELECT symbol, us, ln(close / lag(close) OVER w) AS ret FROM fx_bars
      WINDOW w AS (PARTITION BY symbol ORDER BY us)),
    h1 AS (SELECT symbol, us, ret, count(*) OVER p AS n, stddev_samp(ret) OVER p AS sd FROM hr
      WHERE ret IS NOT NULL WINDOW p AS (PARTITION BY symbol ORDER BY us ROWS BETWEEN UNBOUNDED
      PRECEDING AND 1 PRECEDING)),
    h2 AS (SELECT *, CASE WHEN n >= 72 THEN ret / sd END AS z FROM h1),
    h3 AS (SELECT *, sum(CASE WHEN z IS NOT NULL THEN -z - 0.1 ELSE 0 END) OVER (PARTITION BY symbol
      ORDER BY us) AS c FROM h2),
    h4 AS (SELECT *, c - least(0, min(c) OVER (PARTITION BY symbol ORDER BY us)) AS statistic FROM h3)"""


def switched(fx: Fixtures) -> DataFrame:
    return breaks.kill_switch(hourly_returns(fx.bars), k=0.1, h=3.0)


@query(
    "b3_kill_switch",
    f"WITH {KILL} SELECT symbol, us, ret, z, statistic, statistic > 3 AS over FROM h4".replace(
        "AS over", 'AS "over"'
    ),
    d="ret z statistic",
)
def b3(fx: Fixtures) -> DataFrame:
    return switched(fx)


@query(
    "b3_first_stop",
    f"WITH {KILL} SELECT symbol, min(us) AS stop_us FROM h4 WHERE statistic > 3 GROUP BY 1",
)
def b3b(fx: Fixtures) -> DataFrame:
    return breaks.first_stops(switched(fx))


@query("b3_stop_and_restart", None)
def b3c(fx: Fixtures) -> DataFrame:
    return breaks.switch_with_restart(switched(fx), 0.1, 3.0)


ALARMS = "al AS (SELECT symbol, us, CASE WHEN rate > 0 THEN 1 ELSE -1 END AS direction FROM fx_funding WHERE abs(rate) > 1e-4)"


def alarms(fx: Fixtures) -> DataFrame:
    return fx.funding.filter(F.abs("rate") > 1e-4).select(
        "symbol", "us", F.when(F.col("rate") > 0, 1).otherwise(-1).alias("direction")
    )


@query(
    "b4_pause_mask",
    f"""
    WITH {ALARMS} SELECT d.symbol, d.us, d.seq, coalesce(al.direction > 0, false) AS paused FROM
      fx_book d ASOF LEFT JOIN al ON d.symbol = al.symbol AND d.us > al.us""",
)
def b4(fx: Fixtures) -> DataFrame:
    return breaks.pause_mask(fx.book.select("symbol", "us", "seq"), alarms(fx)).select(
        "symbol", "us", "seq", "paused"
    )


@query(
    "b5_guarded_rows",
    f"""
    WITH {ALARMS} SELECT d.symbol, d.us, d.seq, coalesce(d.us - al.us < 7200000000, false) AS guarded
    FROM fx_book d ASOF LEFT JOIN al ON d.symbol = al.symbol AND d.us >= al.us""",
)
def b5(fx: Fixtures) -> DataFrame:
    return breaks.guarded(fx.book.select("symbol", "us", "seq"), alarms(fx), 7200).select(
        "symbol", "us", "seq", "guarded"
    )


@query(
    "b6_episode_scores",
    f"""
    WITH {KILL}, ep AS (SELECT CASE WHEN w = 0 THEN 'early' ELSE 'late' END AS episode, 1704067200000000
      + w * 1209600000000 AS a, 1704067200000000 + (w + 1) * 1209600000000 AS b FROM range(0, 2) t(w))
    SELECT episode, symbol, count(*) AS periods, sum(ret) AS total, avg(CASE WHEN us < (a + b) / 2 THEN
      ret END) AS "before", avg(CASE WHEN us >= (a + b) / 2 THEN ret END) AS "after" FROM h1 JOIN ep ON
      us >= a AND us < b GROUP BY 1, 2""",
    d="total before after",
    digits=9,
)
def b6(fx: Fixtures) -> DataFrame:
    first, span = 1_704_067_200_000_000, 1_209_600_000_000
    named = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("episode"),
                    F.lit(first + k * span).alias("from_us"),
                    F.lit(first + (k + 1) * span).alias("to_us"),
                )
                for k, n in enumerate(("early", "late"))
            ]
        )
    ).alias("e")
    episodes = fx.spark.range(1).select(named).select("e.*")
    return breaks.episode_scores(hourly_returns(fx.bars), episodes)


@query(
    "b7_regime_gate",
    f"""
    WITH {CLOCK}, ix AS (SELECT us, avg(log_price) AS x, row_number() OVER (ORDER BY us) - 1 AS r FROM hp
      GROUP BY us), k AS (SELECT us, x - lag(x) OVER (ORDER BY us) AS ret FROM ix WHERE r % 4 = 0),
    g AS (SELECT us, ret, us % 86400000000 < 21600000000 AS paused, row_number() OVER (ORDER BY us) - 1
      AS i, count(*) OVER () AS n FROM k WHERE ret IS NOT NULL)
    SELECT 'index' AS symbol, s AS shift, avg(a.ret) AS ungated, avg(CASE WHEN NOT b.paused THEN a.ret
      END) AS gated, avg(CASE WHEN b.paused THEN 1.0 ELSE 0.0 END) AS share_paused FROM g a, range(0, 20)
      t(s) JOIN g b ON true WHERE b.i = (a.i - CAST(round(s * a.n / 20) AS BIGINT) + a.n) % a.n
    GROUP BY 1, 2""",
    d="ungated gated share_paused",
    i="shift",
    digits=9,
)
def b7(fx: Fixtures) -> DataFrame:
    index = clock_prices(fx).groupBy("us").agg(F.avg("log_price").alias("index")).select(
        F.lit("index").alias("symbol"), "us", "index"
    )
    returns = breaks.every_kth_return(index, 4)
    marked = returns.withColumn("paused", F.col("us") % 86_400_000_000 < 21_600_000_000)
    return breaks.gated_against_shifts(marked, 19)
