"""Labels, costs, projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import costs, labels
from tickloom.functions.book import build_features
from tickloom.operators import filters, trades
from tickloom.operators.quantiles import quantile_by
from tickloom.plans.fixtures import Fixtures
from tickloom.plans.queries_book import BASE
from tickloom.plans.queries_flow import back
from tickloom.plans.queries_panel import walk_sql
from tickloom.plans.queries_sources import TIERS
from tickloom.plans.registry import query

ROW = "PARTITION BY symbol ORDER BY us, seq"
MID = "m AS (SELECT symbol, us, seq, (bid_price_0 + ask_price_0) / 2 AS mid FROM fx_book)"
FWD = f"{MID}, f AS (SELECT *, 1e4 * ln(lead(mid, 10) OVER ({ROW}) / mid) AS forward_bp FROM m)"


def fwd(fx: Fixtures, h: int = 10) -> DataFrame:
    return labels.forward_return(fx.book, h, spine=fx.spine)


@query("l1_forward_return", f"WITH {FWD} SELECT symbol, us, seq, forward_bp FROM f", d="forward_bp")
def l1(fx: Fixtures) -> DataFrame:
    return fwd(fx)


@query(
    "l1_forward_return_simple",
    f"WITH {MID} SELECT symbol, us, seq, (lead(mid, 10) OVER ({ROW}) / mid - 1) * 1e4 AS forward_bp "
    "FROM m",
    d="forward_bp",
)
def l1b(fx: Fixtures) -> DataFrame:
    return labels.forward_return(fx.book, 10, simple=True, spine=fx.spine)


LABEL = "CASE WHEN forward_bp > 50 THEN 1 WHEN forward_bp < -50 THEN -1 WHEN forward_bp IS NOT NULL THEN 0 END"


@query("l2_three_class", f"WITH {FWD} SELECT symbol, us, seq, {LABEL} AS label FROM f", i="label")
def l2(fx: Fixtures) -> DataFrame:
    return fwd(fx).select("symbol", "us", "seq", labels.three_class(F.col("forward_bp"), 50).alias("label"))


@query(
    "l3_class_balance",
    f"""
    WITH {FWD}, l AS (SELECT {LABEL} AS label FROM f)
    SELECT label, count(*) AS rows, count(*) / (SELECT count(label) FROM l) AS share
    FROM l WHERE label IS NOT NULL GROUP BY 1""",
    d="share",
    i="label",
)
def l3(fx: Fixtures) -> DataFrame:
    named = fwd(fx).select(labels.three_class(F.col("forward_bp"), 50).alias("label"))
    return labels.class_balance(named)


@query(
    "l4_threshold_for_share",
    f"WITH {FWD} SELECT quantile_cont(abs(forward_bp), 0.8) AS threshold_bp FROM f",
    d="threshold_bp",
)
def l4(fx: Fixtures) -> DataFrame:
    return labels.threshold_for_share(fwd(fx), 0.2)


@query(
    "l5_round_trip_cost",
    "SELECT symbol, us, seq, 10 + spread_bp + 1 AS cost_bp FROM fx_decisions",
    d="cost_bp",
)
def l5(fx: Fixtures) -> DataFrame:
    cost = costs.TakerCosts().round_trip("spread_bp")
    return fx.decisions.select("symbol", "us", "seq", cost.alias("cost_bp"))


SMOOTH = f"{MID}, a AS (SELECT *, avg(mid) OVER ({ROW} ROWS 4 PRECEDING) AS av, 1e4 * ln(mid / lag(mid) OVER ({ROW})) AS step FROM m)"


@query(
    "l6_smoothed_move",
    f"WITH {SMOOTH} SELECT symbol, us, seq, 1e4 * ln(lead(av, 10) OVER ({ROW}) / av) AS move_bp FROM a",
    d="move_bp",
)
def l6(fx: Fixtures) -> DataFrame:
    return labels.smoothed_move(fx.book, 10, 5, spine=fx.spine)


@query(
    "l7_forward_smoothed_move",
    f"WITH {SMOOTH} SELECT symbol, us, seq, 1e4 * ln(lead(av, 10) OVER ({ROW}) / mid) AS move_bp FROM a",
    d="move_bp",
)
def l7(fx: Fixtures) -> DataFrame:
    return labels.smoothed_move(fx.book, 10, 5, from_now=True, spine=fx.spine)


NORMAL = f"""
    {SMOOTH}, s AS (SELECT *, CASE WHEN count(step) OVER g >= 25 THEN stddev_samp(step) OVER g END
      AS sigma, 1e4 * ln(lead(av, 10) OVER ({ROW}) / av) AS mv FROM a
      WINDOW g AS ({ROW} ROWS 49 PRECEDING))"""


@query(
    "l8_direction_magnitude_normalised",
    f"""
    WITH {NORMAL}
    SELECT symbol, us, seq, CASE WHEN sigma > 0 THEN mv / sigma END AS magnitude,
      CASE WHEN sigma > 0 AND mv IS NOT NULL THEN CASE WHEN abs(mv / sigma) > 1 THEN sign(mv)
        ELSE 0 END END AS direction FROM s""",
    d="magnitude direction",
)
def l8(fx: Fixtures) -> DataFrame:
    moves = labels.normalised_move(fx.book, 10, 5, 50, spine=fx.spine, name="magnitude")
    return moves.select(
        "symbol", "us", "seq", "magnitude", labels.direction(F.col("magnitude"), 1.0).alias("direction")
    )


@query(
    "l9_net_and_smoothed_direction",
    f"""
    WITH {FWD}, {SMOOTH.replace(MID + ', ', '')}, d AS (SELECT symbol, us, seq,
      1e4 * ln(lead(av, 10) OVER ({ROW}) / av) AS mv FROM a)
    SELECT symbol, us, seq, forward_bp - 12 AS net_pnl, CASE WHEN mv IS NOT NULL THEN
      CASE WHEN abs(mv) > 12 THEN sign(mv) ELSE 0 END END AS smoothed_direction
    FROM f JOIN d USING (symbol, us, seq)""",
    d="net_pnl smoothed_direction",
)
def l9(fx: Fixtures) -> DataFrame:
    net = labels.build_target("net_pnl", fx.book, 10, cost_bp=12, spine=fx.spine)
    smooth = labels.build_target(
        "smoothed_direction", fx.book, 10, cost_bp=12, smoothing=5, spine=fx.spine
    )
    return net.withColumnRenamed("target", "net_pnl").join(
        smooth.withColumnRenamed("target", "smoothed_direction"), ["symbol", "us", "seq"]
    )


@query(
    "l10_triple_barrier",
    f"""
    WITH {MID}, n AS (SELECT *, row_number() OVER ({ROW}) AS r, count(*) OVER (PARTITION BY symbol)
      AS total FROM m),
    p AS (SELECT a.symbol, a.us, a.seq, a.r, b.r - a.r AS k, (b.mid / a.mid - 1) * 1e4 AS mv
      FROM n a JOIN n b ON a.symbol = b.symbol AND b.r > a.r AND b.r <= a.r + 20),
    t AS (SELECT symbol, us, seq, min(CASE WHEN mv >= 60 THEN k END) AS up,
      min(CASE WHEN mv <= -60 THEN k END) AS dn FROM p GROUP BY 1, 2, 3)
    SELECT n.symbol, n.us, n.seq, CASE WHEN r <= total - 20 THEN CASE WHEN up IS NULL AND dn IS NULL
      THEN 0 WHEN dn IS NULL OR up <= dn THEN 1 ELSE -1 END END AS label
    FROM n LEFT JOIN t USING (symbol, us, seq)""",
    i="label",
)
def l10(fx: Fixtures) -> DataFrame:
    return labels.triple_barrier(fx.book, 20, 60, 60, spine=fx.spine)


WALKED = f"""
    wb AS {walk_sql('ask', 12)}, ws AS {walk_sql('bid', 12)},
    v AS (SELECT b.symbol, b.us, b.seq, (b.bid_price_0 + b.ask_price_0) / 2 AS mid,
      (wb.paid + greatest(12 - wb.visible, 0) * wb.deepest) / 12 AS bv, wb.visible < 12 AS be,
      (ws.paid + greatest(12 - ws.visible, 0) * ws.deepest) / 12 AS sv, ws.visible < 12 AS se
      FROM fx_book b JOIN wb USING (symbol, us, seq) JOIN ws USING (symbol, us, seq)),
    e AS (SELECT d.symbol, d.us, d.seq, n.us AS entry_us, n.mid AS em, n.bv AS ebv, n.sv AS esv,
      n.be OR n.se AS entry_exceeds FROM v d ASOF JOIN v n ON d.symbol = n.symbol
      AND d.us + 1000000 <= n.us),
    h AS (SELECT e.*, hold FROM e, (VALUES (CAST(1800 AS BIGINT)), (7200)) t(hold)),
    ht AS (SELECT h.symbol, h.us, h.seq, h.hold AS hold_s, h.entry_us, x.us AS exit_us,
      (x.sv - h.ebv) / h.em * 1e4 AS long_bp, (h.esv - x.bv) / h.em * 1e4 AS short_bp,
      CASE WHEN x.us IS NULL THEN false ELSE h.entry_exceeds END AS entry_exceeds,
      CASE WHEN x.us IS NULL THEN false ELSE x.be OR x.se END AS exit_exceeds
      FROM h ASOF LEFT JOIN v x ON h.symbol = x.symbol AND h.entry_us + h.hold * 1000000 <= x.us)"""


def table(fx: Fixtures, holds: tuple[int, ...] = (1800, 7200)) -> DataFrame:
    return trades.hold_table(fx.book, holds, clip=12, depth=5, latency_ms=1000)


@query(
    "l11_walked_taker_label",
    f"""
    WITH {WALKED}
    SELECT symbol, us, seq, long_bp, short_bp, entry_exceeds, exit_exceeds,
      CASE WHEN long_bp IS NOT NULL AND NOT entry_exceeds THEN CASE WHEN short_bp > 0 THEN -1
        WHEN long_bp > 0 THEN 1 ELSE 0 END END AS label FROM ht WHERE hold_s = 1800""",
    d="long_bp short_bp",
    i="label",
)
def l11(fx: Fixtures) -> DataFrame:
    made = table(fx, (1800,))
    return made.select(
        "symbol",
        "us",
        "seq",
        "long_bp",
        "short_bp",
        "entry_exceeds",
        "exit_exceeds",
        trades.walked_label(made).alias("label"),
    )


@query(
    "l12_forward_between_snapshots",
    f"""
    WITH {MID}, e AS (SELECT d.symbol, d.us, d.seq, n.us AS eu, n.mid AS em FROM m d ASOF LEFT JOIN
      m n ON d.symbol = n.symbol AND d.us + 1000000 <= n.us)
    SELECT e.symbol, e.us, e.seq, (x.mid / e.em - 1) * 1e4 AS move_bp FROM e ASOF LEFT JOIN m x
      ON e.symbol = x.symbol AND e.eu + 3600000000 <= x.us""",
    d="move_bp",
)
def l12(fx: Fixtures) -> DataFrame:
    return labels.forward_between_snapshots(fx.book, 3600, 1000)


@query(
    "l13_control_move",
    f"""
    WITH {MID}, s AS (SELECT *, CASE WHEN count(mid) OVER w >= 20 THEN avg(mid) OVER w END AS sm
      FROM m WINDOW w AS ({ROW} ROWS 19 PRECEDING))
    SELECT d.symbol, d.us, d.seq, 1e4 * ln(x.sm / d.sm) AS move_bp FROM s d ASOF LEFT JOIN s x
      ON d.symbol = x.symbol AND d.us + 3600000000 <= x.us""",
    d="move_bp",
)
def l13(fx: Fixtures) -> DataFrame:
    return labels.control_move(fx.book, 3600, 20, spine=fx.spine)


@query(
    "l14_relative_change_classes",
    f"""
    WITH {MID}, r AS (SELECT *, CASE WHEN count(mid) OVER p >= 10 AND count(mid) OVER n >= 10 THEN
      (avg(mid) OVER n - avg(mid) OVER p) / avg(mid) OVER p END AS rel FROM m
      WINDOW p AS ({ROW} ROWS 9 PRECEDING), n AS ({ROW} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))
    SELECT symbol, us, seq, rel AS rel_change, CASE WHEN rel > 0.002 THEN 3 WHEN rel < -0.002 THEN 1
      ELSE 2 END AS label FROM r""",
    d="rel_change",
    i="label",
    digits=9,
)
def l14(fx: Fixtures) -> DataFrame:
    out = labels.relative_change(fx.book, 10, spine=fx.spine)
    return out.withColumn("label", labels.down_flat_up(F.col("rel_change"), 0.002))


@query(
    "l15_target_registry",
    f"""
    WITH {FWD} SELECT symbol, us, seq, CASE WHEN forward_bp IS NOT NULL THEN CASE WHEN
      abs(forward_bp) > 30 THEN sign(forward_bp) ELSE 0 END END AS target FROM f""",
    d="target",
)
def l15(fx: Fixtures) -> DataFrame:
    return labels.build_target("direction", fx.book, 10, cost_bp=30, spine=fx.spine)


@query(
    "l16_shift_labels_by_days",
    f"""
    WITH {FWD}, l AS (SELECT symbol, us, seq, {LABEL} AS label, us // 86400000000 AS day,
      row_number() OVER (PARTITION BY symbol, us // 86400000000 ORDER BY us, seq) AS n FROM f),
    d AS (SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i,
      count(*) OVER (PARTITION BY symbol) AS days FROM (SELECT DISTINCT symbol, day FROM l)),
    x AS (SELECT l.*, i, days FROM l JOIN d USING (symbol, day))
    SELECT a.symbol, a.us, a.seq, a.label, b.label AS label_shifted FROM x a LEFT JOIN x b
      ON a.symbol = b.symbol AND b.i = (a.i + 3) % a.days AND a.n = b.n""",
    i="label label_shifted",
)
def l16(fx: Fixtures) -> DataFrame:
    named = fwd(fx).select(
        "symbol", "us", "seq", labels.three_class(F.col("forward_bp"), 50).alias("label")
    )
    return labels.shift_by_days(named, 3, "label")


# ------------------------------------------------------------------------------- costs


@query(
    "c1_walk_levels",
    f"""
    SELECT symbol, us, seq, (paid + greatest(12 - visible, 0) * deepest) / 12 AS vwap,
      greatest(12 - visible, 0) AS beyond, visible, levels, visible < 12 AS exceeds
    FROM {walk_sql('ask', 12)}""",
    d="vwap beyond visible",
    i="levels",
)
def c1(fx: Fixtures) -> DataFrame:
    walked = costs.walk_side("ask", 12, 5)
    return fx.book.select("symbol", "us", "seq", *[c.alias(n) for n, c in walked.items()])


@query(
    "c2_same_snapshot_round_trip",
    f"""
    WITH {WALKED} SELECT symbol, us, seq, (bv - sv) / mid * 1e4 AS walk_cost_bp FROM v""",
    d="walk_cost_bp",
)
def c2(fx: Fixtures) -> DataFrame:
    walked = costs.with_walks(fx.book, 12, 5, keep=("bid_price_0", "ask_price_0"))
    cost = costs.walk_cost_bp(
        F.col("mid"),
        F.col("buy_vwap"),
        F.col("sell_vwap"),
        F.col("bid_price_0") > F.col("ask_price_0"),
    )
    return walked.select("symbol", "us", "seq", cost.alias("walk_cost_bp"))


@query(
    "c3_taker_costs",
    """
    SELECT symbol, us, seq, 2 * 4.5 + 2 * 0.25 + spread_bp AS round_trip_bp,
      4.5 + 0.25 + spread_bp / 2 AS entry_bp FROM fx_decisions""",
    d="round_trip_bp entry_bp",
)
def c3(fx: Fixtures) -> DataFrame:
    paid = costs.TakerCosts(4.5, 0.25)
    return fx.decisions.select(
        "symbol",
        "us",
        "seq",
        paid.round_trip("spread_bp").alias("round_trip_bp"),
        paid.entry("spread_bp").alias("entry_bp"),
    )


@query(
    "c4_fee_tiers",
    f"""
    WITH {TIERS}, b AS (SELECT * FROM fees WHERE grp IN ('all', 'g1') ORDER BY maker_bp, taker_bp
      LIMIT 1),
    n AS (SELECT series, sum(net_bp) AS net, count(*) * 10000.0 AS turnover FROM fx_li_trades
      GROUP BY 1)
    SELECT series, tier, maker_bp, taker_bp, maker_bp + net / turnover * 1e4 AS breakeven_maker_bp
    FROM n, b""",
    d="maker_bp taker_bp breakeven_maker_bp",
)
def c4(fx: Fixtures) -> DataFrame:
    best = costs.best_maker_tier(costs.fee_table(fx.spark), "g1")
    sums = fx.li_trades.groupBy("series").agg(
        F.sum("net_bp").alias("net"), (F.count(F.lit(1)) * 10_000.0).alias("turnover")
    )
    joined = sums.join(F.broadcast(best))  # one row
    level = costs.breakeven_maker(F.col("net"), F.col("turnover"), F.col("maker_bp"))
    return joined.select("series", "tier", "maker_bp", "taker_bp", level.alias("breakeven_maker_bp"))


@query(
    "c4_named_tier",
    f"""
    WITH {TIERS} SELECT series, tier, maker_bp, taker_bp, sum(gross_bp - 2 * taker_bp) AS net_bp
    FROM fx_li_trades, fees WHERE tier = 'vip5' GROUP BY ALL""",
    d="maker_bp taker_bp net_bp",
)
def c4b(fx: Fixtures) -> DataFrame:
    """Results of every series at the taker fees of one named tier."""
    tier = costs.fee_tier(costs.fee_table(fx.spark), "vip5")
    joined = fx.li_trades.join(F.broadcast(tier))  # one row
    net = F.sum(F.col("gross_bp") - 2 * F.col("taker_bp"))
    return joined.groupBy("series", "tier", "maker_bp", "taker_bp").agg(net.alias("net_bp"))


@query(
    "c5_breakeven_share_by_horizon",
    f"""
    WITH {MID}, f AS (SELECT h, CASE h WHEN 5 THEN lead(mid, 5) OVER w WHEN 20 THEN lead(mid, 20)
      OVER w END AS later, mid FROM m, (VALUES (5), (20)) t(h)
      WINDOW w AS (PARTITION BY h, symbol ORDER BY us, seq))
    SELECT h AS horizon, avg(CASE WHEN abs(1e4 * ln(later / mid)) > 40 THEN 1.0 ELSE 0.0 END)
      AS share FROM f GROUP BY 1""",
    d="share",
    i="horizon",
)
def c5(fx: Fixtures) -> DataFrame:
    moves = fwd(fx, 5).withColumnRenamed("forward_bp", "m5").join(
        fwd(fx, 20).withColumnRenamed("forward_bp", "m20"), ["symbol", "us", "seq"]
    )
    wide = moves.agg(
        costs.breakeven_share(F.col("m5"), F.lit(40)).alias("5"),
        costs.breakeven_share(F.col("m20"), F.lit(40)).alias("20"),
    )
    return wide.unpivot([], ["5", "20"], "horizon", "share").select(
        F.col("horizon").cast("long").alias("horizon"), "share"
    )


# ------------------------------------------------------------------- projections, filters


@query(
    "p1_mid_spread",
    """
    SELECT symbol, us, seq, (bid_price_0 + ask_price_0) / 2 AS mid, ask_price_0 - bid_price_0
      AS spread, bid_price_0 AS best_bid, ask_price_0 AS best_ask FROM fx_book""",
    d="mid spread best_bid best_ask",
)
def p1(fx: Fixtures) -> DataFrame:
    bid, ask = F.col("bid_price_0"), F.col("ask_price_0")
    return fx.book.select(
        "symbol",
        "us",
        "seq",
        ((bid + ask) / 2).alias("mid"),
        (ask - bid).alias("spread"),
        bid.alias("best_bid"),
        ask.alias("best_ask"),
    )


@query(
    "p2_signed_quantity",
    "SELECT symbol, trade_id, CASE WHEN is_buyer_maker THEN -quantity ELSE quantity END AS signed "
    "FROM fx_trades",
    d="signed",
)
def p2(fx: Fixtures) -> DataFrame:
    signed = F.when(F.col("is_buyer_maker"), -F.col("quantity")).otherwise(F.col("quantity"))
    return fx.trades.select("symbol", "trade_id", signed.alias("signed"))


@query(
    "p3_feature_projection",
    f"""
    {BASE} SELECT symbol, us, seq, spread AS spread_bp, imb AS queue_imbalance,
      1e4 * ln(mid / lag(mid, 20) OVER ({ROW})) AS mid_return_20_bp FROM e
    QUALIFY mid_return_20_bp IS NOT NULL""",
    d="spread_bp queue_imbalance mid_return_20_bp",
)
def p3(fx: Fixtures) -> DataFrame:
    names = ["spread_bp", "queue_imbalance", "mid_return_20_bp"]
    return build_features(fx.book, names, spine=fx.spine, dropna=True)


@query(
    "p4_complete_rows",
    f"WITH {FWD} SELECT symbol, us, seq, forward_bp FROM f WHERE forward_bp IS NOT NULL",
    d="forward_bp",
)
def p4(fx: Fixtures) -> DataFrame:
    return fwd(fx).na.drop(subset=["forward_bp"])


GATE = f"""
    g0 AS (SELECT symbol, us, seq, (bid_price_0 + ask_price_0) / 2 AS mid, 1e4 * (ask_price_0 -
      bid_price_0) / ((bid_price_0 + ask_price_0) / 2) AS spread_bp FROM fx_book),
    g1 AS (SELECT *, pow(ln(mid / lag(mid) OVER ({ROW})), 2) AS sq FROM g0),
    gi AS (SELECT symbol, us, seq, spread_bp, CASE WHEN sq IS NOT NULL THEN
      1e4 * sqrt(sum(sq) OVER {back(7200)}) END AS volatility_bp FROM g1)"""


@query(
    "p5_market_gate",
    f"""
    WITH {GATE}, t AS (SELECT quantile_cont(volatility_bp, 0.5) AS fl, quantile_cont(spread_bp, 0.9)
      AS cp FROM gi WHERE us < 1705276800000000)
    SELECT symbol, us, seq, coalesce(volatility_bp >= fl, false) AND coalesce(spread_bp <= cp, false)
      AS allowed FROM gi, t WHERE us >= 1705276800000000""",
)
def p5(fx: Fixtures) -> DataFrame:
    inputs = filters.gate_inputs(fx.book, 7200, spine=fx.spine)
    cut = F.lit(1_705_276_800_000_000)
    levels = filters.gate_levels(inputs.filter(F.col("us") < cut), 0.5, 0.9)
    out = filters.gated(inputs.filter(F.col("us") >= cut), levels)
    return out.select(
        "symbol", "us", "seq", (F.col("quiet_out") & F.col("tight_only")).alias("allowed")
    )


@query(
    "p6_stamped_gate",
    f"""
    WITH {GATE}, t AS (SELECT quantile_cont(volatility_bp, 0.3) AS fl, quantile_cont(spread_bp, 0.7)
      AS cp FROM gi)
    SELECT symbol, us, seq, volatility_bp, spread_bp, coalesce(volatility_bp >= fl, false)
      AS quiet_out, coalesce(spread_bp <= cp, false) AS tight_only FROM gi, t""",
    d="volatility_bp spread_bp",
)
def p6(fx: Fixtures) -> DataFrame:
    inputs = filters.gate_inputs(fx.book, 7200, spine=fx.spine)
    return filters.gated(inputs, filters.gate_levels(inputs))


@query(
    "p7_entry_hours",
    """
    SELECT symbol, us, seq, us - us % 86400000000 + 86340000000 AS flatten_us FROM fx_book
    WHERE us % 86400000000 BETWEEN 60000000 AND 86280000000""",
)
def p7(fx: Fixtures) -> DataFrame:
    kept = fx.book.filter(filters.entry_allowed(F.col("us")))
    return kept.select("symbol", "us", "seq", filters.flatten_us(F.col("us")).alias("flatten_us"))


@query(
    "p8_day_range",
    "SELECT symbol, us, seq FROM fx_book WHERE us >= 1704844800000000 AND us < 1705276800000000",
)
def p8(fx: Fixtures) -> DataFrame:
    inside = (F.col("us") >= 1_704_844_800_000_000) & (F.col("us") < 1_705_276_800_000_000)
    return fx.book.filter(inside).select("symbol", "us", "seq")


@query(
    "p9_reprice_at_fee",
    f"""
    WITH {TIERS}, a AS (SELECT net_bp, okey % 4 <> 0 AS filled, okey % 3 = 0 AS crossed
      FROM fx_li_trades),
    s AS (SELECT avg(net_bp) AS n, avg(CASE WHEN filled THEN 1.0 ELSE 0.0 END) AS f,
      avg(CASE WHEN filled AND crossed THEN 1.0 ELSE 0.0 END) AS c FROM a)
    SELECT tier, n - f * (maker_bp - 2.0) - c * (taker_bp - 5.5) - (f - c) * (maker_bp - 2.0)
      AS net_bp FROM fees, s""",
    d="net_bp",
)
def p9(fx: Fixtures) -> DataFrame:
    attempts = fx.li_trades.select(
        "net_bp", (F.col("okey") % 4 != 0).alias("filled"), (F.col("okey") % 3 == 0).alias("crossed")
    )
    return filters.reprice(attempts, costs.fee_table(fx.spark), "base", "passive")


@query("p10_sample_configurations", None)
def p10(fx: Fixtures) -> DataFrame:
    space = fx.cells.select("a_line", "a_flag", "a_qty")
    return filters.sample_configurations(space, 20, 7)


@query(
    "p11_near_book",
    """
    SELECT p.symbol, p.us, p.trade_id, p.price FROM fx_prints p ASOF LEFT JOIN fx_book b
      ON p.symbol = b.symbol AND p.us - 1 >= b.us
    WHERE b.us IS NULL OR greatest(b.bid_price_4 - p.price, p.price - b.ask_price_4) / p.price * 1e4
      <= 30""",
    d="price",
)
def p11(fx: Fixtures) -> DataFrame:
    # Our book stamps are print stamps, so a print is held against the snapshot before its own.
    shifted = fx.book.withColumn("us", F.col("us") + 1)
    out = filters.near_book(fx.prints, shifted, 5, 30)
    return out.select("symbol", "us", "trade_id", "price")


@query(
    "p12_sweep_order",
    """
    SELECT symbol, trade_id, row_number() OVER (PARTITION BY symbol, us // 60000000 ORDER BY
      aggressor, aggressor * price, -size, trade_id) AS place FROM fx_prints""",
)
def p12(fx: Fixtures) -> DataFrame:
    from pyspark.sql import Window

    from tickloom.sources.prints import sweep_keys

    stamped = fx.prints.withColumn("us", F.floor(F.col("us") / F.lit(60_000_000)).cast("long"))
    # One stamp of one instrument is the whole group: its prints share a matching event.
    w = Window.partitionBy("symbol", "us").orderBy(*sweep_keys())
    return stamped.select("symbol", "trade_id", F.row_number().over(w).alias("place"))
