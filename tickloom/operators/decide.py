"""From scores to sides: thresholds, gates, events, cross-sectional baskets, sizing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import BP, clip, corr, ratio
from tickloom.functions.costs import TakerCosts
from tickloom.functions.panel import average_rank, index_level
from tickloom.operators.chunks import BARS, BOOK, Layout, chunked, own, running
from tickloom.operators.quantiles import at_ranks, counted, quantile_by
from tickloom.session import materialised

KEYS = ("symbol", "us", "seq")


def decide(p_sell: Column, p_buy: Column, least: float | Column) -> Column:
    """+1 / -1 where a side clears the bar and beats the other, else 0."""
    bar = least if isinstance(least, Column) else F.lit(least)
    return (
        F.when((p_buy >= bar) & (p_buy > p_sell), 1)
        .when((p_sell >= bar) & (p_sell > p_buy), -1)
        .otherwise(0)
    )


def evaluate(
    rows: DataFrame, costs: TakerCosts, by: Sequence[str] = (), decision: str = "decision"
) -> DataFrame:
    """Score decisions row by row, overlapping allowed; unknown moves or spreads do not count."""
    usable = F.col("forward_bp").isNotNull() & F.col("spread_bp").isNotNull()
    traded = usable & (F.col(decision) != 0)
    gross = F.when(traded, F.col(decision) * F.col("forward_bp"))
    cost = F.when(traded, costs.round_trip("spread_bp"))
    out = rows.groupBy(*by).agg(
        F.count_if(usable).alias("rows"),
        F.count_if(traded).alias("trades"),
        F.coalesce(F.sum(gross), F.lit(0.0)).alias("gross_bp"),
        F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost_bp"),
        F.avg(F.when(gross.isNotNull(), (gross > 0).cast("double"))).alias("hit_rate"),
    )
    net = F.col("gross_bp") - F.col("cost_bp")
    return out.select(
        "*",
        F.coalesce(ratio("trades", F.greatest("rows", F.lit(1))), F.lit(0.0)).alias("trade_rate"),
        net.alias("net_bp"),
        F.coalesce(ratio(net, F.col("trades")), F.lit(0.0)).alias("net_per_trade_bp"),
    )


def confidence_curve(
    rows: DataFrame, grid: Sequence[float], costs: TakerCosts
) -> DataFrame:
    """Every threshold of a short fixed grid scored in one pass."""
    bars = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("min_confidence")
    spread = rows.select("*", bars)
    decided = spread.withColumn(
        "decision", decide(F.col("p_sell"), F.col("p_buy"), F.col("min_confidence"))
    )
    return evaluate(decided, costs, by=["min_confidence"])


def choose_confidence(
    curve: DataFrame, least_trades: int = 50, objective: str = "net_bp"
) -> DataFrame:
    """One row: the best threshold with enough trades (the lowest on ties), else above the grid."""
    enough = F.col("trades") >= least_trades
    best = F.max_by(
        F.col("min_confidence"),
        F.when(enough, F.struct(F.col(objective), -F.col("min_confidence"))),
    )
    return curve.agg(F.coalesce(best, F.max("min_confidence") + 1.0).alias("min_confidence"))


def kth_largest(
    rows: DataFrame, value: Column, keep: Column, k: int, name: str, by: Sequence[str] = ()
) -> DataFrame:
    """The ``k``-th largest value among kept rows (the smallest when there are fewer)."""
    by = list(by)
    key = by or ["_all"]
    values = rows.filter(keep & value.isNotNull())
    values = values.select(*(by or [F.lit(1).alias("_all")]), value.cast("double").alias("_v"))
    rank = F.greatest(F.col("_n") - k, F.lit(0)).cast("long")
    found = counted(values, key).select(*key, "_v", "_c", rank.alias("_low"), rank.alias("_high"))
    return at_ranks(materialised(found), key).select(*by, F.col("_x").alias(name))


def side_budget(days: float, trades_per_day: float) -> int:
    """Whole entries that one of the two sides has over ``days``; never none."""
    share = 0.5 * days * trades_per_day
    return round(share) if share >= 1.5 else 1


def hold_first_thresholds(rows: DataFrame, days: float, trades_per_day: float) -> DataFrame:
    """One row: thresholds that give each side half the trade rate."""
    entries = side_budget(days, trades_per_day)
    up, down = F.col("p_buy"), F.col("p_sell")
    long_ = kth_largest(rows, up, up > down, entries, "theta_long")
    short = kth_largest(rows, down, down > up, entries, "theta_short")
    return long_.join(F.broadcast(short))  # one row each


def hold_first(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Sides under per-side thresholds."""
    joined = rows.join(F.broadcast(thresholds))  # one row
    up, down = F.col("p_buy"), F.col("p_sell")
    side = (
        F.when((down >= F.col("theta_short")) & (down > up), -1)
        .when((up >= F.col("theta_long")) & (up > down), 1)
        .otherwise(0)
    )
    return joined.select(*rows.columns, side.alias("decision"))


def ev_sides(mu: Column, sigma: Column, walk_cost: Column, cost: float, k: float, beta: float) -> Column:
    """Open where the bound on the expected move clears fees, walk and margin."""
    hurdle = F.lit(cost + beta) + walk_cost
    return F.coalesce(
        F.when(-mu - sigma * k > hurdle, -1).when(mu - sigma * k > hurdle, 1).otherwise(0), F.lit(0)
    )


def event_ids(rows: DataFrame, side: str, layout: Layout = BOOK) -> DataFrame:
    """An id per run of open rows (from 0), -1 where closed."""
    cut = chunked(rows, layout, rows_back=1)
    is_open = F.col(side) != 0
    was = F.coalesce(F.lag(F.col(side) != 0).over(layout.window()), F.lit(False))
    starts = own(
        cut.select(*rows.columns, "_chunk", "_own", (is_open & ~was).cast("long").alias("_start"))
    )
    counted = running(starts, {"_id": F.col("_start")}, layout)
    event = F.when(F.col(side) != 0, F.col("_id") - 1).otherwise(F.lit(-1))
    return counted.select(*rows.columns, event.alias("event"))


def probability_gate(
    p_down: Column,
    p_flat: Column,
    p_up: Column,
    rv_bp: Column,
    spread_bp: Column,
    *,
    fee_bp: float,
    slippage_bp: float,
    t_min: float,
    buffer_bp: float,
    tau_move: float,
    min_margin: float,
) -> Column:
    """0 down, 1 hold, 2 up from normalised probabilities against cost and tradability."""

    def bounded(p: Column) -> Column:
        return F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0))

    total = bounded(p_down) + bounded(p_flat) + bounded(p_up)
    edge = (bounded(p_up) - bounded(p_down)) / total
    cost = spread_bp + (2 * fee_bp + slippage_bp)
    up, down = edge * rv_bp - cost, -edge * rv_bp - cost
    hold = (
        (F.greatest(up, down) <= buffer_bp)
        | (F.lit(1.0) - bounded(p_flat) / total < tau_move)
        | (F.abs(edge) < min_margin)
        | (rv_bp / F.greatest(spread_bp, F.lit(1e-9)) < t_min)
    )
    return F.when(hold, 1).when(up > down, 2).otherwise(0)


def strategy_inputs(
    rows: DataFrame, rv: str, mid_mean: str, spread: str, layout: Layout = BOOK
) -> DataFrame:
    """Volatility and spread in bp; a missing spread takes the last known one, else the next."""
    from tickloom.operators.chunks import last_known

    ref = F.when(F.col(mid_mean) != 0, F.col(mid_mean))
    raw = F.col(spread) * BP / (ref + 1e-12)
    seen = last_known(rows.withColumn("_raw", raw), {"_back": F.col("_raw")}, layout)
    seen = last_known(seen, {"_next": F.col("_raw")}, layout, forward=True)
    filled = F.coalesce("_back", "_next", F.lit(0.0))
    rv_bp = F.round(F.greatest(F.coalesce(F.col(rv) * BP, F.lit(0.0)), F.lit(0.0)), 6)
    return seen.select(
        *rows.columns,
        rv_bp.alias("rv_bp"),
        F.round(F.greatest(filled, F.lit(0.0)), 3).alias("spread_input_bp"),
    )


# ------------------------------------------------------------------------- reversion


def index_signal(prices: DataFrame, lookback: int, layout: Layout = BARS) -> DataFrame:
    """Return of the index of the other instruments over the last ``lookback`` rows, bp."""
    level = index_level(prices)
    cut = chunked(level, layout, rows_back=lookback, spine=prices)
    w = layout.window()
    x = F.col("index_without")
    return own(
        cut.select(
            "symbol",
            "us",
            "log_price",
            "_chunk",
            "_own",
            ((x - F.lag(x, lookback).over(w)) * BP).alias("signal_bp"),
        )
    )


def rate_threshold(
    signals: DataFrame, trades_per_day: float, rows_per_day: float, by: Sequence[str] = ("symbol",)
) -> DataFrame:
    """The signal size that gives the wanted number of trades a day, per key: an exact quantile."""
    by = list(by)
    known = signals.filter(F.col("signal_bp").isNotNull())
    sizes = counted(known.select(*by, F.abs("signal_bp").alias("_v")), by)
    rows = signals.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    wanted = F.greatest(F.lit(1), F.floor(F.lit(trades_per_day) * F.col("_rows") / F.lit(rows_per_day)))
    share = F.least(F.lit(0.999), wanted / F.col("_n"))
    at = (F.col("_n") - 1) * (F.lit(1.0) - share)
    low = F.floor(at)
    stored = materialised(
        sizes.join(rows, by).select(
            *by, "_v", "_c", low.alias("_low"), F.least(low + 1, F.col("_n") - 1).alias("_high"), (at - low).alias("_f")
        )
    )
    ends = at_ranks(stored.drop("_f"), by).join(stored.groupBy(*by).agg(F.first("_f").alias("_f")), by)
    return ends.select(*by, (F.col("_x") + (F.col("_y") - F.col("_x")) * F.col("_f")).alias("threshold"))


def against_move(value: Column, threshold: Column) -> Column:
    """Side against a move of at least the threshold."""
    return F.when(F.abs(value) >= threshold, -F.signum(value)).otherwise(F.lit(0.0)).cast("int")


# --------------------------------------------------------------------- cross-section


def relative_returns(
    prices: DataFrame, lookback: int, *, demean: bool = True, layout: Layout = BARS
) -> DataFrame:
    """Recent return per instrument, less the cross-section's mean at the same stamp."""
    cut = chunked(prices, layout, rows_back=lookback)
    x = F.col("log_price")
    moved = own(
        cut.select(
            *prices.columns,
            "_chunk",
            "_own",
            ((x - F.lag(x, lookback).over(layout.window())) * BP).alias("deviation"),
        )
    )
    if not demean:
        return moved
    at = Window.partitionBy("us")
    return moved.withColumn("deviation", F.col("deviation") - F.avg("deviation").over(at))


def basket_weights(rows: DataFrame, basket: int) -> DataFrame:
    """Long the most depressed, short the most extended; half the exposure a side.

    Ties go to the name that sorts first.
    """
    at = Window.partitionBy("us")
    known = F.col("deviation").isNotNull()
    n = F.count("deviation").over(at)
    rank = F.row_number().over(at.orderBy(F.col("deviation").asc_nulls_last(), "symbol"))
    enough = known & (n >= 2 * basket)
    weight = (
        F.when(enough & (rank > n - basket), F.lit(-0.5 / basket))
        .when(enough & (rank <= basket), F.lit(0.5 / basket))
        .otherwise(F.lit(0.0))
    )
    return rows.withColumn("weight", weight)


def basket_backtest(
    prices: DataFrame,
    *,
    lookback: int,
    hold: int,
    basket: int,
    cost_bp: float,
    stride: int | None = None,
    layout: Layout = BARS,
) -> DataFrame:
    """Form the basket every ``stride`` stamps, hold it, and charge every name."""
    step = stride or hold
    stamps = prices.select("us").distinct().select(F.lit("clock").alias("symbol"), "us")
    from tickloom.operators.chunks import numbered

    clock = numbered(stamps, layout, "_at").select("us", (F.col("_at") - 1).alias("start_row"))
    total = stamps.agg(F.count(F.lit(1)).alias("_n"))
    moved = relative_returns(prices, lookback, layout=layout)
    ahead = chunked(moved, layout, rows_ahead=hold, spine=prices)
    x = F.col("log_price")
    forward = own(
        ahead.select(
            "symbol",
            "us",
            "deviation",
            "_chunk",
            "_own",
            ((F.lead(x, hold).over(layout.window()) - x) * BP).alias("forward"),
        )
    )
    held = basket_weights(forward, basket).join(clock, "us").join(F.broadcast(total))  # one row
    picked = held.filter(
        (F.col("start_row") >= lookback)
        & (F.col("start_row") < F.col("_n") - hold)
        & ((F.col("start_row") - lookback) % step == 0)
        & (F.col("weight") != 0)
        & F.col("forward").isNotNull()
    )
    return picked.groupBy("start_row").agg(
        F.count(F.lit(1)).alias("names"),
        F.sum(F.col("weight") * F.col("forward")).alias("gross_bp"),
        (F.sum(F.abs("weight")) * cost_bp).alias("cost_bp"),
        (F.sum(F.col("weight") * F.col("forward")) - F.sum(F.abs("weight")) * cost_bp).alias("net_bp"),
    )


def leg_decisions(rows: DataFrame, legs: int = 3, score: str = "score") -> DataFrame:
    """Per stamp: rank correlation, and mean gross, cost and net of the top and bottom legs.

    ``rows`` hold ``score``, ``target``, ``fwd`` and ``cost``; ties go to the name that sorts first.
    """
    known = rows.filter(F.col(score).isNotNull())
    at = Window.partitionBy("us")
    low = F.row_number().over(at.orderBy(F.col(score), F.col("symbol")))
    n = F.count(F.lit(1)).over(at)
    placed = known.select(
        "us",
        "symbol",
        "fwd",
        "cost",
        low.alias("_low"),
        n.alias("_n"),
        average_rank(score, ["us"]).alias("_rs"),
        F.when(F.col("target").isNotNull(), average_rank("target", ["us"])).alias("_rt"),
    )
    side = F.when(F.col("_low") > F.col("_n") - legs, 1).when(F.col("_low") <= legs, -1)
    gross = side * F.col("fwd")
    return placed.groupBy("us").agg(
        corr("_rs", "_rt").alias("ic"),
        F.avg(gross).alias("gross"),
        F.avg(F.when(side.isNotNull(), F.col("cost"))).alias("cost"),
        F.avg(gross - F.when(side.isNotNull(), F.col("cost"))).alias("net"),
    )


# ------------------------------------------------------------- rule scores, members, size

RULES: Mapping[str, str] = {
    "momentum": "log_mid_ret20",
    "mean_reversion": "log_mid_ret20",
    "order_flow": "queue_imbalance",
    "breakout": "log_mid_ret50",
    "spread_capture": "queue_imbalance",
}


def rule_signals(rows: DataFrame) -> DataFrame:
    """The raw signal of each rule on one frame; the tight-spread level is the frame's own."""
    tight = quantile_by(rows, [], "spread_bp", 0.3, "_tight")
    joined = rows.join(F.broadcast(tight))  # one row
    move = F.when(
        F.col("log_mid_vol50") > 0, F.col("log_mid_ret50") / F.col("log_mid_vol50")
    ).otherwise(F.lit(0.0))
    return joined.select(
        *KEYS,
        F.col("log_mid_ret20").alias("momentum"),
        (-F.col("log_mid_ret20")).alias("mean_reversion"),
        F.col("queue_imbalance").alias("order_flow"),
        move.alias("breakout"),
        F.when(F.col("spread_bp") <= F.col("_tight"), F.col("queue_imbalance"))
        .otherwise(F.lit(0.0))
        .alias("spread_capture"),
    )


def rule_scales(signals: DataFrame) -> DataFrame:
    """One row: twice each signal's population deviation; a flat signal scales by 1."""
    moments = signals.agg(*[(F.stddev_pop(r) * 2).alias(r) for r in RULES])
    return moments.select(*[F.when(F.col(r) > 0, F.col(r)).otherwise(1.0).alias(r) for r in RULES])


def rule_scores(signals: DataFrame, scales: DataFrame, deadzones: Mapping[str, float] | None = None) -> DataFrame:
    """Signals in units of their training scale; below its deadzone a score is 0."""
    dead = {"breakout": 1.0} if deadzones is None else deadzones
    named = scales.select(*[F.col(r).alias(f"_{r}") for r in RULES])
    joined = signals.join(F.broadcast(named))  # one row

    def score(rule: str) -> Column:
        x = F.col(rule) / F.col(f"_{rule}")
        bar = dead.get(rule, 0.0)
        return (F.when(F.abs(x) >= bar, x).otherwise(F.lit(0.0)) if bar > 0 else x).alias(rule)

    return joined.select(*KEYS, *[score(r) for r in RULES])


def direction_and_confidence(p_sell: Column, p_buy: Column) -> tuple[Column, Column]:
    return F.when(p_buy >= p_sell, 1).otherwise(-1), F.greatest(p_buy, p_sell)


def agreement(members: Sequence[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Direction and confidence where every (p_sell, p_buy) member points the same way.

    The weakest member's confidence counts; on disagreement it is 0.
    """
    votes = [direction_and_confidence(s, b) for s, b in members]
    same = F.lit(True)
    for d, _ in votes[1:]:
        same = same & (d == votes[0][0])
    weakest = F.least(*[c for _, c in votes])
    return votes[0][0], F.when(same, weakest).otherwise(F.lit(0.0))


def endorsed(
    points: tuple[Column, Column], gate: tuple[Column, Column]
) -> tuple[Column, Column]:
    """One member's side with another's confidence, 0 where the other points elsewhere."""
    side, _ = direction_and_confidence(*points)
    other, confidence = direction_and_confidence(*gate)
    return side, F.when(other == side, confidence).otherwise(F.lit(0.0))


def averaged(members: Sequence[Sequence[Column]], weights: Sequence[float] | None = None) -> list[Column]:
    """Weighted mean of members' class probabilities, scaled to sum to one."""
    given = weights or [1.0] * len(members)
    share = [w / sum(given) for w in given]
    classes = []
    for k in range(len(members[0])):
        total = F.lit(0.0)
        for m, s in zip(members, share, strict=True):
            total = total + m[k] * s
        classes.append(total)
    whole = classes[0]
    for c in classes[1:]:
        whole = whole + c
    return [F.coalesce(ratio(c, whole), F.lit(0.0)) for c in classes]


def bound_side(mu: Column, sigma: Column, cost_bp: float, k: float) -> Column:
    """Side whose bound clears the cost."""
    return F.when(mu - sigma * k > cost_bp, 1).when(mu + sigma * k < -cost_bp, -1).otherwise(0)


def surplus_confidence(surplus_bp: Column, acts: Column, cost_bp: float) -> Column:
    """A third plus what the surplus adds, at most 0.9."""
    third = 1.0 / 3.0
    return F.when(acts, F.lit(third) + F.tanh(surplus_bp / cost_bp) * (0.9 - third)).otherwise(
        F.lit(third)
    )


def expected_value_side(edge_bp: Column, hurdle_bp: float) -> Column:
    return F.when(F.abs(edge_bp) > hurdle_bp, F.signum(edge_bp).cast("int")).otherwise(0)


def volatility_scale(vol_bp: Column, target: float = 10.0, cap: float = 3.0, floor: float = 1.0) -> Column:
    return clip(F.lit(target) / F.greatest(vol_bp, F.lit(floor)), 0.0, cap)


def confidence_scale(p: Column, floor: float = 0.34, ceiling: float = 0.60, cap: float = 1.0) -> Column:
    return clip((p - floor) / (ceiling - floor), 0.0, 1.0) * cap


def kelly_scale(edge_bp: Column, vol_bp: Column, fraction: float = 0.25, cap: float = 2.0) -> Column:
    """Edge over variance, scaled down; a negative edge gives no position."""
    sd = F.greatest(vol_bp, F.lit(1e-9))
    return clip(edge_bp * fraction / (sd * sd), 0.0, cap)
