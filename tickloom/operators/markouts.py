"""Markouts, their decomposition, trailing room, instrument screens, triggers, passive fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import BP, US, corr, day_of
from tickloom.functions.costs import TakerCosts
from tickloom.operators.asof import asof_join
from tickloom.operators.chunks import BOOK, Layout, chunked, own
from tickloom.operators.quantiles import quantile_by
from tickloom.operators.ranges import array_layout, stamped


def mids_of(book: DataFrame) -> DataFrame:
    return book.select(
        "symbol", "us", "seq", ((F.col("bid_price_0") + F.col("ask_price_0")) / 2).alias("mid")
    )


def markouts(
    fills: DataFrame, mids: DataFrame, horizons_s: Sequence[float], tie: str = "trade_id"
) -> DataFrame:
    """One row per fill and horizon: signed move of the mid from the fill price, bp."""
    spans = F.explode(F.array(*[F.lit(float(h)) for h in horizons_s])).alias("horizon_s")
    spread = fills.select("*", spans)
    later = asof_join(
        spread,
        mids,
        ["mid"],
        at=F.col("us") + (F.col("horizon_s") * US).cast("long"),
        left_tie=tie,
        names={"mid": "later_mid", "r_us": "later_us"},
    )
    value = F.col("side") * (F.col("later_mid") - F.col("price")) / F.col("price") * BP
    return later.withColumn("markout_bp", value)


def summarise_markouts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Volume-weighted markout, fills and volume; fills without a later mid carry no weight."""
    known = F.col("markout_bp").isNotNull()
    weight = F.when(known, F.col("size"))
    return rows.groupBy(*by, "horizon_s").agg(
        F.count_if(known).alias("fills"),
        F.sum(weight).alias("volume"),
        (F.sum(weight * F.col("markout_bp")) / F.sum(weight)).alias("markout_bp"),
    )


def market_wide(prints: DataFrame, mids: DataFrame, horizons_s: Sequence[float]) -> DataFrame:
    """Every print scored from its resting side."""
    resting = prints.withColumn("side", -F.col("aggressor"))
    return summarise_markouts(markouts(resting, mids, horizons_s), [])


def decompose(fills: DataFrame, mids: DataFrame, horizon_s: float, fee_bp: float) -> DataFrame:
    """Per symbol and day: spread, adverse, inventory, fees and net of a set of fills.

    What is left of the position is marked at the last mid of the day.
    """
    now = asof_join(
        fills, mids, ["mid"], left_tie="trade_id", names={"mid": "mid_ref", "r_us": "_a"}
    )
    later = asof_join(
        now,
        mids,
        ["mid"],
        at=F.col("us") + round(horizon_s * US),
        left_tie="trade_id",
        names={"mid": "mid_later", "r_us": "_b"},
        stored=True,
    ).withColumn("day", day_of("us"))
    marks = mids.groupBy("symbol", day_of("us").alias("day")).agg(
        F.max_by("mid", F.struct("us", "seq")).alias("mark")
    )
    side, price, size = F.col("side"), F.col("price"), F.col("size")
    sums = later.groupBy("symbol", "day").agg(
        F.sum(side * (F.col("mid_ref") - price) * size).alias("spread"),
        F.sum(side * (F.col("mid_later") - F.col("mid_ref")) * size).alias("adverse"),
        F.sum(-side * price * size).alias("_cash"),
        F.sum(side * size).alias("_position"),
        (F.sum(price * size) * fee_bp / BP).alias("fees"),
    ).join(marks, ["symbol", "day"])
    gross = F.col("_cash") + F.col("_position") * F.col("mark")
    return sums.select(
        "symbol",
        "day",
        "spread",
        "adverse",
        (gross - F.col("spread") - F.col("adverse")).alias("inventory"),
        "fees",
        (F.col("spread") + F.col("adverse") - F.col("fees")).alias("making"),
        (gross - F.col("fees")).alias("net"),
    )


def room(
    rows: DataFrame,
    prints_markouts: DataFrame,
    *,
    window_s: float,
    horizon_s: float,
    least: int,
    spine: DataFrame | None = None,
) -> DataFrame:
    """Per row: volume-weighted markout of the prints whose outcome is known inside the window.

    A print counts once its horizon has passed and until it is ``window_s`` old; missing before a
    window has passed since midnight or with fewer than ``least`` prints.
    """
    layout = Layout(order=("us", "_tag", "_tie"))
    shift = round(horizon_s * US)
    day = F.floor(F.col("us") / F.lit(86_400 * US)).cast("long")
    a = rows.select(
        "symbol", "us", day.alias("_day"), F.lit(1).alias("_tag"), F.col("seq").alias("_tie"), "seq",
        F.lit(None).cast("double").alias("w"), F.lit(None).cast("double").alias("wm"),
    )
    b = prints_markouts.filter(F.col("markout_bp").isNotNull()).select(
        "symbol",
        (F.col("us") + shift).alias("us"),
        day.alias("_day"),
        F.lit(0).alias("_tag"),
        F.col("trade_id").alias("_tie"),
        F.lit(None).cast("long").alias("seq"),
        F.col("size").alias("w"),
        (F.col("size") * F.col("markout_bp")).alias("wm"),
    )
    lay = array_layout(Layout(key=("symbol", "_day"), order=layout.order))
    cut = chunked(a.unionByName(b), lay, secs_back=window_s)
    # Known at us + horizon, gone at us + window: on shifted stamps a span of window - horizon.
    span = (shift + 1 - round(window_s * US), 0)
    stats = {"_n": ("count", "w", *span), "_w": ("sum", "w", *span), "_wm": ("sum", "wm", *span)}
    summed = stamped(cut, lay, ["symbol", "us", "seq", "_day", "_tag"], stats).filter("_tag = 1")
    since = F.col("us") - F.col("_day") * (86_400 * US)
    ok = (F.col("_n") >= least) & (F.col("_w") > 0) & (since >= round(window_s * US))
    return summed.select("symbol", "us", "seq", F.when(ok, F.col("_wm") / F.col("_w")).alias("room_bp"))


def hourly(prints_markouts: DataFrame) -> DataFrame:
    """Volume and volume-weighted markout per UTC hour (24 rows)."""
    hour = F.pmod(F.floor(F.col("us") / F.lit(3600 * US)), F.lit(24))
    known = prints_markouts.filter(F.col("markout_bp").isNotNull())
    return known.groupBy(hour.alias("hour")).agg(
        F.sum("size").alias("volume"),
        (F.sum(F.col("size") * F.col("markout_bp")) / F.sum("size")).alias("markout_bp"),
    )


def hour_mask(by_hour: DataFrame, maker_bp: float, margin_bp: float) -> DataFrame:
    """Hours whose markout less the fee reaches the margin."""
    return by_hour.filter(F.col("markout_bp") - maker_bp >= margin_bp).select("hour")


def open_share(
    tape: DataFrame, value: str, *, from_s: float = 600.0, to_s: float = 86_280.0
) -> DataFrame:
    """Share of quoting time per symbol that a step-function tape is above one half.

    Rows hold until the next row of the day; the quoting span is clipped to each step.
    """
    layout = Layout(key=("symbol", "day"), order=("us", "seq"))
    staged = tape.withColumn("day", day_of("us"))
    cut = chunked(staged, layout, rows_ahead=1)
    start = F.unix_date("day").cast("long") * (86_400 * US)
    low, high = start + round(from_s * US), start + round(to_s * US)
    until = F.coalesce(F.lead("us").over(layout.window()), high)
    span = F.greatest(
        F.least(until, high) - F.greatest(F.col("us"), low), F.lit(0).cast("long")
    )
    steps = own(cut.select("symbol", "day", value, "_chunk", "_own", span.alias("_span")))
    days = steps.groupBy("symbol", "day").agg(
        F.sum(F.when(F.col(value) > 0.5, F.col("_span")).otherwise(0)).alias("_open")
    )
    quoting = round((to_s - from_s) * US)
    return days.groupBy("symbol").agg(
        (F.sum("_open") / (F.count(F.lit(1)) * quoting)).alias("open_share")
    )


def day_statistics(book: DataFrame, prints: DataFrame, tick: float) -> DataFrame:
    """Per symbol and day: seconds-weighted spread and tick, two-tick share, prints."""
    layout = Layout(key=("symbol", "day"), order=("us", "seq"))
    staged = book.select(
        "symbol", "us", "seq", "bid_price_0", "ask_price_0", day_of("us").alias("day")
    )
    cut = chunked(staged, layout, rows_ahead=1)
    end = (F.unix_date("day").cast("long") + 1) * (86_400 * US)
    secs = (F.coalesce(F.lead("us").over(layout.window()), end) - F.col("us")) / US
    rows = own(cut.select("*", secs.alias("secs")))
    mid = (F.col("bid_price_0") + F.col("ask_price_0")) / 2
    spread = F.col("ask_price_0") - F.col("bid_price_0")
    by_day = rows.groupBy("symbol", "day").agg(
        F.sum("secs").alias("seconds"),
        F.sum(spread / mid * BP * F.col("secs")).alias("spread_bp_seconds"),
        F.sum(F.lit(tick) / mid * BP * F.col("secs")).alias("tick_bp_seconds"),
        F.sum(F.when(F.round(spread / tick, 6) >= 2, F.col("secs")).otherwise(0.0)).alias(
            "two_tick_seconds"
        ),
    )
    counts = prints.groupBy("symbol", day_of("us").alias("day")).agg(
        F.count(F.lit(1)).alias("prints")
    )
    return by_day.join(counts, ["symbol", "day"], "left")


def combine_days(days: DataFrame, prints: DataFrame) -> DataFrame:
    """Block statistics per symbol; the median print is the weighted one of the size counts."""
    sums = days.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("days"),
        (F.sum("tick_bp_seconds") / F.sum("seconds")).alias("tick_bp"),
        (F.sum("spread_bp_seconds") / F.sum("seconds")).alias("spread_bp_time_weighted"),
        (F.sum("two_tick_seconds") / F.sum("seconds")).alias("share_at_two_ticks"),
        F.avg("prints").alias("prints_per_day"),
    )
    from pyspark.sql import Window

    sizes = prints.groupBy("symbol", "size").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("symbol")
    cum = F.sum("_c").over(w.orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    middle = (
        sizes.select("symbol", "size", cum.alias("_cum"), F.sum("_c").over(w).alias("_n"))
        .filter(F.col("_cum") >= F.col("_n") / 2)
        .groupBy("symbol")
        .agg(F.min("size").alias("median_print"))
    )
    return sums.join(middle, "symbol")


def admitted(
    table: DataFrame, spread_bp: float, two_ticks: float, prints_per_day: float
) -> DataFrame:
    """The admission rule's verdict per instrument."""
    ok = (
        (F.col("spread_bp_time_weighted") >= spread_bp)
        & (F.col("share_at_two_ticks") >= two_ticks)
        & (F.col("prints_per_day") >= prints_per_day)
    )
    return table.withColumn("admitted", ok)


def headroom_screen(
    book: DataFrame, horizon_rows: int, costs: TakerCosts, *, spine: DataFrame | None = None
) -> DataFrame:
    """Per instrument: spread, volatility, share clearing cost, coefficient, edge over cost; ranked."""
    from tickloom.functions.book import build_features
    from tickloom.functions.labels import forward_return

    static = build_features(book, ["spread_bp", "queue_imbalance"])
    moves = forward_return(book, horizon_rows, spine=spine)
    rows = static.join(moves, ["symbol", "us", "seq"])
    typical = quantile_by(static, ["symbol"], "spread_bp", 0.5, "median_spread_bp")
    priced = typical.withColumn("round_trip_bp", costs.round_trip("median_spread_bp"))
    clears = (F.abs("forward_bp") > F.col("round_trip_bp")).cast("double")
    facts = rows.join(priced, "symbol").groupBy("symbol", "median_spread_bp", "round_trip_bp").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(day_of("us")).alias("days"),
        F.stddev_pop("forward_bp").alias("volatility_bp"),
        F.avg(clears).alias("headroom"),
        corr("queue_imbalance", "forward_bp").alias("information_coefficient"),
    )
    edge = F.abs("information_coefficient") * F.col("volatility_bp") / F.col("round_trip_bp")
    return facts.withColumn("edge_over_cost", edge).orderBy(
        F.desc_nulls_last("edge_over_cost"), "symbol"
    )


def slope_through_zero(rows: DataFrame, threshold: DataFrame) -> DataFrame:
    """Per symbol: ``sum(xy) / sum(xx)`` of the next return on the signal beyond the threshold."""
    joined = rows.join(threshold, "symbol")
    strong = joined.filter(
        (F.abs("signal_bp") >= F.col("threshold")) & F.col("forward_bp").isNotNull()
    )
    x, y = F.col("signal_bp"), F.col("forward_bp")
    return strong.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), (F.sum(x * y) / F.sum(x * x)).alias("beta")
    )


def passive_fills(
    book: DataFrame,
    flow: DataFrame,
    side: str,
    *,
    timeout: int,
    hold: int,
    spine: DataFrame | None = None,
) -> DataFrame:
    """Candidates resting at the touch: when the queue ahead is consumed, within ``timeout`` rows.

    ``flow`` adds ``sell_volume`` and ``buy_volume`` per row. The order fills on the first row on
    which the opposing volume traded at its price has reached the queue, or the touch has moved
    through it. Unfilled attempts end at the timeout, filled ones ``hold`` rows after the fill.
    """
    rows = book.join(flow, ["symbol", "us", "seq"]).select(
        "symbol",
        "us",
        "seq",
        "row",
        side,
        "bid_price_0",
        "ask_price_0",
        "bid_size_0",
        "ask_size_0",
        "sell_volume",
        "buy_volume",
    )
    cut = chunked(rows, BOOK, rows_ahead=timeout + hold + 1, spine=spine)
    w = BOOK.window()
    ahead = w.rowsBetween(1, timeout)
    path = F.collect_list(
        F.struct("row", "bid_price_0", "ask_price_0", "sell_volume", "buy_volume")
    ).over(ahead)
    buy = F.col(side) > 0
    staged = cut.select(
        "*", F.when(F.col(side) != 0, path).alias("_path")
    ).filter((F.col(side) != 0) & F.col("_own"))
    price = F.when(buy, F.col("bid_price_0")).otherwise(F.col("ask_price_0"))
    queue = F.when(buy, F.col("bid_size_0")).otherwise(F.col("ask_size_0"))

    def step(state: Column, x: Column) -> Column:
        touch = F.when(F.col("_buy"), x["bid_price_0"]).otherwise(x["ask_price_0"])
        volume = F.when(F.col("_buy"), x["sell_volume"]).otherwise(x["buy_volume"])
        at_price = touch == F.col("_price")
        through = F.when(F.col("_buy"), touch < F.col("_price")).otherwise(touch > F.col("_price"))
        left = F.when(at_price, state["left"] - volume).otherwise(state["left"])
        hit = through | (at_price & (left <= 0))
        return F.when(state["at"].isNotNull(), state).otherwise(
            F.struct(left.alias("left"), F.when(hit, x["row"]).alias("at"))
        )

    named = staged.select(
        "symbol",
        "us",
        "seq",
        "row",
        F.col(side).alias("direction"),
        buy.alias("_buy"),
        price.alias("_price"),
        queue.cast("double").alias("queue_ahead"),
        "_path",
    )
    start = F.struct(
        F.col("queue_ahead").alias("left"), F.lit(None).cast("long").alias("at")
    )
    return named.select(
        "symbol",
        "us",
        "seq",
        "row",
        "direction",
        F.col("_price").alias("price"),
        "queue_ahead",
        F.aggregate("_path", start, step)["at"].alias("fill_row"),
    )

