"""Gates and filters whose levels are fitted on one period and applied to another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import BP, US, ln, ratio
from tickloom.operators.asof import asof_join
from tickloom.operators.chunks import BOOK, Layout, chunked
from tickloom.operators.quantiles import quantile_by
from tickloom.operators.ranges import array_layout, stamped


def gate_inputs(
    book: DataFrame,
    window_s: float,
    *,
    layout: Layout = BOOK,
    spine: DataFrame | None = None,
) -> DataFrame:
    """Quoted spread and realised volatility over the trailing window, both in bp.

    Volatility is the root of the summed squared log changes ending inside ``(t - window, t]``.
    """
    mid = (F.col("bid_price_0") + F.col("ask_price_0")) / 2
    rows = book.select("symbol", "us", "seq", "bid_price_0", "ask_price_0", mid.alias("mid"))
    layout = array_layout(layout)
    # The change ending at a row needs the row before it, so look one row further back too.
    cut = chunked(rows, layout, rows_back=1, secs_back=window_s, spine=spine)
    change = ln(ratio("mid", F.lag("mid").over(layout.window())))
    staged = cut.withColumn("_sq", change * change)
    keep = ["symbol", "us", "seq", "bid_price_0", "ask_price_0", "mid", "_sq"]
    summed = stamped(staged, layout, keep, {"_total": ("sum", "_sq", 1 - round(window_s * US), 0)})
    first = F.col("_sq").isNull()
    spread = (F.col("ask_price_0") - F.col("bid_price_0")) / F.col("mid") * BP
    return summed.select(
        "symbol",
        "us",
        "seq",
        F.when(~first, F.sqrt(F.coalesce("_total", F.lit(0.0))) * BP).alias("volatility_bp"),
        spread.alias("spread_bp"),
    )


def gate_levels(
    training: DataFrame, low_volatility: float | None = 0.3, high_spread: float | None = 0.7
) -> DataFrame:
    """One row: the volatility floor and the spread cap, exact quantiles of the training rows."""
    floor = quantile_by(
        training, [], "volatility_bp", 0.0 if low_volatility is None else low_volatility, "floor"
    )
    cap = quantile_by(
        training, [], "spread_bp", 1.0 if high_spread is None else high_spread, "cap"
    )
    return floor.join(F.broadcast(cap))  # one row each


def gated(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """Which rows each gate lets through; a missing input is not let through."""
    joined = rows.join(F.broadcast(levels))  # one row
    return joined.select(
        *rows.columns,
        F.coalesce(F.col("volatility_bp") >= F.col("floor"), F.lit(False)).alias("quiet_out"),
        F.coalesce(F.col("spread_bp") <= F.col("cap"), F.lit(False)).alias("tight_only"),
    )


def entry_allowed(us: Column, after: str = "00:01", before: str = "23:58") -> Column:
    """Inside the day's entry window (UTC clock, both ends included)."""

    def clock(text: str) -> int:
        hours, minutes = text.split(":")
        return (int(hours) * 3600 + int(minutes) * 60) * US

    of_day = F.pmod(us, F.lit(86_400 * US))
    return (of_day >= clock(after)) & (of_day <= clock(before))


def flatten_us(us: Column, at: str = "23:59") -> Column:
    """When the stamp's own day is flattened."""
    hours, minutes = at.split(":")
    return us - F.pmod(us, F.lit(86_400 * US)) + (int(hours) * 3600 + int(minutes) * 60) * US


def reprice(attempts: DataFrame, tiers: DataFrame, base: str, mode: str) -> DataFrame:
    """Mean net per attempt at every tier, decisions unchanged. ``tiers`` is the fee table."""
    start = tiers.filter(F.col("tier") == base).select(
        F.col("maker_bp").alias("_m0"), F.col("taker_bp").alias("_t0")
    )
    moved = tiers.join(F.broadcast(start)).select(  # one row
        "tier",
        (F.col("maker_bp") - F.col("_m0")).alias("_dm"),
        (F.col("taker_bp") - F.col("_t0")).alias("_dt"),
    )
    # Net is linear in the fees, so one aggregate row serves every tier.
    filled = F.col("filled") if "filled" in attempts.columns else F.lit(True)
    crossed = F.col("crossed") if "crossed" in attempts.columns else F.lit(True)
    facts = attempts.agg(
        F.avg("net_bp").alias("_net"),
        F.avg(filled.cast("double")).alias("_filled"),
        F.avg((filled & crossed).cast("double")).alias("_crossed"),
    )
    joined = moved.join(F.broadcast(facts))  # one row
    if mode == "taker":
        net = F.col("_net") - 2 * F.col("_dt")
    else:
        posted = F.col("_filled") - F.col("_crossed")
        net = (
            F.col("_net")
            - F.col("_filled") * F.col("_dm")
            - F.col("_crossed") * F.col("_dt")
            - posted * F.col("_dm")
        )
    return joined.select("tier", net.alias("net_bp"))


def sample_configurations(space: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` distinct configurations of a product of axes, in a seeded hash order.

    The same seed gives the same draw; a space of ``n`` or fewer is returned whole.
    """
    mark = F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in space.columns])
    return space.distinct().orderBy(mark, *space.columns).limit(n)


def near_book(
    prints: DataFrame, book: DataFrame, depth: int, limit_bp: float
) -> DataFrame:
    """Prints within ``limit_bp`` of the visible range of the last snapshot at or before them.

    A print before the first snapshot is kept.
    """
    edges = book.select(
        "symbol",
        "us",
        "seq",
        F.col(f"bid_price_{depth - 1}").alias("low"),
        F.col(f"ask_price_{depth - 1}").alias("high"),
    )
    seen = asof_join(prints, edges, ["low", "high"], left_tie="trade_id")
    outside = F.greatest(F.col("low") - F.col("price"), F.col("price") - F.col("high"))
    keep = F.col("r_us").isNull() | (outside / F.col("price") * BP <= limit_bp)
    return seen.filter(keep).select(*prints.columns)
