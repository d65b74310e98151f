"""Grids, resampling and bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import US, day_of


def bin_of(us: Column | str, seconds: float) -> Column:
    """Index of the grid bin holding a stamp."""
    c = F.col(us) if isinstance(us, str) else us
    return F.floor(c / F.lit(round(seconds * US))).cast("long")


def bars_from_prints(prints: DataFrame, seconds: float) -> DataFrame:
    """Open, high, low, close and volume per interval, stamped at the close."""
    width = round(seconds * US)
    stamp = F.struct("us", "trade_id")
    return (
        prints.groupBy("symbol", bin_of("us", seconds).alias("hour"))
        .agg(
            F.min_by("price", stamp).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", stamp).alias("close"),
            F.sum("size").alias("volume"),
        )
        .select(
            "symbol",
            "hour",
            (F.col("hour") * width).alias("open_us"),
            ((F.col("hour") + 1) * width).alias("us"),
            "open",
            "high",
            "low",
            "close",
            "volume",
        )
    )


def last_per_bin(
    df: DataFrame,
    seconds: float,
    values: Sequence[str],
    key: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("us", "seq"),
) -> DataFrame:
    """The last row of each occupied bin, whole; empty bins give nothing."""
    picked = (
        df.groupBy(*key, bin_of("us", seconds).alias("bin"))
        .agg(F.max_by(F.struct(*order, *values), F.struct(*order)).alias("r"))
    )
    return picked.select(*key, "bin", *[F.col(f"r.{c}").alias(c) for c in (*order, *values)])


def first_per_bin(
    df: DataFrame,
    seconds: float,
    values: Sequence[str],
    key: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("us", "seq"),
) -> DataFrame:
    """The first row of each occupied bin."""
    picked = (
        df.groupBy(*key, bin_of("us", seconds).alias("bin"))
        .agg(F.min_by(F.struct(*order, *values), F.struct(*order)).alias("r"))
    )
    return picked.select(*key, "bin", *[F.col(f"r.{c}").alias(c) for c in (*order, *values)])


def filled_grid(
    df: DataFrame,
    seconds: float,
    values: Sequence[str],
    *,
    key: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("us", "seq"),
    label: str = "left",
    by_day: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """Every bin from a day's first to its last, each column carried forward inside the day.

    A bin's value per column is the last one that is not missing. ``label="right"`` stamps a
    bin at its end. ``limit`` bounds how many empty bins a value may be carried over.
    """
    width = round(seconds * US)
    scope = [*key, "day"] if by_day else list(key)
    staged = df.withColumn("day", day_of("us")) if by_day else df
    stamp = F.struct(*order)
    bins = staged.groupBy(*scope, bin_of("us", seconds).alias("bin")).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), stamp)).alias(c) for c in values]
    )
    full = (
        bins.groupBy(*scope)
        .agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
        .select(*scope, F.explode(F.sequence("lo", "hi")).alias("bin"))
    )
    w = Window.partitionBy(*scope).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    joined = full.join(bins, [*scope, "bin"], "left")

    def filled(c: str) -> Column:
        carried = F.last(c, ignorenulls=True).over(w)
        if limit is None:
            return carried
        seen = F.last(F.when(F.col(c).isNotNull(), F.col("bin")), ignorenulls=True).over(w)
        return F.when(F.col("bin") - seen <= limit, carried)

    at = (F.col("bin") + (1 if label == "right" else 0)) * width
    return joined.select(*scope, "bin", at.alias("us"), *[filled(c).alias(c) for c in values])


def boundary_grid(
    df: DataFrame,
    seconds: float,
    values: Sequence[str],
    *,
    key: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("us", "seq"),
) -> DataFrame:
    """Fixed boundaries of each day, each with the last row at or before it in that day.

    Boundaries before the day's first row are dropped; the last boundary is the day's end.
    """
    width = round(seconds * US)
    per_day = 86_400 * US // width
    staged = df.withColumn("day", day_of("us"))
    # A row stamped exactly on a boundary belongs to it: boundaries close on the right.
    slot = F.ceil(F.pmod(F.col("us"), F.lit(86_400 * US)) / F.lit(width)).cast("long")
    slot = F.greatest(slot, F.lit(1))
    last = staged.groupBy(*key, "day", slot.alias("slot")).agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("r")
    )
    grid = (
        last.groupBy(*key, "day")
        .agg(F.min("slot").alias("lo"))
        .select(*key, "day", F.explode(F.sequence("lo", F.lit(per_day))).alias("slot"))
    )
    w = Window.partitionBy(*key, "day").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(last, [*key, "day", "slot"], "left").withColumn(
        "r", F.last("r", ignorenulls=True).over(w)
    )
    start = F.unix_date("day").cast("long") * (86_400 * US)
    return filled.select(
        *key,
        "day",
        (start + F.col("slot") * width).alias("us"),
        *[F.col(f"r.{v}").alias(v) for v in values],
    )


def boundary_sums(prints: DataFrame, seconds: float, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Prints summed per boundary; a print exactly on a boundary belongs to it."""
    width = F.lit(round(seconds * US))
    slot = (F.ceil(F.col("us") / width) * width).cast("long")
    sold = F.col("aggressor") < 0
    return prints.groupBy(*key, slot.alias("boundary")).agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.sum("size").alias("total_trade_volume"),
        F.count_if(sold).alias("sell_count"),
        F.sum(-F.col("aggressor") * F.col("size")).alias("signed_volume"),
    )


def minute_bars(book: DataFrame, seconds: float = 60, carry: int = 5) -> DataFrame:
    """Right-closed, right-labelled bars of the touch, carried over at most ``carry`` bars.

    Crossed or non-positive touches give missing measures.
    """
    width = round(seconds * US)
    # Right-closed bins: shift by one microsecond so a stamp on the edge stays left of it.
    shifted = book.withColumn("us", F.col("us") - 1)
    values = ["bid_price_0", "ask_price_0", "bid_size_0", "ask_size_0"]
    grid = filled_grid(shifted, seconds, values, limit=carry)
    bid, ask = F.col("bid_price_0"), F.col("ask_price_0")
    ok = (bid > 0) & (ask >= bid)
    mid = F.when(ok, (bid + ask) / 2)
    total = F.col("bid_size_0") + F.col("ask_size_0")
    return grid.select(
        "symbol",
        "day",
        ((F.col("bin") + 1) * width).alias("us"),
        mid.alias("mid"),
        F.when(ok, (ask - bid) / mid * 1e4).alias("spread_bp"),
        F.when(
            ok, F.try_divide(F.col("bid_size_0") - F.col("ask_size_0"), total)
        ).alias("imbalance"),
    )


def aligned(bars: DataFrame, seconds: float, *, refuse: bool = True) -> DataFrame:
    """One row: whether all symbols share one gap-free clock. Refuses (raises) when they do not."""
    width = round(seconds * US)
    names = bars.select("symbol").distinct().agg(F.count(F.lit(1)).alias("n_symbols"))
    stamps = bars.groupBy("us").agg(F.count(F.lit(1)).alias("n"))
    facts = stamps.agg(
        F.count(F.lit(1)).alias("stamps"),
        F.min("us").alias("first"),
        F.max("us").alias("last"),
        F.min("n").alias("fewest"),
        F.max("n").alias("most"),
    ).join(F.broadcast(names))  # one row
    missing = (F.col("last") - F.col("first")) / F.lit(width) + 1 - F.col("stamps")
    out = facts.select(
        "n_symbols",
        "stamps",
        missing.cast("long").alias("missing_stamps"),
        ((F.col("fewest") == F.col("n_symbols")) & (F.col("most") == F.col("n_symbols"))).alias(
            "same_bars"
        ),
    )
    if refuse:
        bad = ~F.col("same_bars") | (F.col("missing_stamps") != 0)
        error = F.raise_error(F.lit("bars are not on one gap-free clock")).cast("boolean")
        out = out.withColumn("same_bars", F.when(bad, error).otherwise(F.col("same_bars")))
    return out


def common_clock(bars: DataFrame, values: Sequence[str]) -> DataFrame:
    """Bars on the stamps every symbol has."""
    names = bars.select("symbol").distinct().agg(F.count(F.lit(1)).alias("_n"))
    full = (
        bars.groupBy("us")
        .agg(F.count(F.lit(1)).alias("_have"))
        .join(F.broadcast(names))  # one row
        .filter("_have = _n")
    )
    return bars.join(full, "us", "left_semi").select("symbol", "us", *values)


def hourly_closes(bars: DataFrame, value: str = "close") -> DataFrame:
    """Closes on a complete hourly grid from a symbol's first to last bar, missing hours marked."""
    grid = filled_grid(
        bars.withColumn("_raw", F.col(value)).withColumn("us", F.col("us") - 1),
        3600,
        [value],
        order=("us",),
        by_day=False,
    )
    have = bars.select("symbol", "us", F.lit(True).alias("_have"))
    return grid.select(
        "symbol", (F.col("us") + 3600 * US).alias("us"), value
    ).join(have, ["symbol", "us"], "left").select(
        "symbol", "us", value, F.col("_have").isNull().alias("missing")
    )


def every_nth(df: DataFrame, step: int, *, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rows 0, step, 2 step, ... of each key's day, in order."""
    from tickloom.operators.chunks import Layout, numbered

    ranked = numbered(df.withColumn("day", day_of("us")), Layout(key=(*key, "day")), "_n")
    return ranked.filter((F.col("_n") - 1) % step == 0).drop("_n")


def thin_evenly(df: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows a symbol, evenly spaced over all of its rows.

    Kept are rows ``floor(i * total / max_rows)``; all rows when there are no more than that.
    """
    from tickloom.operators.chunks import numbered

    totals = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("_total"))
    rows = numbered(df, name="_row").join(totals, "symbol")
    m, total, r = F.lit(max_rows), F.col("_total"), F.col("_row") - 1
    # Row r is kept when some i has floor(i * total / m) = r: the least i with i*total >= r*m.
    i = F.ceil(r * m / total).cast("long")
    kept = (total <= m) | ((i < m) & (F.floor(i * total / m).cast("long") == r))
    return rows.filter(kept).drop("_row", "_total")


def sparse_to_hours(
    hours: DataFrame, prices: DataFrame, funding: DataFrame
) -> DataFrame:
    """On a grid of hours: the last known price, and a settlement's rate or zero."""
    from tickloom.operators.asof import asof_join

    priced = asof_join(
        hours.withColumn("_seq", F.col("us")),
        prices,
        ["close"],
        left_tie="_seq",
        right_tie="us",
        names={"r_us": "price_us"},
    )
    rates = funding.select("symbol", "us", "rate")
    return priced.join(rates, ["symbol", "us"], "left").select(
        "symbol", "us", "close", F.coalesce("rate", F.lit(0.0)).alias("rate")
    )


def bar_touch(bars: DataFrame, seconds: float, half_spread_bp: float) -> DataFrame:
    """A regular top of book from bars: the last closed bar's close, plus and minus half a spread."""
    grid = filled_grid(
        bars.withColumn("us", F.col("us")), seconds, ["close"], order=("us",), by_day=False
    )
    half = half_spread_bp * 1e-4
    return grid.select(
        "symbol",
        "us",
        (F.col("close") * (1 - half)).alias("bid_price_0"),
        (F.col("close") * (1 + half)).alias("ask_price_0"),
    )


def recorded_grid(
    book: DataFrame, days: DataFrame, seconds: float, until_us: int, values: Sequence[str]
) -> DataFrame:
    """Right-labelled grid of the instruments with every day, from snapshots up to a bound."""
    from tickloom.operators.asof import with_every_day

    kept = with_every_day(book.filter(F.col("us") <= until_us), days)
    grid = filled_grid(kept, seconds, values, label="right")
    return grid.groupBy("symbol", "us").agg(
        F.min_by(F.struct(*values), F.col("bin")).alias("r")
    ).select("symbol", "us", *[F.col(f"r.{v}").alias(v) for v in values])
