"""Forward labels. Every one declares how many rows or seconds ahead it reads (its purge)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.columns import BP, US, bp_change, ratio, rolling
from tickloom.operators.asof import asof_join, entry_exit
from tickloom.operators.chunks import BOOK, Layout, chunked, numbered, own
from tickloom.operators.ranges import Arrays, first_beyond, in_chunks

KEYS = ("symbol", "us", "seq")


def mid_column() -> Column:
    return (F.col("bid_price_0") + F.col("ask_price_0")) / 2


def _cut(
    book: DataFrame, back: int, ahead: int, layout: Layout, spine: DataFrame | None
) -> tuple[DataFrame, WindowSpec]:
    mids = book.select(*KEYS, mid_column().alias("mid"))
    return (
        chunked(mids, layout, rows_back=back, rows_ahead=ahead, spine=spine),
        layout.window(),
    )


def forward_return(
    book: DataFrame,
    horizon: int,
    *,
    simple: bool = False,
    layout: Layout = BOOK,
    spine: DataFrame | None = None,
    name: str = "forward_bp",
) -> DataFrame:
    """Return over the next ``horizon`` rows in bp, log by default; the last rows are missing."""
    cut, w = _cut(book, 0, horizon, layout, spine)
    later = F.lead("mid", horizon).over(w)
    move = (ratio(later, "mid") - 1) * BP if simple else bp_change(later, F.col("mid"))
    return own(cut.select(*KEYS, "_chunk", "_own", move.alias(name)))


def three_class(move: Column, threshold: float | Column) -> Column:
    """-1 / 0 / +1; a move of exactly the threshold is hold, an unknown move is missing."""
    bar = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(move > bar, 1).when(move < -bar, -1).when(move.isNotNull(), 0)


def class_balance(labels: DataFrame, label: str = "label") -> DataFrame:
    """Share of each class among labelled rows."""
    counts = labels.filter(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("rows")
    )
    whole = counts.agg(F.sum("rows").alias("all_rows"))
    return counts.join(F.broadcast(whole)).select(  # one row
        label, "rows", (F.col("rows") / F.col("all_rows")).alias("share")
    )


def threshold_for_share(moves: DataFrame, share: float, move: str = "forward_bp") -> DataFrame:
    """One row: the threshold that leaves ``share`` of the rows outside hold."""
    from tickloom.operators.quantiles import quantile_by

    return quantile_by(moves, [], F.abs(move), 1.0 - share, "threshold_bp")


def smoothed_move(
    book: DataFrame,
    horizon: int,
    smoothing: int,
    *,
    from_now: bool = False,
    layout: Layout = BOOK,
    spine: DataFrame | None = None,
    name: str = "move_bp",
) -> DataFrame:
    """Move between averages of ``smoothing`` mids ending at ``t + horizon`` and at ``t``.

    ``from_now`` measures against the mid at ``t`` instead of the backward average, which is
    already known and therefore not a forecast.
    """
    cut, w = _cut(book, smoothing + 1, horizon, layout, spine)
    staged = cut.withColumn("_avg", F.avg("mid").over(w.rowsBetween(-(smoothing - 1), 0)))
    base = F.col("mid") if from_now else F.col("_avg")
    move = bp_change(F.lead("_avg", horizon).over(w), base)
    return own(staged.select(*KEYS, "_chunk", "_own", move.alias(name)))


def normalised_move(
    book: DataFrame,
    horizon: int,
    smoothing: int,
    window: int,
    *,
    layout: Layout = BOOK,
    spine: DataFrame | None = None,
    name: str = "move",
) -> DataFrame:
    """The smoothed move in units of trailing volatility (half a window is enough)."""
    back = max(window, smoothing) + 2
    cut, w = _cut(book, back, horizon, layout, spine)
    staged = cut.select(
        "*",
        F.avg("mid").over(w.rowsBetween(-(smoothing - 1), 0)).alias("_avg"),
        bp_change(F.col("mid"), F.lag("mid").over(w)).alias("_step"),
    )
    sigma = rolling(F.stddev_samp, "_step", w, window, window // 2)
    move = bp_change(F.lead("_avg", horizon).over(w), F.col("_avg"))
    value = F.when(sigma > 0, move / sigma)
    return own(staged.select(*KEYS, "_chunk", "_own", value.alias(name)))


def direction(move: Column, cost_bp: float | Column) -> Column:
    """Sign of a move that clears the cost, else 0; missing stays missing."""
    bar = cost_bp if isinstance(cost_bp, Column) else F.lit(cost_bp)
    clears = F.when(F.abs(move) > bar, F.signum(move)).otherwise(F.lit(0.0))
    return F.when(move.isNotNull(), clears)


def triple_barrier(
    book: DataFrame,
    horizon: int,
    up_bp: float,
    down_bp: float,
    *,
    layout: Layout = BOOK,
    spine: DataFrame | None = None,
) -> DataFrame:
    """+1 / -1 for the barrier touched first within ``horizon`` rows, 0 for the clock.

    A tie resolves upward. Rows without ``horizon`` known mids after them, or without a positive mid
    of their own, are missing. First touches come from range extremes, so a chunk takes
    ``log(horizon)`` numbers a row, not a path.
    """
    cut, _ = _cut(book, 0, horizon, layout, spine)

    def touched(arrays: Arrays) -> Arrays:
        mid = arrays["mid"]
        unknown = np.concatenate([[0], np.cumsum(np.isnan(mid))])
        rows = np.flatnonzero(mid[: max(len(mid) - horizon, 0)] > 0)
        low, high = rows + 1, rows + 1 + horizon
        whole = unknown[high] == unknown[low]
        rows, low, high = rows[whole], low[whole], high[whole]
        start = mid[rows]
        up = first_beyond(mid, np.maximum, low, high, lambda m, i: (m / start[i] - 1) * BP >= up_bp)
        down = first_beyond(mid, np.minimum, low, high, lambda m, i: (m / start[i] - 1) * BP <= -down_bp)
        label = np.full(len(mid), np.nan)
        label[rows] = np.where((up == high) & (down == high), 0, np.where(up <= down, 1, -1))
        return {"label": label}

    found = in_chunks(cut, layout, KEYS, ["mid"], ["label"], touched)
    return found.withColumn("label", F.col("label").cast("int"))


def forward_between_snapshots(
    book: DataFrame, hold_s: float, latency_ms: float = 10.0
) -> DataFrame:
    """Simple mid return between the entry and the exit snapshot, bp."""
    mids = book.select(*KEYS, mid_column().alias("mid"))
    found = entry_exit(mids.select(*KEYS), mids, ["mid"], hold_s=hold_s, latency_ms=latency_ms)
    return found.select(*KEYS, ((ratio("exit_mid", "entry_mid") - 1) * BP).alias("move_bp"))


def control_move(
    book: DataFrame,
    hold_s: float,
    smoothing: int = 20,
    *,
    layout: Layout = BOOK,
    spine: DataFrame | None = None,
) -> DataFrame:
    """Move between trailing averages now and at the first row ``hold_s`` later, bp."""
    cut, w = _cut(book, smoothing, 0, layout, spine)
    smooth = own(
        cut.select(
            *KEYS, "_chunk", "_own", rolling(F.avg, "mid", w, smoothing).alias("smooth")
        )
    )
    later = asof_join(
        smooth,
        smooth,
        ["smooth"],
        at=F.col("us") + round(hold_s * US),
        forward=True,
        names={"smooth": "later"},
    )
    return later.select(*KEYS, bp_change(F.col("later"), F.col("smooth")).alias("move_bp"))


def relative_change(
    book: DataFrame, k: int, *, layout: Layout = BOOK, spine: DataFrame | None = None
) -> DataFrame:
    """Mean of the next ``k`` mids against the last ``k``; NULL without ``k`` either side."""
    cut, w = _cut(book, k, k, layout, spine)
    past = rolling(F.avg, "mid", w, k)
    ahead = w.rowsBetween(1, k)
    future = F.when(F.count("mid").over(ahead) >= k, F.avg("mid").over(ahead))
    return own(
        cut.select(*KEYS, "_chunk", "_own", ratio(future - past, past).alias("rel_change"))
    )


def down_flat_up(change: Column, alpha: float) -> Column:
    """1 down, 2 flat, 3 up; an unknown change is flat."""
    return F.when(change > alpha, 3).when(change < -alpha, 1).otherwise(2)


def shift_by_days(labels: DataFrame, shift: int, label: str) -> DataFrame:
    """Labels moved circularly by whole days, row by row inside the day.

    The n-th row of a day takes the label of the n-th row of day ``(index + shift) mod days``.
    """
    from tickloom.functions.columns import day_of

    staged = labels.withColumn("day", day_of("us"))
    placed = numbered(staged, Layout(key=("symbol", "day")), "_n")
    days = staged.select("symbol", "day").distinct()
    per = Window.partitionBy("symbol")
    index = days.select(
        "symbol",
        "day",
        (F.row_number().over(per.orderBy("day")) - 1).alias("_i"),
        F.count(F.lit(1)).over(per).alias("_days"),
    )
    source = (
        placed.join(index, ["symbol", "day"])
        .select("symbol", F.col("_i").alias("_from"), "_n", F.col(label).alias(f"{label}_shifted"))
    )
    target = placed.join(index, ["symbol", "day"]).withColumn(
        "_from", F.pmod(F.col("_i") + F.lit(shift), F.col("_days"))
    )
    return target.join(source, ["symbol", "_from", "_n"], "left").select(
        *KEYS, label, f"{label}_shifted"
    )


@dataclass(frozen=True)
class Target:
    """A label by name: what it needs and how far ahead it reads."""

    name: str
    build: Callable[..., DataFrame]
    needs_path: bool
    text: str

    def purge_rows(self, horizon: int) -> int:
        return horizon


def _from_move(kind: Callable[[Column], Column]) -> Callable[..., DataFrame]:
    def build(book: DataFrame, horizon: int, **options: object) -> DataFrame:
        smoothing = int(options.get("smoothing", 1))
        spine = options.get("spine")
        if smoothing > 1:
            moves = smoothed_move(book, horizon, smoothing, spine=spine, name="forward_bp")
        else:
            moves = forward_return(book, horizon, spine=spine)
        cost = float(options.get("cost_bp", 0.0))
        return moves.select(*KEYS, kind(F.col("forward_bp"), cost).alias("target"))

    return build


TARGETS: dict[str, Target] = {
    "direction": Target(
        "direction", _from_move(direction), False, "sign of a move that clears the cost"
    ),
    "magnitude": Target("magnitude", _from_move(lambda m, c: m), False, "the move itself, bp"),
    "net_pnl": Target("net_pnl", _from_move(lambda m, c: m - c), False, "a long's net, bp"),
    "smoothed_direction": Target(
        "smoothed_direction",
        lambda book, horizon, **o: _from_move(direction)(book, horizon, **{"smoothing": 20, **o}),
        True,
        "direction of the smoothed move",
    ),
    "normalised_magnitude": Target(
        "normalised_magnitude",
        lambda book, horizon, smoothing=20, normalise=200, spine=None, **_: normalised_move(
            book, horizon, smoothing, normalise, spine=spine, name="target"
        ),
        True,
        "smoothed move in trailing volatilities",
    ),
    "triple_barrier": Target(
        "triple_barrier",
        lambda book, horizon, cost_bp, spine=None, **_: triple_barrier(
            book, horizon, cost_bp, cost_bp, spine=spine
        ).withColumnRenamed("label", "target"),
        True,
        "first barrier touched",
    ),
}


def build_target(name: str, book: DataFrame, horizon: int, **options: object) -> DataFrame:
    """A registered target by name."""
    if name not in TARGETS:
        raise KeyError(f"no target {name!r}; known: {', '.join(sorted(TARGETS))}")
    return TARGETS[name].build(book, horizon, **options)


def describe_targets(spark) -> DataFrame:
    """The registry as a table."""
    rows = [(t.name, t.needs_path, t.text) for t in TARGETS.values()]
    return spark.createDataFrame(rows, "name string, needs_path boolean, description string")

