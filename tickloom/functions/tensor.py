"""Book tensors, the replicated trailing z-score book, and its auxiliary inputs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.columns import clip, ratio
from tickloom.functions.flow import log_change_std
from tickloom.operators.chunks import BOOK, Layout, chunked, own
from tickloom.operators.quantiles import quantile_by, quantiles_by
from tickloom.operators.ranges import (
    Arrays, array_layout, before, deviation, in_chunks, known, merged, moments, rolled,
)
from tickloom.session import materialised

KEYS = ("symbol", "us", "seq")
SIDES = ("ask", "bid")


def size_columns(levels: int) -> list[str]:
    return [f"{s}_size_{i}" for s in SIDES for i in range(levels)]


def tensor_calibration(book: DataFrame, levels: int) -> DataFrame:
    """One row: exact median spread, and mean and population deviation of every log size."""
    spread = F.round(F.col("ask_price_0") - F.col("bid_price_0"), 8)
    # Spreads take few distinct values, so their counts are small and the median is exact.
    counts = book.groupBy(spread.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    middle = counts.agg(F.percentile("v", F.lit(0.5), F.col("n")).alias("spread_floor"))
    moments = book.agg(
        *[F.avg(F.log1p(c)).alias(f"{c}_mean") for c in size_columns(levels)],
        *[F.stddev_pop(F.log1p(c)).alias(f"{c}_sd") for c in size_columns(levels)],
    )
    return middle.join(F.broadcast(moments))  # one row each


def lob_tensor(
    book: DataFrame,
    calibration: DataFrame,
    levels: int,
    *,
    sigma_s: float = 60.0,
    spine: DataFrame | None = None,
) -> DataFrame:
    """Level distances in units of ``max(sigma * mid, spread floor)`` and z-scored log sizes."""
    sigma = log_change_std(book, sigma_s, spine=spine)
    rows = book.join(sigma, list(KEYS)).join(F.broadcast(calibration))  # one row
    mid = (F.col("bid_price_0") + F.col("ask_price_0")) / 2
    scale = F.when(
        F.col("sigma").isNotNull(), F.greatest(F.col("sigma") * mid, F.col("spread_floor"))
    )
    staged = rows.withColumn("_scale", scale)
    out: list[Column] = []
    for side, sign in (("ask", 1), ("bid", -1)):
        for i in range(levels):
            away = (F.col(f"{side}_price_{i}") - F.col(f"{side}_price_0")) * sign
            out.append((away / F.col("_scale")).alias(f"lob_{side}_dist_{i}"))
    for side in SIDES:
        for i in range(levels):
            c = f"{side}_size_{i}"
            z = (F.log1p(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd")
            out.append(z.alias(f"lob_{side}_size_{i}"))
    return staged.select(*KEYS, *out)


def replicated_book(
    book: DataFrame,
    levels: int,
    *,
    price_window: int = 50,
    size_window: int = 100,
    layout: Layout = BOOK,
    spine: DataFrame | None = None,
) -> DataFrame:
    """Prices and sizes against the rows before them, with fitted floors on every scale.

    Rows with fewer than the longer window before them are dropped.
    """
    start = max(price_window, size_window)
    layout = array_layout(layout)
    ask, bid = F.col("ask_price_0"), F.col("bid_price_0")
    spread = ask - bid
    sizes = size_columns(levels)
    prices = [f"{s}_price_{i}" for s in ("ask", "bid") for i in range(levels)]
    cut = chunked(book.select(*KEYS, *prices, *sizes), layout, rows_back=start, spine=spine)
    names = ["_n", "_am", "_as", "_bm", "_bs", "_sm"] + [f"_{k}_{c}" for k in "ms" for c in sizes]

    def made(arrays: Arrays) -> Arrays:
        def past(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
            """Mean and floored deviation of the ``n`` rows before each; NaN with fewer."""
            count, mean, squares = (before(p) for p in rolled(moments(x), [n], merged)[n])
            with np.errstate(invalid="ignore"):
                full = count >= n
                sd = np.sqrt(np.maximum(squares / n, 1e-12))
            return np.where(full, mean, np.nan), np.where(full, sd, np.nan)

        a, b = arrays["ask_price_0"], arrays["bid_price_0"]
        out = {"_n": np.arange(len(a), dtype=float)}
        out["_am"], out["_as"] = past(a, price_window)
        out["_bm"], out["_bs"] = past(b, price_window)
        out["_sm"], _ = past(a - b, price_window)
        for c in sizes:
            out[f"_m_{c}"], out[f"_s_{c}"] = past(arrays[c], size_window)
        return out

    keep = [*KEYS, *prices, *sizes]
    first = in_chunks(cut, layout, keep, [*prices, *sizes], names, made)
    staged = materialised(first.filter(F.col("_n") >= start))  # read for the floors of each size, and again
    floors = quantile_by(book.filter(spread > 0), ["symbol"], spread, 0.5, "_spread")
    for c in sizes:
        floors = floors.join(quantiles_by(staged, ["symbol"], f"_s_{c}", {f"_lo_{c}": 0.1, f"_md_{c}": 0.5}), "symbol")
    rows = staged.join(F.broadcast(floors), "symbol")  # one row an instrument
    floor = F.when(F.col("_sm") > 0, F.col("_sm")).otherwise(F.col("_spread")) * 0.5
    out: list[Column] = []
    for side, price0, mean, sd, sign in (
        ("ask", ask, F.col("_am"), F.col("_as"), 1),
        ("bid", bid, F.col("_bm"), F.col("_bs"), -1),
    ):
        scale = F.greatest(sd, floor)
        out.append(((price0 - mean) / scale).alias(f"{side}_px_0"))
        for i in range(1, levels):
            away = (F.col(f"{side}_price_{i}") - price0) * sign
            out.append((away / scale).alias(f"{side}_px_{i}"))
        for i in range(levels):
            c = f"{side}_size_{i}"
            least = F.greatest(F.col(f"_lo_{c}"), F.col(f"_md_{c}") * 0.05, F.lit(1e-6))
            z = (F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.col(f"_s_{c}"), least)
            out.append(z.alias(f"{side}_sz_{i}"))
    return rows.select(*KEYS, *out)


def exec_price(side: str, levels: int, lot: float, tick: float) -> Column:
    """Average price of ``lot`` over the levels, on the tick; unrounded over all when short."""
    from tickloom.functions.costs import walk_side

    walked = walk_side(side, lot, levels)
    spent = F.lit(0.0)
    held = F.lit(0.0)
    for i in range(levels):
        spent = spent + F.col(f"{side}_price_{i}") * F.col(f"{side}_size_{i}")
        held = held + F.col(f"{side}_size_{i}")
    rounded = F.rint(walked["vwap"] / tick) * tick
    return F.when(held >= lot, rounded).otherwise(ratio(spent, held))


def _lag_log(x: Column, w: WindowSpec) -> Column:
    value = F.log(F.try_divide(x + 1e-6, F.lag(x).over(w) + 1e-6))
    return F.round(F.coalesce(value, F.lit(0.0)), 9)


def _score(x: np.ndarray, n: int) -> np.ndarray:
    """Score against the last ``n`` rows; a flat stretch divides by a tiny constant, missing is 0."""
    parts = rolled(moments(x), [n], merged)[n]
    mean, sd = known(parts), deviation(parts)
    return np.nan_to_num((x - mean) / (np.where(sd == 0, 1e-9, sd) + 1e-9), nan=0.0, posinf=None, neginf=None)


def auxiliary_inputs(
    rows: DataFrame,
    depth: int,
    *,
    window: int = 100,
    names: Sequence[str] | None = None,
    layout: Layout = BOOK,
    spine: DataFrame | None = None,
) -> DataFrame:
    """Lag logs, depth, impact, flow and volatility inputs, scored on a trailing window.

    ``rows`` are book rows with ``signed_volume``, ``total_trade_volume`` and ``sell_count``.
    Two inputs (book imbalance, volatility) stay unscored. Missing becomes 0. ``names`` picks some of
    the inputs, so the others are not computed.
    """
    layout = array_layout(layout)
    cut = chunked(rows, layout, rows_back=window + 60, spine=spine)
    w = layout.window()
    a0, b0, qa, qb = (F.col(c) for c in ("ask_price_0", "bid_price_0", "ask_size_0", "bid_size_0"))

    def total(side: str) -> Column:
        out = F.col(f"{side}_size_0")
        for i in range(1, depth):
            out = out + F.col(f"{side}_size_{i}")
        return out

    mid = (a0 + b0) / 2
    first = cut.select(
        "*",
        mid.alias("_mid"),
        total("ask").alias("_at"),
        total("bid").alias("_bt"),
        ((exec_price("ask", depth, 1.0, 0.01) + exec_price("bid", depth, 1.0, 0.01)) / 2).alias("_ex"),
    )
    second = first.select(
        "*",
        F.coalesce(ratio("_mid", F.lag("_mid", 10).over(w)) - 1, F.lit(0.0)).alias("_ret10"),
        F.coalesce(ratio("_mid", F.lag("_mid").over(w)) - 1, F.lit(0.0)).alias("_ret1"),
        (ratio("_ex", F.lag("_ex").over(w)) - 1).alias("_exret"),
        F.sum("signed_volume").over(w.rowsBetween(-9, 0)).alias("_flow"),
    )
    inputs: dict[str, Column] = {
        "ask_rate_lvl0_lag_1_log": _lag_log(a0, w),
        "bid_rate_lvl0_lag_1_log": _lag_log(b0, w),
        "spread": a0 - b0,
        "mid_lag_1_log": F.coalesce(F.lag(F.log(F.col("_mid") + 1e-12)).over(w), F.lit(0.0)),
        "ask_depth_total_lag_1_log": _lag_log(F.col("_at"), w),
        "bid_depth_total_lag_1_log": _lag_log(F.col("_bt"), w),
        "queue_imbalance": (qb - qa) / (qb + qa + 1e-12),
        "ofi": F.coalesce(qb - F.lag(qb).over(w), F.lit(0.0))
        - F.coalesce(qa - F.lag(qa).over(w), F.lit(0.0)),
        "microprice_dev": (a0 * qb + b0 * qa) / (qb + qa + 1e-12) - F.col("_mid"),
        "impact_coeff_1s": clip(
            F.try_divide(F.col("_ret10"), F.col("_flow") / F.col("_mid") + 1e-12), -10.0, 10.0
        ),
        "return_1s": F.col("_ret10"),
        "trade_flow_imbalance_1s": F.col("_flow"),
        "total_trade_volume_lag_1_log": _lag_log(F.col("total_trade_volume"), w),
        "sell_count_lag_1_log": _lag_log(F.col("sell_count").cast("double"), w),
        "volatility_1s": F.coalesce(
            F.when(
                F.count("_ret1").over(w.rowsBetween(-9, 0)) >= 10,
                F.stddev_samp("_ret1").over(w.rowsBetween(-9, 0)),
            ),
            F.lit(0.0),
        ),
        "rv_50": F.coalesce(F.stddev_samp("_ret1").over(w.rowsBetween(-49, 0)), F.lit(0.0)),
        "mid_mean_50": F.avg("_mid").over(w.rowsBetween(-49, 0)),
        "spread_rolling_10": F.avg(a0 - b0).over(w.rowsBetween(-9, 0)),
    }
    plain = {
        "book_imbalance": F.round(
            F.coalesce(ratio(F.col("_bt") - F.col("_at"), F.col("_bt") + F.col("_at")), F.lit(0.0)), 9
        ),
        "volatility": F.coalesce(
            F.when(
                F.count("_exret").over(w.rowsBetween(-49, 0)) >= 50,
                F.stddev_samp("_exret").over(w.rowsBetween(-49, 0)),
            ),
            F.lit(0.0),
        ),
    }
    if names is not None:
        inputs = {n: c for n, c in inputs.items() if n in names}
        plain = {n: c for n, c in plain.items() if n in names}
    third = second.select(
        *KEYS,
        "_chunk",
        "_own",
        *[c.cast("double").alias(n) for n, c in inputs.items()],
        *[c.alias(n) for n, c in plain.items()],
    )

    scored = list(inputs)

    def made(arrays: Arrays) -> Arrays:
        return {n: _score(arrays[n], window) for n in scored}

    out = in_chunks(third, layout, [*KEYS, *plain], scored, scored, made)
    return out.select(*KEYS, *[F.round(n, 9).alias(n) for n in [*scored, *plain]])


def windows_of_rows(
    rows: DataFrame,
    columns: Sequence[str],
    length: int,
    *,
    layout: Layout = BOOK,
    spine: DataFrame | None = None,
) -> DataFrame:
    """The last ``length`` rows of each column as arrays; incomplete windows are left out."""
    cut = chunked(rows.select(*KEYS, *columns), layout, rows_back=length, spine=spine)
    frame = layout.window().rowsBetween(-(length - 1), 0)
    built = cut.select(
        *KEYS,
        "_chunk",
        "_own",
        # collect_list skips missing values, so a short list also marks a missing one.
        *[F.collect_list(c).over(frame).alias(c) for c in columns],
    )
    full = F.lit(True)
    for c in columns:
        full = full & (F.size(c) == length)
    return own(built.filter(full))


def imbalance_rule(training: DataFrame, rows: DataFrame, share: float = 0.05) -> DataFrame:
    """Side of the heavier queue on rows whose imbalance is in the training top share."""
    value = ratio(
        F.col("bid_size_0") - F.col("ask_size_0"), F.col("bid_size_0") + F.col("ask_size_0")
    )
    bar = quantile_by(training, [], F.abs(value), 1.0 - share, "threshold")
    joined = rows.join(F.broadcast(bar))  # one row
    side = F.when(F.abs(value) >= F.col("threshold"), F.signum(value)).otherwise(F.lit(0.0))
    return joined.select(*KEYS, F.coalesce(side, F.lit(0.0)).cast("int").alias("side"))
