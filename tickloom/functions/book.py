"""Order-book features as Column builders over ordered windows.

Three stages share one sort: touch quantities, row-to-row changes, then rolling values. A
zero denominator gives NULL (unknown), never zero.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.columns import BP, bp_change, ln, median, ratio, rolling
from tickloom.operators.chunks import BOOK, Layout, chunked, own


@dataclass(frozen=True)
class Feature:
    """A named feature: the plane it reads, rows it looks back, and its Column builder."""

    name: str
    rows_back: int
    build: Callable[[WindowSpec], Column]
    plane: str = "book"
    description: str = ""


def touch_stage() -> dict[str, Column]:
    bid, ask = F.col("bid_price_0"), F.col("ask_price_0")
    bid_size, ask_size = F.col("bid_size_0"), F.col("ask_size_0")
    mid = (bid + ask) / 2
    total = bid_size + ask_size
    micro = ratio(bid * ask_size + ask * bid_size, total)
    return {
        "_mid": mid,
        "_spread": F.lit(BP) * ratio(ask - bid, mid),
        "_imb": ratio(bid_size - ask_size, total),
        "_total": total,
        "_micro": micro,
    }


def change_stage(w: WindowSpec) -> dict[str, Column]:
    bid, ask = F.col("bid_price_0"), F.col("ask_price_0")
    bid_size, ask_size = F.col("bid_size_0"), F.col("ask_size_0")
    bid_was, ask_was = F.lag(bid).over(w), F.lag(ask).over(w)
    bid_size_was, ask_size_was = F.lag(bid_size).over(w), F.lag(ask_size).over(w)
    bid_flow = (
        F.when(bid > bid_was, bid_size)
        .when(bid == bid_was, bid_size - bid_size_was)
        .when(bid < bid_was, -bid_size_was)
    )
    ask_flow = (
        F.when(ask < ask_was, ask_size)
        .when(ask == ask_was, ask_size - ask_size_was)
        .when(ask > ask_was, -ask_size_was)
    )
    moved = F.coalesce((bid != bid_was) | (ask != ask_was), F.lit(True))
    return {
        "_ofi": bid_flow - ask_flow,
        "_step": bp_change(F.col("_mid"), F.lag("_mid").over(w)),
        "_moved": moved.cast("int"),
    }


def _persistence(w: WindowSpec) -> Column:
    since = [F.lag("_moved", k, 0).over(w) for k in range(20)]
    rows = F.lit(20)
    for k in reversed(range(20)):
        rows = F.when(since[k] == 1, F.lit(k)).otherwise(rows)
    return rows.cast("double")


FEATURES: dict[str, Feature] = {}


def _add(name: str, rows_back: int, build: Callable[[WindowSpec], Column], text: str) -> None:
    FEATURES[name] = Feature(name, rows_back, build, "book", text)


_add("spread_bp", 0, lambda w: F.col("_spread"), "quoted spread, bp of mid")
_add("queue_imbalance", 0, lambda w: F.col("_imb"), "touch size imbalance in [-1, 1]")
_add(
    "microprice_dev_bp",
    0,
    lambda w: F.lit(BP) * ratio(F.col("_micro") - F.col("_mid"), "_mid"),
    "size-weighted mid over mid, bp",
)
_add(
    "log_depth_ratio",
    0,
    lambda w: ln(ratio(F.when(F.col("bid_size_0") > 0, F.col("bid_size_0")), "ask_size_0")),
    "log of bid size over ask size",
)
_add("log_total_depth", 0, lambda w: ln("_total"), "log of touch size")
_add("ofi_1", 1, lambda w: F.col("_ofi"), "order-flow imbalance of one update")
_add("ofi_20", 20, lambda w: rolling(F.sum, "_ofi", w, 20), "order-flow imbalance of 20 updates")
_add(
    "ofi_20_norm",
    70,
    lambda w: ratio(rolling(F.sum, "_ofi", w, 20), rolling(F.avg, "_total", w, 50)),
    "order-flow imbalance over typical depth",
)
_add("mid_return_1_bp", 1, lambda w: F.col("_step"), "one-row log return")
_add(
    "mid_return_20_bp",
    20,
    lambda w: bp_change(F.col("_mid"), F.lag("_mid", 20).over(w)),
    "twenty-row log return",
)
_add(
    "realized_vol_50_bp",
    51,
    lambda w: rolling(F.stddev_samp, "_step", w, 50),
    "std of one-row returns over 50 rows",
)
_add(
    "spread_bp_ratio_50",
    50,
    lambda w: ratio("_spread", rolling(F.avg, "_spread", w, 50)),
    "spread over its mean of 50 rows",
)
_add(
    "quote_intensity_20",
    20,
    lambda w: rolling(F.avg, F.col("_moved").cast("double"), w, 20, 1),
    "share of rows on which the touch moved",
)
_add(
    "imbalance_slope_10",
    10,
    lambda w: F.col("_imb") - F.lag("_imb", 10).over(w),
    "change of imbalance over ten rows",
)
_add("touch_persistence_20", 20, _persistence, "rows since the touch moved, at most 20")
_add(
    "mid_reversal_10",
    10,
    lambda w: -(
        bp_change(F.col("_mid"), F.lag("_mid", 5).over(w))
        * bp_change(F.lag("_mid", 5).over(w), F.lag("_mid", 10).over(w))
    ),
    "negated product of two five-row returns",
)
_add(
    "spread_pressure_20",
    20,
    lambda w: ratio("_spread", rolling(median, "_spread", w, 20, 5)),
    "spread over its median of 20 rows",
)


def _shock(w: WindowSpec) -> Column:
    signed = F.col("bid_size_0") - F.col("ask_size_0")
    return ratio(signed - F.lag(signed).over(w), rolling(F.avg, "_total", w, 10, 3))


_add("size_shock_10", 10, _shock, "change of signed touch size over typical size")
_add(
    "micro_drift_5",
    5,
    lambda w: bp_change(F.col("_micro"), F.lag("_micro", 5).over(w)),
    "five-row return of the microprice",
)
_add(
    "realised_vol_20",
    20,
    lambda w: rolling(F.stddev_samp, "_step", w, 20, 5),
    "std of one-row returns over 20 rows",
)

KEYS = ("symbol", "us", "seq")


def build_features(
    book: DataFrame,
    names: Sequence[str],
    *,
    layout: Layout = BOOK,
    spine: DataFrame | None = None,
    carry: Sequence[str] = (),
    dropna: bool = False,
) -> DataFrame:
    """The named features beside the key, from one shuffle and one sort.

    Names from different planes are refused, as are unknown names.
    """
    unknown = [n for n in names if n not in FEATURES]
    if unknown:
        raise KeyError(f"unknown features: {unknown}")
    planes = {FEATURES[n].plane for n in names}
    if len(planes) > 1:
        raise ValueError(f"features from several planes cannot be built together: {planes}")
    back = max((FEATURES[n].rows_back for n in names), default=0)
    if back == 0:
        # Functions of the row alone: no shuffle at all.
        alone = book.select("*", *[c.alias(n) for n, c in touch_stage().items()])
        out = alone.select(
            *layout.key,
            *layout.order,
            *carry,
            *[FEATURES[n].build(layout.window()).cast("double").alias(n) for n in names],
        )
        return out.dropna(subset=list(names)) if dropna else out
    base = chunked(book, layout, rows_back=back + 2, spine=spine)
    w = layout.window()
    for stage in (touch_stage(), change_stage(w)):
        base = base.select("*", *[c.alias(n) for n, c in stage.items()])
    out = base.select(
        *layout.key,
        *[c for c in layout.order],
        *carry,
        "_chunk",
        "_own",
        *[FEATURES[n].build(w).cast("double").alias(n) for n in names],
    )
    out = own(out)
    return out.dropna(subset=list(names)) if dropna else out


# --------------------------------------------------------------------------- depth


def level_arrays(depth: int) -> dict[str, Column]:
    """Price and size arrays per side, best first."""
    return {
        f"{side}_{kind}": F.array(*[F.col(f"{side}_{kind}_{i}") for i in range(depth)])
        for side in ("bid", "ask")
        for kind in ("price", "size")
    }


def available_depth(columns: Sequence[str]) -> int:
    """How many complete levels a frame carries a side."""
    depth = 0
    have = set(columns)
    while all(f"{s}_{k}_{depth}" in have for s in ("bid", "ask") for k in ("price", "size")):
        depth += 1
    return depth


def _share(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def depth_features(book: DataFrame, depth: int | None = None) -> DataFrame:
    """Thirteen shape measures of the visible book; an empty denominator gives 0 here."""
    present = available_depth(book.columns)
    if present < 2:
        raise ValueError(f"depth features need two levels a side, found {present}")
    n = present if depth is None else depth
    if n > present:
        raise ValueError(f"asked for {n} levels, the frame has {present}")
    mid = (F.col("bid_price_0") + F.col("ask_price_0")) / 2

    def total(terms: list[Column]) -> Column:
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    measures: dict[str, Column] = {}
    for side in ("bid", "ask"):
        sign = 1 if side == "bid" else -1
        away = [
            (mid - F.col(f"{side}_price_{i}")) * sign / F.col("_mid0") * BP for i in range(n)
        ]
        sizes = [F.col(f"{side}_size_{i}").cast("double") for i in range(n)]
        weighted = [
            s * F.when(d > 0, F.lit(1.0) / d).otherwise(F.lit(0.0))
            for s, d in zip(sizes, away, strict=True)
        ]
        measures[f"_{side}_total"] = total(sizes)
        measures[f"_{side}_weighted"] = total(weighted)
        measures[f"_{side}_far"] = away[-1]
        measures[f"_{side}_paid"] = total([s * d for s, d in zip(sizes, away, strict=True)])
    staged = book.withColumn("_mid0", mid).select("*", *[c.alias(k) for k, c in measures.items()])
    bt, at = F.col("_bid_total"), F.col("_ask_total")
    bw, aw = F.col("_bid_weighted"), F.col("_ask_weighted")
    bid_conc = _share(F.col("bid_size_0"), bt)
    ask_conc = _share(F.col("ask_size_0"), at)
    bid_slope, ask_slope = _share(F.col("_bid_far"), bt), _share(F.col("_ask_far"), at)
    bid_paid, ask_paid = _share(F.col("_bid_paid"), bt), _share(F.col("_ask_paid"), at)
    return staged.select(
        *KEYS,
        _share(bt - at, bt + at).alias("depth_imbalance"),
        _share(bw - aw, bw + aw).alias("weighted_depth_imbalance"),
        bid_conc.alias("bid_concentration"),
        ask_conc.alias("ask_concentration"),
        (bid_conc - ask_conc).alias("concentration_imbalance"),
        bid_slope.alias("bid_slope_bp"),
        ask_slope.alias("ask_slope_bp"),
        (ask_slope - bid_slope).alias("slope_imbalance"),
        bid_paid.alias("bid_impact_bp"),
        ask_paid.alias("ask_impact_bp"),
        (ask_paid - bid_paid).alias("impact_imbalance_bp"),
        ln(bt + at).alias("log_visible_depth"),
        ((F.col("_bid_far") + F.col("_ask_far")) / 2).alias("book_span_bp"),
    )
