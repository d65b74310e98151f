"""Trade-flow and stamp-timed features."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.columns import (
    BP,
    US,
    bp_change,
    ln,
    median,
    ratio,
    rolling,
)
from tickloom.operators.asof import asof_join
from tickloom.operators.chunks import BOOK, PRINTS, Layout, chunked, own
from tickloom.operators.ranges import (
    Arrays, Ranked, added, array_layout, before, deviation, in_chunks, known, merged, moments, rolled, stamped, trailing,
)

KEYS = ("symbol", "us", "seq")
DEFAULT_WINDOWS_S = (1, 5, 30, 300)


def trade_columns(trades: DataFrame) -> DataFrame:
    """Signed quantity, notional, buy flag and a count of one."""
    maker = F.col("is_buyer_maker")
    return trades.select(
        "symbol",
        "us",
        "trade_id",
        "price",
        "quantity",
        F.when(maker, -F.col("quantity")).otherwise(F.col("quantity")).alias("signed"),
        (F.col("price") * F.col("quantity")).alias("notional"),
        (~maker).alias("is_buy"),
        F.lit(1.0).alias("count"),
    )


def rolling_trade_stats(
    trades: DataFrame,
    windows_s: Sequence[float] = DEFAULT_WINDOWS_S,
    *,
    layout: Layout = PRINTS,
    spine: DataFrame | None = None,
) -> DataFrame:
    """Per trade: sums over ``(t - s, t]`` for each window.

    Trades sharing a stamp all see the whole stamp, so the last of them carries what a
    row-ordered window would.
    """
    layout = array_layout(layout)
    base = trade_columns(trades).withColumn("is_buy", F.col("is_buy").cast("double"))
    cut = chunked(base, layout, secs_back=max(windows_s), spine=spine)
    kinds = [("sum", c) for c in ("count", "quantity", "signed", "is_buy", "notional")] + [("std", "price")]
    stats = {f"_{c}_{s}": (kind, c, 1 - round(s * US), 0) for s in windows_s for kind, c in kinds}
    out: list[Column] = []
    for s in windows_s:
        volume = F.col(f"_quantity_{s}")
        out += [
            F.col(f"_count_{s}").alias(f"trade_count_{s}s"),
            volume.alias(f"trade_volume_{s}s"),
            F.col(f"_signed_{s}").alias(f"signed_volume_{s}s"),
            ratio(f"_signed_{s}", volume).alias(f"trade_imbalance_{s}s"),
            ratio(f"_is_buy_{s}", f"_count_{s}").alias(f"buy_share_{s}s"),
            ratio(f"_notional_{s}", volume).alias(f"trade_vwap_{s}s"),
            F.col(f"_price_{s}").alias(f"trade_price_std_{s}s"),
        ]
    keep = ["symbol", "us", "trade_id"]
    return stamped(cut, layout, keep, stats).select(*keep, *out)


def trade_features(
    book: DataFrame,
    trades: DataFrame,
    windows_s: Sequence[float] = DEFAULT_WINDOWS_S,
    *,
    tolerance_s: float = 60,
    impact: Sequence[tuple[float, int]] = ((1, 10), (5, 50), (30, 300)),
    spine: DataFrame | None = None,
) -> DataFrame:
    """Trade flow carried onto the book rows, in scale-free form."""
    stats = rolling_trade_stats(trades, windows_s, spine=spine)
    names = [c for c in stats.columns if c not in ("symbol", "us", "trade_id")]
    mid = (F.col("bid_price_0") + F.col("ask_price_0")) / 2
    rows = book.select(*KEYS, mid.alias("mid"))
    joined = asof_join(
        rows, stats, names, right_tie="trade_id", tolerance_s=tolerance_s, spine=spine
    ).drop("r_us")
    impact = [(s, k) for s, k in impact if s in windows_s]
    cut = chunked(
        joined, BOOK, rows_back=max([k for _, k in impact], default=1), spine=spine
    )
    w = BOOK.window()
    out: list[Column] = []
    m = F.col("mid")
    for s in windows_s:
        out += [
            F.col(f"trade_imbalance_{s}s"),
            F.col(f"buy_share_{s}s"),
            F.log1p(f"trade_count_{s}s").alias(f"log_trade_count_{s}s"),
            F.log1p(f"trade_volume_{s}s").alias(f"log_trade_volume_{s}s"),
            ((F.col(f"trade_vwap_{s}s") - m) / m * BP).alias(f"vwap_dev_bp_{s}s"),
            (F.col(f"trade_price_std_{s}s") / m * BP).alias(f"trade_disp_bp_{s}s"),
        ]
    for s, k in impact:
        flow = ratio(f"signed_volume_{s}s", f"trade_volume_{s}s")
        move = bp_change(m, F.lag("mid", k).over(w))
        out.append((move / F.when(F.abs(flow) > 1e-9, flow)).alias(f"impact_{s}s"))
    return own(cut.select(*KEYS, "_chunk", "_own", *out))


FLOW_WINDOWS = (6, 24, 120)


def flow_features(
    buckets: DataFrame,
    windows: Sequence[int] = FLOW_WINDOWS,
    *,
    layout: Layout = BOOK,
    spine: DataFrame | None = None,
) -> DataFrame:
    """Eleven trailing summaries of aggressive trading on bucketed prints."""
    short, middle, long = windows
    layout = array_layout(layout)
    cut = chunked(buckets, layout, rows_back=long, spine=spine)
    read = [
        "buy_volume", "sell_volume", "trade_count", "signed_notional", "traded_notional", "largest_trade", "vwap_deviation_bp",
    ]
    names = [f"{c}_{n}" for n in windows for c in ("flow_imbalance", "trade_intensity")]
    names += ["volume_surge", "trade_concentration", "trade_size_shock", "vwap_deviation_bp", f"flow_persistence_{middle}"]

    def made(arrays: Arrays) -> Arrays:
        def sums(x: np.ndarray, spans: Sequence[int]) -> dict[int, tuple[np.ndarray, ...]]:
            there = ~np.isnan(x)
            return rolled((there.astype(float), np.where(there, x, 0.0)), spans)

        buys, sells, counts = (sums(arrays[c], windows) for c in ("buy_volume", "sell_volume", "trade_count"))
        traded = {n: known(p) for n, p in sums(arrays["traded_notional"], windows).items()}
        largest = rolled((np.nan_to_num(arrays["largest_trade"], nan=-np.inf),), [middle], lambda a, b: (np.maximum(a[0], b[0]),))
        n, signs = sums(np.sign(arrays["signed_notional"]), [middle])[middle]
        out: dict[str, np.ndarray] = {}
        with np.errstate(invalid="ignore", divide="ignore"):
            for k in windows:
                buy, sell = known(buys[k]), known(sells[k])
                out[f"flow_imbalance_{k}"] = np.where(buy + sell > 0, (buy - sell) / (buy + sell), 0.0)
                out[f"trade_intensity_{k}"] = np.where(counts[k][0] > 0, counts[k][1] / counts[k][0], np.nan)
            surge = traded[short] / (traded[long] * (short / long) + 1e-12)
            out["volume_surge"] = np.where(traded[long] > 0, surge, 1.0)
            top = np.where(np.isinf(largest[middle][0]), np.nan, largest[middle][0])
            out["trade_concentration"] = np.where(traded[middle] > 0, top / traded[middle], 0.0)
            size = arrays["traded_notional"] / np.where(arrays["trade_count"] == 0, np.nan, arrays["trade_count"])
            typical = Ranked(size).quantile(*trailing(len(size), long, True), 0.5, 10)
            shock = size / np.where(typical == 0, np.nan, typical)
            out["trade_size_shock"] = np.where(np.isnan(shock), 1.0, shock)
            out["vwap_deviation_bp"] = arrays["vwap_deviation_bp"]
            out[f"flow_persistence_{middle}"] = np.where(n > 0, signs / n, np.nan)
        return out

    return in_chunks(cut, layout, KEYS, read, names, made)


# ------------------------------------------------------------------ stamp-timed features


def _mids(book: DataFrame) -> DataFrame:
    return book.select(*KEYS, ((F.col("bid_price_0") + F.col("ask_price_0")) / 2).alias("mid"))


def short_volatility(
    book: DataFrame, seconds: float = 1.0, *, spine: DataFrame | None = None
) -> DataFrame:
    """Std of simple row returns, and mean of consecutive return-sign products, over the span."""
    layout = array_layout(BOOK)
    cut = chunked(_mids(book), layout, rows_back=3, secs_back=seconds, spine=spine)
    w = layout.window()
    staged = cut.withColumn("_ret", (ratio("mid", F.lag("mid").over(w)) - 1) * BP)
    staged = staged.withColumn(
        "_prod", F.signum("_ret") * F.lag(F.signum(F.col("_ret"))).over(w)
    )
    since = 1 - round(seconds * US)
    stats = {
        "volatility_bp": ("std", "_ret", since, 0),
        "return_sign_autocorr": ("avg", "_prod", since, 0),
    }
    return stamped(staged, layout, KEYS, stats)


def log_change_std(
    book: DataFrame, seconds: float = 60.0, *, spine: DataFrame | None = None
) -> DataFrame:
    """Std of the mid's row-to-row log changes over the trailing span."""
    layout = array_layout(BOOK)
    cut = chunked(_mids(book), layout, rows_back=2, secs_back=seconds, spine=spine)
    staged = cut.withColumn("_chg", ln(ratio("mid", F.lag("mid").over(layout.window()))))
    return stamped(staged, layout, KEYS, {"sigma": ("std", "_chg", 1 - round(seconds * US), 0)})


def turn_counts(
    book: DataFrame, windows_s: Sequence[float] = (2, 5, 10), *, spine: DataFrame | None = None
) -> DataFrame:
    """Reversals of the mid with both moves inside the span.

    Both moves of the reversals follow each other in time, so those that end by a row are a beginning
    of them and those that start inside its span an end of them.
    """
    layout = array_layout(BOOK)
    cut = chunked(_mids(book), layout, rows_back=2, secs_back=max(windows_s), spine=spine)
    names = {f"turn_count_{s}s": round(s * US) for s in windows_s}

    def made(arrays: Arrays) -> Arrays:
        us = arrays["us"].astype(np.int64)
        moves = np.sign(np.diff(arrays["mid"], prepend=np.nan))
        at = np.flatnonzero(moves * moves > 0)
        turned = np.flatnonzero(moves[at[1:]] == -moves[at[:-1]])
        start, end = us[at[:-1]][turned], us[at[1:]][turned]
        done = np.searchsorted(end, us, "right")
        return {
            n: np.maximum(done - np.searchsorted(start, us - span, "right"), 0).astype(float)
            for n, span in names.items()
        }

    return in_chunks(cut, layout, KEYS, ["us", "mid"], list(names), made)


def lag_log_changes(book: DataFrame, lags_s: Sequence[float]) -> DataFrame:
    """Log change of ask, bid and mid against the last row at or before ``t - lag``."""
    mid = (F.col("bid_price_0") + F.col("ask_price_0")) / 2
    names = {"ask0": F.col("ask_price_0"), "bid0": F.col("bid_price_0"), "mid": mid}
    rows = book.select(*KEYS, *[c.alias(n) for n, c in names.items()])
    out = rows
    for s in lags_s:
        out = asof_join(
            out,
            rows,
            list(names),
            at=F.col("us") - round(s * US),
            names={n: f"_{n}_{s}" for n in names} | {"r_us": f"_at_{s}"},
            stored=s != lags_s[0],
        )
    return out.select(
        *KEYS,
        *[
            bp_change(F.col(n), F.col(f"_{n}_{s}")).alias(f"{n}_log_change_bp_{s}s")
            for n in names
            for s in lags_s
        ],
    )


def run_lengths(
    rows: DataFrame, prints: DataFrame, span_s: float = 60.0, *, spine: DataFrame | None = None
) -> DataFrame:
    """Signed length of the current one-sided run of prints inside the trailing span."""
    layout = array_layout(Layout(order=("us", "_tag", "_tie")))
    a = rows.select(
        "symbol", "us", "seq", F.lit(1).alias("_tag"), F.col("seq").alias("_tie"),
        F.lit(None).cast("int").alias("side"),
    )
    b = prints.select(
        "symbol", "us", F.lit(None).cast("long").alias("seq"), F.lit(0).alias("_tag"),
        F.col("trade_id").alias("_tie"), F.col("aggressor").cast("int").alias("side"),
    )
    cut = chunked(a.unionByName(b), layout, secs_back=span_s, spine=spine)

    def made(arrays: Arrays) -> Arrays:
        us = arrays["us"].astype(np.int64)
        known = ~np.isnan(arrays["side"])
        at, side = us[known], arrays["side"][known]
        through = np.cumsum(known)
        inside = through - np.searchsorted(at, us - round(span_s * US), "right")
        place = np.arange(len(side))
        start = np.maximum.accumulate(np.where(np.diff(side, prepend=np.nan) != 0, place, 0))
        value = np.zeros(len(us))
        rows = np.flatnonzero((inside > 0) & (through > 0))
        last = through[rows] - 1
        value[rows] = np.minimum(last - start[last] + 1, inside[rows]) * side[last]
        return {"trade_run_length": value}

    keep = [*KEYS, "_tag"]
    out = in_chunks(cut, layout, keep, ["us", "side"], ["trade_run_length"], made)
    return out.filter(F.col("_tag") == 1).drop("_tag")


def inter_trade_time(
    rows: DataFrame, prints: DataFrame, span_s: float = 60.0, *, spine: DataFrame | None = None
) -> DataFrame:
    """Seconds between the last two distinct print stamps, both inside the span."""
    layout = PRINTS
    cut = chunked(prints.select("symbol", "us", "trade_id"), layout, secs_back=span_s, spine=spine)
    w = layout.window()
    was = F.lag("us").over(w)
    moved = cut.withColumn("_was", F.when(was < F.col("us"), was))
    earlier = F.last("_was", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    prints_before = own(
        moved.select(
            "symbol", "us", "trade_id", "_chunk", "_own",
            F.when(earlier >= F.col("us") - round(span_s * US), earlier).alias("prev"),
        )
    )
    near = asof_join(
        rows.select(*KEYS), prints_before, ["prev"], right_tie="trade_id", tolerance_s=span_s, spine=spine
    )
    inside = F.col("prev") > F.col("us") - round(span_s * US)
    return near.select(
        *KEYS, F.when(inside, (F.col("r_us") - F.col("prev")) / US).alias("inter_trade_time_s")
    )


def time_since_trade(
    rows: DataFrame, prints: DataFrame, cap_s: float = 60.0, *, spine: DataFrame | None = None
) -> DataFrame:
    """Seconds since the last print, at most ``cap_s``."""
    near = asof_join(
        rows.select(*KEYS), prints, [], right_tie="trade_id", tolerance_s=cap_s, spine=spine
    )
    age = (F.col("us") - F.col("r_us")) / US
    return near.select(
        *KEYS, F.least(F.coalesce(age, F.lit(cap_s)), F.lit(cap_s)).alias("time_since_trade_s")
    )


def winsorise(
    rows: DataFrame,
    value: str,
    seconds: float = 3600.0,
    quantiles: tuple[float, float] = (0.001, 0.999),
    *,
    layout: Layout = BOOK,
    spine: DataFrame | None = None,
) -> DataFrame:
    """Clip at quantiles of the trailing span, row included.

    A frame may hold tens of thousands of rows, where a sorted sliding window (pandas, one chunk
    at a time) costs O(log n) a row and a recomputed frame O(n).
    """
    cut = chunked(rows.select(*KEYS, value), layout, secs_back=seconds, spine=spine)
    low, high = quantiles

    def clipped(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(layout.order), kind="stable")
        series = pd.Series(
            frame[value].to_numpy(), index=pd.to_datetime(frame["us"].to_numpy(), unit="us")
        )
        window = series.rolling(pd.Timedelta(seconds=seconds))
        bounded = series.clip(window.quantile(low), window.quantile(high))
        frame[value] = bounded.to_numpy()
        return frame.loc[frame["_own"], [*KEYS, value]]

    schema = f"symbol string, us bigint, seq bigint, {value} double"
    return cut.groupBy(*layout.key, "_chunk").applyInPandas(clipped, schema)


def ewm_rows(span: int, tolerance: float = 1e-17) -> int:
    """Rows after which an exponential weight falls below ``tolerance``."""
    return math.ceil(math.log(tolerance) / math.log(1.0 - 2.0 / (span + 1)))


def ewm(
    rows: DataFrame,
    values: Sequence[str],
    spans: Sequence[int],
    *,
    layout: Layout = BOOK,
    spine: DataFrame | None = None,
) -> DataFrame:
    """Exponential means (``adjust=False``), missing until ``span`` rows have passed.

    Each chunk is warmed up on the rows before it until an older row's weight is below one unit
    in the last place of a double, so the cut leaves no trace.
    """
    names = [(v, s, f"{v}_ewm{s}") for v in values for s in spans]
    layout = array_layout(layout, len(names))
    cut = chunked(rows.select(*KEYS, *values), layout, rows_back=ewm_rows(max(spans)), spine=spine)

    def smooth(arrays: Arrays) -> Arrays:
        return {n: pd.Series(arrays[v]).ewm(span=s, adjust=False, min_periods=s).mean().to_numpy() for v, s, n in names}

    return in_chunks(cut, layout, KEYS, list(values), [n for _, _, n in names], smooth)


def per_second(
    book: DataFrame, half_life_s: float = 60.0, seconds: float = 1.0
) -> DataFrame:
    """Mid at each boundary of the day and half-life volatility of its changes.

    Keyed by (symbol, day): the grid has a fixed number of boundaries a day.
    """
    from tickloom.operators.grid import boundary_grid

    mids = _mids(book)
    grid = boundary_grid(mids, seconds, ["mid"])

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        frame = frame.sort_values("us")
        change = np.log(frame["mid"]).diff()
        variance = (change**2).ewm(halflife=half_life_s, adjust=False, ignore_na=True).mean()
        frame["vol_bp"] = np.sqrt(variance * 60.0) * 1e4
        return frame[["symbol", "us", "mid", "vol_bp"]]

    return grid.groupBy("symbol", "day").applyInPandas(
        fold, "symbol string, us bigint, mid double, vol_bp double"
    )


# --------------------------------------------------------------------------- generated set


def base_quantities(book: DataFrame) -> DataFrame:
    """The raw series every generated column is expanded from."""
    bid, ask = F.col("bid_price_0"), F.col("ask_price_0")
    bs, az = F.col("bid_size_0"), F.col("ask_size_0")
    mid, total = (bid + ask) / 2, bs + az
    # the size-weighted price less mid: exactly 0 where sizes agree or the spread is none
    lean = (ask - bid) * (bs - az)
    return book.select(
        *KEYS,
        mid.alias("mid"),
        ln(mid).alias("log_mid"),
        (ratio(ask - bid, mid) * BP).alias("spread_bp"),
        ratio(bs - az, total).alias("queue_imbalance"),
        F.log1p(bs).alias("log_bid_size"),
        F.log1p(az).alias("log_ask_size"),
        F.log1p(total).alias("log_total_size"),
        ln(ratio(bs, az)).alias("log_size_ratio"),
        (ratio(lean, mid * total * 2) * BP).alias("microprice_dev_bp"),
    )


LEVEL_COLUMNS = ("spread_bp", "queue_imbalance", "microprice_dev_bp")
DIFF_COLUMNS = ("log_mid", "log_bid_size", "log_ask_size", "log_total_size")


def expand(
    base: DataFrame,
    *,
    windows: Sequence[int] = (5, 10, 20, 50, 100, 200, 500, 1000),
    lags: Sequence[int] = (1, 5, 20, 50),
    levels: Sequence[str] = LEVEL_COLUMNS,
    diffs: Sequence[str] = DIFF_COLUMNS,
    layout: Layout = BOOK,
    spine: DataFrame | None = None,
) -> DataFrame:
    """Lags, changes, rolling means, deviations and z-scores, from arrays of a chunk's rows."""
    names: list[str] = []
    for c in levels:
        names += [c, *[f"{c}_{k}{n}" for n in lags for k in ("lag", "chg")], *[f"{c}_{k}{n}" for n in windows for k in ("mean", "std")]]
    for c in diffs:
        names += [f"{c}_ret{n}" for n in lags] + [f"{c}_{k}{n}" for n in windows for k in ("vol", "drift", "absmean")]
    names += [f"{c}_z{n}" for c in levels for n in windows]
    layout = array_layout(layout, len(names))
    back = max([*windows, *lags]) + 2
    cut = chunked(base.select(*KEYS, *dict.fromkeys([*levels, *diffs])), layout, rows_back=back, spine=spine)

    def made(arrays: Arrays) -> Arrays:
        out: dict[str, np.ndarray] = {}
        with np.errstate(invalid="ignore", divide="ignore"):
            for name in levels:
                x = out[name] = arrays[name]
                for k in lags:
                    was = before(x, k)
                    out[f"{name}_lag{k}"], out[f"{name}_chg{k}"] = was, x - was
                for n, parts in rolled(moments(x), windows, merged).items():
                    m, s = known(parts, n), deviation(parts, n)
                    out[f"{name}_mean{n}"], out[f"{name}_std{n}"] = m, s
                    out[f"{name}_z{n}"] = np.where(s == 0, 0.0, (x - m) / s)
            for name in diffs:
                x, scale = arrays[name], BP if name == "log_mid" else 1.0
                for k in lags:
                    out[f"{name}_ret{k}"] = (x - before(x, k)) * scale
                step = x - before(x)
                size = np.abs(step)
                sizes = rolled(((~np.isnan(size)).astype(float), np.nan_to_num(size, nan=0.0)), windows, added)
                for n, parts in rolled(moments(step), windows, merged).items():
                    out[f"{name}_vol{n}"] = deviation(parts, n) * scale
                    out[f"{name}_drift{n}"] = known(parts, n) * scale
                    out[f"{name}_absmean{n}"] = known(sizes[n], n) / n * scale
        return out

    return in_chunks(cut, layout, KEYS, list(dict.fromkeys([*levels, *diffs])), names, made)


def time_of_day(rows: DataFrame) -> DataFrame:
    """Sine and cosine of the time of day and of the weekday (Monday 0), UTC."""
    day_us = 86_400 * US
    seconds = F.floor(F.pmod(F.col("us"), F.lit(day_us)) / F.lit(US))
    part = seconds / 86_400.0 * (2 * math.pi)
    weekday = F.pmod(F.floor(F.col("us") / F.lit(day_us)) + 3, F.lit(7)) / 7.0 * (2 * math.pi)
    return rows.select(
        *KEYS,
        F.sin(part).alias("tod_sin"),
        F.cos(part).alias("tod_cos"),
        F.sin(weekday).alias("dow_sin"),
        F.cos(weekday).alias("dow_cos"),
    )


def generate(
    book: DataFrame,
    trades: DataFrame | None = None,
    *,
    windows: Sequence[int] = (5, 10, 20, 50, 100, 200, 500, 1000),
    lags: Sequence[int] = (1, 5, 20, 50),
    trade_windows_s: Sequence[float] = DEFAULT_WINDOWS_S,
    tolerance_s: float = 60,
    include_time: bool = True,
    spine: DataFrame | None = None,
) -> DataFrame:
    """The whole generated set for the book rows (price levels themselves are left out)."""
    base = base_quantities(book)
    out = expand(base, windows=windows, lags=lags, spine=spine)
    out = out.join(ewm(base, LEVEL_COLUMNS, windows, spine=spine), list(KEYS))
    if trades is not None:
        flows = trade_features(
            book, trades, trade_windows_s, tolerance_s=tolerance_s, impact=(), spine=spine
        )
        out = out.join(flows, list(KEYS))
    if include_time:
        out = out.join(time_of_day(book), list(KEYS))
    return out


def day_features(
    rows: DataFrame, first_us: int, tail_s: float, build, *, last_us: int | None = None
) -> DataFrame:
    """Features of one day from its rows and the history tail they look back on."""
    last = first_us + 86_400 * US if last_us is None else last_us
    span = rows.filter((F.col("us") >= first_us - round(tail_s * US)) & (F.col("us") < last))
    return build(span).filter(F.col("us") >= first_us)

