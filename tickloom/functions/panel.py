"""Cross-sectional, positioning and normalised features on long panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import BP, clip, corr, ln, ratio, rolling
from tickloom.operators.asof import asof_join
from tickloom.operators.chunks import BARS, BOOK, Layout, chunked, own
from tickloom.operators.ranges import Arrays, Ranked, in_chunks, trailing

IQR = 1.349  # fixed value: a normal's interquartile range in standard deviations


def average_rank(value: Column | str, scope: Sequence[str], *, descending: bool = False) -> Column:
    """Rank in which ties share their mean place. One row per member of ``scope`` groups."""
    v = F.col(value) if isinstance(value, str) else value
    order = v.desc() if descending else v.asc()
    lowest = F.rank().over(Window.partitionBy(*scope).orderBy(order))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*scope, v))
    return lowest + (ties - 1) / 2.0


def leaders(prices: DataFrame) -> DataFrame:
    """Each symbol's leader: the first other name (one row per instrument)."""
    names = prices.select("symbol").distinct()
    two = names.agg(F.array_sort(F.collect_set("symbol")).alias("n"))
    return names.join(F.broadcast(two)).select(  # one row
        "symbol", F.when(F.col("symbol") == F.col("n")[0], F.col("n")[1]).otherwise(F.col("n")[0]).alias("leader")
    )


def cross_features(
    prices: DataFrame,
    *,
    windows: Sequence[int] = (6, 24, 120),
    beta_window: int = 1200,
    layout: Layout = BARS,
) -> DataFrame:
    """Leader and index comparisons from ``(symbol, us, log_price)`` on a common clock.

    The index and the dispersion leave the instrument itself out.
    """
    lead = leaders(prices)
    theirs = prices.select(
        "us", F.col("symbol").alias("leader"), F.col("log_price").alias("lead_log")
    )
    paired = prices.join(lead, "symbol").join(theirs, ["us", "leader"], "left")
    cut = chunked(paired, layout, rows_back=max(*windows, beta_window) + 1, spine=prices)
    w = layout.window()
    own_log, lead_log = F.col("log_price"), F.col("lead_log")
    moves: list[Column] = []
    for n in windows:
        moves += [
            ((own_log - F.lag(own_log, n).over(w)) * BP).alias(f"own_{n}"),
            ((lead_log - F.lag(lead_log, n).over(w)) * BP).alias(f"leader_return_{n}"),
        ]
    steps = cut.select(
        "*",
        *moves,
        ((own_log - F.lag(own_log).over(w)) * BP).alias("_a"),
        ((lead_log - F.lag(lead_log).over(w)) * BP).alias("_b"),
    )
    frame = w.rowsBetween(-(beta_window - 1), 0)
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    enough = F.count(F.when(both, 1)).over(frame) >= beta_window // 4
    cov, var = F.covar_samp("_a", "_b").over(frame), F.var_samp("_b").over(frame)
    beta = clip(F.when(enough & (var > 0), cov / var), -5.0, 5.0)
    per_symbol = own(
        steps.select(
            "symbol",
            "us",
            "_chunk",
            "_own",
            *[f"own_{n}" for n in windows],
            *[f"leader_return_{n}" for n in windows],
            beta.alias("beta_to_leader"),
        )
    )
    at = Window.partitionBy("us")
    out: list[Column] = []
    for n in windows:
        x = F.col(f"own_{n}")
        count, total, squares = (
            F.count(x).over(at),
            F.sum(x).over(at),
            F.sum(x * x).over(at),
        )
        others = count - F.when(x.isNotNull(), 1).otherwise(0)
        rest = total - F.coalesce(x, F.lit(0.0))
        rest_sq = squares - F.coalesce(x * x, F.lit(0.0))
        index = ratio(rest, others)
        var_n = ratio(rest_sq - rest * rest / F.nullif(others, F.lit(0).cast("long")), others - 1)
        ranked = F.when(x.isNotNull(), average_rank(x, ["us"]) / count)
        out += [
            F.col(f"leader_return_{n}"),
            index.alias(f"index_return_{n}"),
            (F.col(f"leader_return_{n}") - x).alias(f"catch_up_leader_{n}"),
            (index - x).alias(f"catch_up_index_{n}"),
            F.when(var_n.isNotNull(), F.sqrt(F.greatest(var_n, F.lit(0.0)))).alias(f"dispersion_{n}"),
            ranked.alias(f"relative_rank_{n}"),
        ]
    middle, last = windows[len(windows) // 2], windows[-1]
    out += [
        F.col("beta_to_leader"),
        (F.col("beta_to_leader") * F.col(f"leader_return_{middle}") - F.col(f"own_{middle}")).alias(
            "beta_adjusted_catch_up"
        ),
        F.when(F.abs(F.col(f"own_{last}")) < 1e-8, 1.0).otherwise(0.0).alias("own_stale"),
    ]
    return per_symbol.select("symbol", "us", *out)


def trailing_z(value: np.ndarray, window: int) -> np.ndarray:
    """Robust z-score against the rows before this one."""
    ranked, (low, high) = Ranked(value), trailing(len(value), window, False)
    least = min(window, max(3, window // 4))
    first, centre, third = (ranked.quantile(low, high, q, least) for q in (0.25, 0.5, 0.75))
    spread = (third - first) / IQR
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(spread > 0, (value - centre) / spread, np.nan)


RATIOS: Mapping[str, str] = {
    "crowd": "count_long_short_ratio",
    "size": "sum_toptrader_long_short_ratio",
    "size_accounts": "count_toptrader_long_short_ratio",
    "taker": "sum_taker_long_short_vol_ratio",
}


def positioning_features(
    metrics: DataFrame,
    *,
    funding: DataFrame | None = None,
    windows: Sequence[int] = (12, 72, 288),
    funding_window: int = 288,
    layout: Layout = BARS,
) -> DataFrame:
    """Open-interest changes and positioning z-scores on the metrics' own stamps."""
    rows = metrics
    if funding is not None:
        rows = asof_join(
            metrics.withColumn("_seq", F.col("us")),
            funding,
            ["rate"],
            left_tie="_seq",
            right_tie="us",
        ).drop("_seq", "r_us")
    base = [c for c in ("sum_open_interest",) if c in metrics.columns]
    ratios = {n: c for n, c in RATIOS.items() if c in metrics.columns}
    logs = {"log_open_interest": ln(c) for c in base}
    logs |= {f"log_{n}_ratio": ln(c) for n, c in ratios.items()}
    staged = rows.select("symbol", "us", *([] if funding is None else [(F.col("rate") * BP).alias("funding_bp")]), *[c.alias(n) for n, c in logs.items()])
    if {"crowd", "size"} <= set(ratios):
        staged = staged.withColumn(
            "crowd_minus_size", F.col("log_crowd_ratio") - F.col("log_size_ratio")
        )
    cut = chunked(staged, layout, rows_back=max(*windows, funding_window) + 1)
    w = layout.window()
    plain: list[Column] = []
    scores: dict[str, tuple[str, int]] = {}
    order: list[str] = []

    def scored(name: str, stem: str, spans: Sequence[int]) -> None:
        for n in spans:
            order.append(f"{stem}_z{n}")
            scores[f"{stem}_z{n}"] = (name, n)

    if base:
        oi = F.col("log_open_interest")
        order.append("log_open_interest")
        for n in windows:
            plain.append((oi - F.lag(oi, n).over(w)).alias(f"open_interest_change_{n}"))
            order.append(f"open_interest_change_{n}")
            scored("log_open_interest", "open_interest", [n])
    for n_ in ratios:
        order.append(f"log_{n_}_ratio")
        scored(f"log_{n_}_ratio", f"{n_}_ratio", windows)
    if "crowd_minus_size" in staged.columns:
        order.append("crowd_minus_size")
        scored("crowd_minus_size", "crowd_minus_size", windows)
    if funding is not None:
        order.append("funding_bp")
        scored("funding_bp", "funding_bp", [funding_window])
    read = list(dict.fromkeys(name for name, _ in scores.values()))

    def z(arrays: Arrays) -> Arrays:
        return {name: trailing_z(arrays[c], n) for name, (c, n) in scores.items()}

    kept = ["symbol", "us", *[c for c in order if c not in scores]]
    found = in_chunks(cut.select("*", *plain), layout, kept, read, list(scores), z)
    return found.select("symbol", "us", *order)


def normalised(
    rows: DataFrame,
    columns: Sequence[str],
    *,
    window: int = 2000,
    method: str = "robust",
    limit: float = 8.0,
    least: int | None = None,
    floors: DataFrame | None = None,
    keep: Sequence[str] = ("symbol", "us", "seq"),
    layout: Layout = BOOK,
    spine: DataFrame | None = None,
) -> DataFrame:
    """Centre and scale each column on the rows before it, per instrument, and clip.

    Where the scale is zero the mean absolute deviation stands in; where that is zero too the
    value is 0. ``floors`` is one row holding a least scale per column.
    """
    need = window // 4 if least is None else least
    cut = chunked(rows.select(*keep, *columns), layout, rows_back=2 * window + 2, spine=spine)
    made = [f"_{kind}_{c}" for c in columns for kind in "msf"]

    def past(arrays: Arrays) -> Arrays:
        out: dict[str, np.ndarray] = {}
        for c in columns:
            x = arrays[c]
            if method == "robust":
                ranked, (low, high) = Ranked(x), trailing(len(x), window, False)
                first, m, third = (ranked.quantile(low, high, q, need) for q in (0.25, 0.5, 0.75))
                s = (third - first) / IQR
            else:
                before = pd.Series(x).shift(1).rolling(window, min_periods=need)
                m, s = before.mean().to_numpy(), before.std().to_numpy()
            away = pd.Series(np.abs(x - m)).shift(1).rolling(window, min_periods=need).mean()
            out |= {f"_m_{c}": m, f"_s_{c}": s, f"_f_{c}": away.to_numpy() * 1.4826}
        return out

    kept = list(dict.fromkeys([*keep, *columns]))
    widened = in_chunks(cut, layout, kept, columns, made, past)
    if floors is not None:
        least_scale = floors.select(*[F.col(c).alias(f"_least_{c}") for c in columns])
        widened = widened.join(F.broadcast(least_scale))  # one row

    def value(c: str) -> Column:
        x, m, s = F.col(c), F.col(f"_m_{c}"), F.col(f"_s_{c}")
        usable = F.when(s > 0, s).otherwise(F.col(f"_f_{c}"))
        if floors is not None:
            usable = F.greatest(usable, F.col(f"_least_{c}"))  # the floor also where no scale is known
        scaled = F.when(usable > 0, (x - m) / usable)
        filled = F.when(m.isNotNull(), F.coalesce(scaled, F.lit(0.0)))
        return clip(filled, -limit, limit).alias(c)

    return widened.select(*keep, *[value(c) for c in columns])


def scale_floors(
    rows: DataFrame,
    columns: Sequence[str],
    *,
    window: int,
    least: int | None = None,
    method: str = "robust",
    q: float = 0.10,
    share_of_median: float = 0.05,
    minimum: float = 1e-6,
    layout: Layout = BOOK,
    spine: DataFrame | None = None,
) -> DataFrame:
    """One row: per column the larger of a low quantile and a share of the median of its scales."""
    from tickloom.operators.quantiles import quantile_by

    need = window // 4 if least is None else least
    cut = chunked(rows, layout, rows_back=window, spine=spine)

    def scale(x: np.ndarray) -> np.ndarray:
        if method == "robust":
            ranked, (low, high) = Ranked(x), trailing(len(x), window, True)
            return (ranked.quantile(low, high, 0.75, need) - ranked.quantile(low, high, 0.25, need)) / IQR
        return pd.Series(x).rolling(window, min_periods=need).std().to_numpy()

    scales = in_chunks(cut, layout, [], columns, columns, lambda arrays: {c: scale(arrays[c]) for c in columns})
    out: DataFrame | None = None
    for c in columns:
        low = quantile_by(scales, [], c, q, "_low")
        middle = quantile_by(scales, [], c, 0.5, "_mid")
        one = low.join(F.broadcast(middle)).select(  # one row each
            F.greatest("_low", F.col("_mid") * share_of_median, F.lit(minimum)).alias(c)
        )
        out = one if out is None else out.join(F.broadcast(one))
    assert out is not None
    return out


# ----------------------------------------------------------------- minute cross-section


def minute_inputs(
    panel: DataFrame,
    *,
    sums: Sequence[int] = (5, 10, 30, 60),
    index_sums: Sequence[int] = (10, 60),
    vol: int = 60,
    smooth: int = 10,
    entry_lag: int = 1,
    hold: int = 60,
    taker_bp: float = 5.5,
    layout: Layout = BARS,
) -> DataFrame:
    """Inputs, relative forward return and round-trip cost from ``(symbol, us, mid, spread_bp,
    imbalance)`` on a common clock."""
    ahead = entry_lag + hold
    first = chunked(panel, layout, rows_back=1, rows_ahead=ahead)
    w = layout.window()
    log_mid = ln("mid")
    steps = own(
        first.select(
            "symbol",
            "us",
            "spread_bp",
            "imbalance",
            "_chunk",
            "_own",
            ((log_mid - F.lag(log_mid).over(w)) * BP).alias("r1"),
            ((F.lead(log_mid, ahead).over(w) - F.lead(log_mid, entry_lag).over(w)) * BP).alias(
                "fwd"
            ),
            (
                F.lead("spread_bp", entry_lag).over(w) / 2
                + F.lead("spread_bp", ahead).over(w) / 2
                + 2 * taker_bp
            ).alias("cost"),
        )
    )
    at = Window.partitionBy("us")
    crossed = steps.select(
        "*",
        F.avg("r1").over(at).alias("idx"),
        (F.col("fwd") - F.avg("fwd").over(at)).alias("target"),
    ).withColumn("rel_1", F.col("r1") - F.col("idx"))
    cut = chunked(crossed, layout, rows_back=max(*sums, vol, smooth), spine=panel)
    return own(
        cut.select(
            "symbol",
            "us",
            "_chunk",
            "_own",
            "rel_1",
            *[rolling(F.sum, "rel_1", w, k).alias(f"rel_{k}") for k in sums],
            *[rolling(F.sum, "idx", w, k).alias(f"idx_{k}") for k in index_sums],
            rolling(F.stddev_samp, "rel_1", w, vol).alias(f"vol_{vol}"),
            rolling(F.stddev_samp, "idx", w, vol).alias(f"idx_vol_{vol}"),
            "spread_bp",
            "imbalance",
            rolling(F.avg, "imbalance", w, smooth).alias(f"imbalance_{smooth}"),
            "target",
            "fwd",
            "cost",
        )
    )


def cross_section_z(rows: DataFrame, value: str, limit: float = 3.0) -> DataFrame:
    """The value as a z-score across the instruments of its stamp (population deviation)."""
    at = Window.partitionBy("us")
    mean, sd = F.avg(value).over(at), F.stddev_pop(value).over(at)
    z = (F.col(value) - mean) / F.when(sd > 0, sd).otherwise(1.0)
    return rows.withColumn(f"{value}_z", F.coalesce(clip(z, -limit, limit), F.lit(0.0)))


def training_scaler(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of means and population deviations; a flat column scales by 1."""
    moments = rows.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}_sd") for c in columns],
    )
    return moments.select(
        *[F.col(f"{c}_mean") for c in columns],
        *[F.when(F.col(f"{c}_sd") > 0, F.col(f"{c}_sd")).otherwise(1.0).alias(f"{c}_sd") for c in columns],
    )


def scaled(rows: DataFrame, scaler: DataFrame, columns: Sequence[str], limit: float = 5.0) -> DataFrame:
    """Standardised, clipped inputs; a missing one becomes 0."""
    joined = rows.join(F.broadcast(scaler))  # one row
    rest = [c for c in rows.columns if c not in columns]

    def z(c: str) -> Column:
        score = (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd")
        return F.coalesce(clip(score, -limit, limit), F.lit(0.0)).alias(c)

    return joined.select(*rest, *[z(c) for c in columns])


# ----------------------------------------------------------------------- monthly features


def monthly_features(daily: DataFrame, history: int = 3) -> DataFrame:
    """A coin's month from the months before it, from ``(coin, day, month, spot, perp, rate)``.

    Funding a day over the last month and the last ``history``; its trend, deviation and share
    positive; basis; returns; volatility; and the month's own funding a day as the target.
    """
    by_day = Window.partitionBy("coin").orderBy("day")
    steps = daily.select(
        "*",
        ((F.col("perp") / F.col("spot") - 1) * BP).alias("basis"),
        ln(ratio("spot", F.lag("spot").over(by_day))).alias("step"),
        (F.lag("month").over(by_day) == F.col("month")).alias("same"),
        F.last_day("month").alias("last_day"),
    )
    months = steps.groupBy("coin", "month").agg(
        F.sum(F.col("rate") * BP).alias("paid"),
        F.sum(F.pow(F.col("rate") * BP, 2)).alias("paid_sq"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("rate") > 0).alias("pos"),
        F.avg("basis").alias("basis_1"),
        F.avg(F.when(F.col("day") == F.col("last_day"), F.col("basis"))).alias("basis_end"),
        F.min_by("spot", "day").alias("spot_first"),
        F.max_by("spot", "day").alias("spot_last"),
        F.stddev_samp(F.when(F.col("same"), F.col("step"))).alias("vol"),
    ).withColumn("days", F.day(F.last_day("month")))
    w = Window.partitionBy("coin").orderBy("month")
    past = w.rowsBetween(-history, -1)

    def back(c: str, k: int = 1) -> Column:
        return F.lag(c, k).over(w)

    n3, sum3, sq3 = F.sum("n").over(past), F.sum("paid").over(past), F.sum("paid_sq").over(past)
    rows = months.select(
        "coin",
        "month",
        F.row_number().over(w).alias("_k"),
        (back("paid") / back("days")).alias("f1"),
        (sum3 / F.sum("days").over(past)).alias("f3"),
        F.sqrt((sq3 - sum3 * sum3 / n3) / (n3 - 1)).alias("f_sd"),
        (F.sum("pos").over(past) / n3).alias("f_pos"),
        back("basis_1").alias("basis_1"),
        back("basis_end").alias("basis_end"),
        ln(ratio(back("spot_last"), back("spot_first"))).alias("ret_1"),
        ln(ratio(back("spot_last"), back("spot_first", history))).alias("ret_3"),
        (back("vol") * BP).alias("vol_1"),
        (F.col("paid") / F.col("days")).alias("target"),
    ).filter(F.col("_k") > history)
    at = Window.partitionBy("month")
    # Sums that differ only by the order they were added in are ties.
    rank = average_rank(F.round("f3", 9), ["month"]) / F.count(F.lit(1)).over(at)
    return rows.select(
        "coin",
        "month",
        "f1",
        "f3",
        (F.col("f1") - F.col("f3")).alias("f_trend"),
        "f_sd",
        "f_pos",
        "basis_1",
        "basis_end",
        "ret_1",
        "ret_3",
        "vol_1",
        rank.alias("rank_f3"),
        "target",
    )


# --------------------------------------------------------------------- index statistics


def index_level(prices: DataFrame) -> DataFrame:
    """Equal-weighted log index per stamp, and each instrument's index without itself."""
    at = Window.partitionBy("us")
    total, n = F.sum("log_price").over(at), F.count("log_price").over(at)
    return prices.select(
        "symbol",
        "us",
        "log_price",
        (total / n).alias("index"),
        ratio(total - F.col("log_price"), n - 1).alias("index_without"),
    )


def index_autocorrelation(index: DataFrame, lag: int, layout: Layout = BARS) -> DataFrame:
    """One row per key: correlation of the index's past ``lag``-row return with its next."""
    cut = chunked(index, layout, rows_back=lag, rows_ahead=lag)
    w = layout.window()
    x = F.col("index")
    pairs = own(
        cut.select(
            "symbol",
            "_chunk",
            "_own",
            ((x - F.lag(x, lag).over(w)) * BP).alias("past"),
            ((F.lead(x, lag).over(w) - x) * BP).alias("next"),
        )
    )
    return pairs.groupBy("symbol").agg(corr("past", "next").alias("autocorrelation"))


def trailing_autocorrelation(
    index: DataFrame,
    lag: int,
    window_rows: int,
    rows_per_day: int,
    *,
    least: int = 500,
    known_at_open: bool = False,
    layout: Layout = BARS,
) -> DataFrame:
    """Per day of rows: the autocorrelation over the ``window_rows`` rows before the day.

    Each row is sent to the few days whose window holds it; the correlation is then an ordinary
    aggregate. ``known_at_open`` moves the window ``lag`` rows back, so every pair had ended.
    """
    from tickloom.operators.chunks import numbered

    placed = numbered(index, layout, "_row").withColumn("_row", F.col("_row") - 1)
    cut = chunked(placed, layout, rows_back=lag, rows_ahead=lag, spine=index)
    w = layout.window()
    x = F.col("index")
    pairs = own(
        cut.select(
            "symbol",
            "_row",
            "_chunk",
            "_own",
            ((x - F.lag(x, lag).over(w)) * BP).alias("past"),
            ((F.lead(x, lag).over(w) - x) * BP).alias("next"),
        )
    )
    shift = lag if known_at_open else 0
    # Day d starts at row s = window_rows + d * rows_per_day and reads [s - window - shift, s - shift).
    first = F.greatest(
        F.floor((F.col("_row") + shift - window_rows) / F.lit(rows_per_day)) + 1, F.lit(0)
    )
    last = F.floor((F.col("_row") + shift) / F.lit(rows_per_day))
    usable = pairs.filter("past IS NOT NULL AND next IS NOT NULL").select(
        "symbol", "past", "next", first.cast("long").alias("_d0"), last.cast("long").alias("_d1")
    )
    spread = usable.filter("_d0 <= _d1").select(
        "symbol", "past", "next", F.explode(F.sequence("_d0", "_d1")).alias("d")
    )
    days = placed.groupBy("symbol").agg(F.max("_row").alias("_last"))
    fitted = spread.groupBy("symbol", "d").agg(
        F.count(F.lit(1)).alias("pairs"), corr("past", "next").alias("autocorrelation")
    )
    start = F.col("d") * rows_per_day + window_rows
    return (
        fitted.join(days, "symbol")
        .filter((F.col("pairs") >= least) & (start <= F.col("_last")))
        .select("symbol", "d", start.alias("start_row"), "pairs", "autocorrelation")
    )
