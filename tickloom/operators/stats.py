"""Whether a result is luck: clusters, multiple testing, placebos, neighbourhoods, overfitting."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import corr, ratio
from tickloom.functions.distributions import normal_cdf, normal_quantile, t_upper_tail
from tickloom.functions.panel import average_rank
from tickloom.session import materialised

EULER_GAMMA = 0.5772156649015329  # fixed value
T_BAR = 3.0
POWER_Z = 0.84  # fixed value: normal quantile of 80 % power


def t_stat(x: Column) -> Column:
    """Mean over its standard error; an aggregate. NULL with fewer than two or no dispersion."""
    return ratio(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x)))


def cluster_means(trades: DataFrame, cluster: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    return trades.groupBy(*by, cluster).agg(F.avg(value).alias("cluster_mean"))


def pair_correlations(panel: DataFrame, series: str, cluster: str, value: str) -> DataFrame:
    """Correlation of every pair of series over their common clusters.

    ``panel`` has one row per (series, cluster): the pairs are instruments, a short list.
    """
    a = panel.select(cluster, F.col(series).alias("a"), F.col(value).alias("x"))
    b = panel.select(cluster, F.col(series).alias("b"), F.col(value).alias("y"))
    return a.join(b, cluster).filter("a < b").groupBy("a", "b").agg(corr("x", "y").alias("corr"))


def effective_count(n: Column, correlation: Column) -> Column:
    """Independent observations among ``n`` correlated ones."""
    r = F.greatest(F.lit(0.0), F.least(correlation, F.lit(0.999)))
    return F.when(correlation.isNull(), n.cast("double")).otherwise(n / (F.lit(1.0) + (n - 1) * r))


def assess(
    trades: DataFrame, *, value: str = "net_bp", cluster: str = "day", series: str = "series"
) -> DataFrame:
    """One row: mean and t by trade and by cluster, correlation and effective count."""
    by_trade = trades.agg(
        F.count(F.lit(1)).alias("trades"),
        F.avg(value).alias("trade_mean_bp"),
        t_stat(F.col(value)).alias("trade_t"),
        F.count_distinct(series).alias("members"),
    )
    clusters = cluster_means(trades, cluster, value).agg(
        F.count(F.lit(1)).alias("clusters"),
        F.avg("cluster_mean").alias("cluster_mean_bp"),
        t_stat(F.col("cluster_mean")).alias("cluster_t"),
        F.count_if(F.col("cluster_mean") > 0).alias("positive_clusters"),
    )
    panel = trades.groupBy(series, cluster).agg(F.avg(value).alias("_v"))
    corr = pair_correlations(panel, series, cluster, "_v").agg(F.avg("corr").alias("correlation"))
    joined = by_trade.join(F.broadcast(clusters)).join(F.broadcast(corr))  # one row each
    return joined.withColumn(
        "effective_per_cluster", effective_count(F.col("members"), F.col("correlation"))
    )


def newey_west(daily: DataFrame, key: Sequence[str], value: str, day: str, lag: int = 5) -> DataFrame:
    """Mean, Bartlett standard error and t of a daily series per key (days are few)."""
    keys = list(key)
    known = daily.filter(F.col(value).isNotNull())
    facts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("days"), F.avg(value).alias("mean"))
    joined = known.join(facts, keys).withColumn("_c", F.col(value) - F.col("mean"))
    w = Window.partitionBy(*keys).orderBy(day)
    lagged = joined.select(
        *keys, "days", "mean", "_c", *[F.lag("_c", k).over(w).alias(f"_l{k}") for k in range(1, lag + 1)]
    )
    sums = lagged.groupBy(*keys, "days", "mean").agg(
        F.sum(F.col("_c") * F.col("_c")).alias("_g0"),
        *[F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_g{k}") for k in range(1, lag + 1)],
    )
    used = F.least(F.lit(lag), F.col("days") - 1)
    variance = F.col("_g0") / F.col("days")
    for k in range(1, lag + 1):
        weight = F.lit(1.0) - F.lit(k) / (used + 1.0)
        term = F.coalesce(F.col(f"_g{k}"), F.lit(0.0)) / F.col("days") * weight * 2
        variance = variance + F.when(F.lit(k) <= used, term).otherwise(F.lit(0.0))
    se = F.when((F.col("days") >= 2) & (variance > 0), F.sqrt(variance / F.col("days")))
    return sums.select(*keys, "days", "mean", se.alias("se"), (F.col("mean") / se).alias("t"))


def minimum_detectable_effect(sigma: Column, n_eff: Column, bar: float = T_BAR) -> Column:
    return sigma * (bar + POWER_Z) / F.sqrt(F.when(n_eff > 0, n_eff))


def power_at_bar(effect: Column, sigma: Column, n_eff: Column, bar: float = T_BAR) -> Column:
    return normal_cdf(ratio(effect * F.sqrt(n_eff), sigma) - bar)


def day_t(daily: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Per key: days, mean, deviation, t, one-sided p, positive days."""
    out = daily.filter(F.col(value).isNotNull()).groupBy(*key).agg(
        F.count(F.lit(1)).alias("days"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.count_if(F.col(value) > 0).alias("positive_days"),
    )
    t = ratio("mean", F.col("sd") / F.sqrt("days"))
    return out.withColumn("t", t).withColumn(
        "p_one_sided", F.when(F.col("t").isNotNull(), t_upper_tail(F.col("t"), F.col("days") - 1))
    )


def sharpe_table(daily: DataFrame, key: str, value: str) -> DataFrame:
    """Per trial: days, Sharpe ratio a day, population skewness and kurtosis (not excess)."""
    return daily.groupBy(key).agg(
        F.count(value).alias("days"),
        ratio(F.avg(value), F.stddev_samp(value)).alias("sharpe"),
        F.skewness(value).alias("skewness"),
        (F.kurtosis(value) + 3).alias("kurtosis"),
    )


def expected_maximum(n: Column, variance: Column) -> Column:
    """Expected best Sharpe ratio of ``n`` trials of no skill."""
    first = normal_quantile(F.lit(1.0) - F.lit(1.0) / n)
    second = normal_quantile(F.lit(1.0) - F.lit(1.0) / (n * math.e))
    value = F.sqrt(variance) * (first * (1 - EULER_GAMMA) + second * EULER_GAMMA)
    return F.when(n <= 1, F.lit(0.0)).otherwise(value)


def deflated_sharpe(table: DataFrame) -> DataFrame:
    """Every trial's Sharpe ratio against the best expected of as many null trials."""
    facts = table.agg(F.count("sharpe").alias("_n"), F.var_samp("sharpe").alias("_v"))
    bench = expected_maximum(F.col("_n").cast("double"), F.col("_v"))
    joined = table.join(F.broadcast(facts.select(bench.alias("benchmark"))))  # one row
    s = F.col("sharpe")
    spread = F.lit(1.0) - F.col("skewness") * s + (F.col("kurtosis") - 1) / 4 * s * s
    z = (s - F.col("benchmark")) * F.sqrt(F.col("days") - 1) / F.sqrt(F.when(spread > 0, spread))
    scored = joined.withColumn("_z", z)
    return scored.select(*table.columns, "benchmark", normal_cdf(F.col("_z")).alias("dsr"))


def minimum_track_record(table: DataFrame, threshold: float = 0.0, confidence: float = 0.95) -> DataFrame:
    """Days a series must run before its Sharpe ratio clears the threshold; NULL when it does not."""
    s = F.col("sharpe")
    spread = F.lit(1.0) - F.col("skewness") * s + (F.col("kurtosis") - 1) / 4 * s * s
    z = normal_quantile(F.lit(confidence))
    need = F.lit(1.0) + spread * F.pow(z / (s - threshold), 2)
    return table.withColumn("minimum", F.when((s > threshold) & (spread > 0), need))


def adjusted_p(rows: DataFrame, p: str, scope: Sequence[str] = ()) -> DataFrame:
    """Bonferroni, Holm and BHY adjusted p-values; a missing p counts in the family and stays missing.

    One row per hypothesis: a family is a list of trials, not of trades.
    """
    by = Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col(p).asc_nulls_last(), *[c for c in rows.columns if c not in (p, *scope)])
    down = order.rowsBetween(Window.unboundedPreceding, 0)
    up = order.rowsBetween(0, Window.unboundedFollowing)
    m, rank = F.count(F.lit(1)).over(by), F.row_number().over(order)
    staged = rows.select("*", m.alias("_m"), rank.alias("_r"))
    value = F.col(p)
    steps = staged.select(
        "*",
        (value * (F.col("_m") - F.col("_r") + 1)).alias("_h"),
        (value * F.col("_m") / F.col("_r")).alias("_b"),
        F.sum(F.lit(1.0) / F.col("_r")).over(by).alias("_c"),
    )
    known = value.isNotNull()
    return steps.select(
        *rows.columns,
        F.when(known, F.least(value * F.col("_m"), F.lit(1.0))).alias("bonferroni"),
        F.when(known, F.least(F.max("_h").over(down), F.lit(1.0))).alias("holm"),
        F.when(known, F.least(F.min("_b").over(up) * F.col("_c"), F.lit(1.0))).alias("bhy"),
    )


def family_holm(found: DataFrame, family: DataFrame, name: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Holm over the whole registered family; an absent member enters with p = 1."""
    filled = family.join(found, name, "left").select(
        name, F.coalesce(F.col(p), F.lit(1.0)).alias("p_value")
    )
    return adjusted_p(filled, "p_value").select(
        name, "p_value", (F.col("holm") <= alpha).alias("passes")
    )


def haircut_sharpe(table: DataFrame) -> DataFrame:
    """Sharpe ratios after Holm over the trials, turned back into Sharpe ratios."""
    t = F.abs(F.col("sharpe") * F.sqrt("days"))
    p = normal_cdf(-t) * 2
    adjusted = adjusted_p(table.withColumn("p_value", p), "p_value")
    cut = -normal_quantile(F.when(F.col("holm") < 1, F.col("holm") / 2)) / F.sqrt("days")
    return adjusted.withColumn("adjusted_sharpe", F.coalesce(cut, F.lit(0.0)))


# -------------------------------------------------------------------- overfitting


def split_masks(blocks: int) -> list[str]:
    """Every choice of half the blocks, as a string of 1 (in-sample) and 0."""
    return [
        "".join("1" if b in chosen else "0" for b in range(blocks))
        for chosen in itertools.combinations(range(blocks), blocks // 2)
    ]


def block_of(position: Column, days: Column, blocks: int) -> Column:
    """Block of a day position when days are cut into near-equal runs, longer ones first."""
    size, extra = F.floor(days / blocks), F.pmod(days, F.lit(blocks))
    edge = extra * (size + 1)
    return (
        F.when(position < edge, F.floor(position / (size + 1)))
        .otherwise(extra + F.floor((position - edge) / size))
        .cast("int")
    )


def pbo_splits(cells: DataFrame, key: str, day: str, value: str, blocks: int = 10) -> DataFrame:
    """Per split: the in-sample best trial and the logit of its out-of-sample rank.

    A trial is one row of block sums, and a batch of trials times the 0/1 matrix of all splits gives their
    means inside and outside at once: no row is repeated per split. A first pass keeps the best trial of
    each batch and split, a second counts the trials below the chosen one and equal to it; both leave one
    row a batch and split, so what is collected is one line a split.
    """
    days = cells.select(day).distinct()
    order = Window.partitionBy(F.lit(0)).orderBy(day)  # one row per calendar day
    placed = days.select(day, (F.row_number().over(order) - 1).alias("_i"))
    total = days.agg(F.count(F.lit(1)).alias("_n"))
    dated = placed.join(F.broadcast(total)).select(  # one row
        day, block_of(F.col("_i"), F.col("_n"), blocks).alias("_block")
    )
    dated = materialised(dated)
    length = {r["_block"]: r["n"] for r in dated.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = [f"_v{b}" for b in range(blocks)]
    vectors = cells.join(dated, day).groupBy(key).agg(
        *[F.coalesce(F.sum(F.when(F.col("_block") == b, F.col(value))), F.lit(0.0)).alias(names[b]) for b in range(blocks)]
    )
    vectors = materialised(vectors)
    masks = split_masks(blocks)
    inside = np.array([[c == "1" for c in m] for m in masks], dtype=float)
    size = np.array([float(length.get(b, 0)) for b in range(blocks)])

    def means(batch: pd.DataFrame, chosen: np.ndarray) -> np.ndarray:
        # Sums that differ only by the order they were added in are ties.
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.round(batch[names].to_numpy() @ chosen.T / (chosen @ size), 9)

    def leaders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values(key)
            a = means(batch, inside)
            at = a.argmax(axis=0)
            b = means(batch, 1 - inside)[at, np.arange(len(masks))]
            yield pd.DataFrame(
                {"mask": masks, "_a": -a.max(axis=0), key: batch[key].to_numpy()[at], "_b": b}
            )

    kind = cells.schema[key].dataType.simpleString()
    found = vectors.mapInPandas(leaders, f"mask string, _a double, `{key}` {kind}, _b double")
    best = found.groupBy("mask").agg(F.min(F.struct("_a", key, "_b")).alias("_best"))
    best = materialised(best.select("mask", F.col(f"_best.{key}").alias("chosen"), F.col("_best._b").alias("_b")))
    level = {r["mask"]: r["_b"] for r in best.select("mask", "_b").collect()}  # one row a split
    bar = np.array([level.get(m, np.nan) for m in masks])

    def ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            b = means(batch, 1 - inside)
            below, equal = (b < bar).sum(axis=0), (b == bar).sum(axis=0)
            yield pd.DataFrame({"mask": masks, "_below": below, "_equal": equal, "_n": len(batch)})

    counts = vectors.mapInPandas(ranks, "mask string, _below long, _equal long, _n long")
    counts = counts.groupBy("mask").agg(*[F.sum(c).alias(c) for c in ("_below", "_equal", "_n")])
    w = (F.col("_below") + (F.col("_equal") + 1) / 2.0) / (F.col("_n") + 1.0)
    return best.join(counts, "mask").select("mask", "chosen", F.log(w / (F.lit(1.0) - w)).alias("logit"))


def pbo(splits: DataFrame) -> DataFrame:
    """One row: share of splits whose choice ranks at or below the median."""
    return splits.agg(
        F.count(F.lit(1)).alias("splits"),
        F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"),
    )


# ------------------------------------------------------------------- neighbourhoods


def neighbourhoods(cells: DataFrame, key: str, axes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(cell, neighbour): within one step on every axis, the cell itself included.

    A cell joins the at most ``3 ** axes`` positions around it by equality, never all pairs.
    """
    scope = list(by)
    ranks = [
        F.dense_rank().over(Window.partitionBy(*scope or [F.lit(0)]).orderBy(a)).alias(f"_{a}")
        for a in axes
    ]
    placed = cells.select(key, *scope, *ranks)
    around = placed
    for a in axes:
        around = around.withColumn(f"_{a}", F.explode(F.array(*[F.col(f"_{a}") + s for s in (-1, 0, 1)])))
    right = placed.withColumnRenamed(key, "neighbour")
    return around.join(right, [*scope, *[f"_{a}" for a in axes]]).select(key, "neighbour")


def neighbourhood_median(
    cells: DataFrame, near: DataFrame, key: str, value: str, name: str = "s"
) -> DataFrame:
    """Median of the value over each cell's neighbourhood; NULL where its own is missing."""
    theirs = cells.select(F.col(key).alias("neighbour"), F.col(value).alias("_v"))
    medians = near.join(theirs, "neighbour").groupBy(key).agg(
        F.percentile("_v", F.lit(0.5)).alias(name)
    )
    own = cells.select(key, F.col(value).alias("_own"))
    return medians.join(own, key).select(key, F.when(F.col("_own").isNotNull(), F.col(name)).alias(name))


def cell_table(ledger: DataFrame, key: str, axes: Sequence[str], days: int | Column) -> DataFrame:
    """Per cell: mean daily net over its days, its t (0 without dispersion), trades a day."""
    n = F.lit(days) if isinstance(days, int) else days
    return ledger.groupBy(key, *axes).agg(
        F.avg("net_bp").alias("mean_net"),
        F.coalesce(t_stat(F.col("g_bp")), F.lit(0.0)).alias("t_g"),
        (F.sum("trades") / n).alias("rate"),
        F.sum("trades").alias("trades"),
    )


def choose_cell(scored: DataFrame, key: str, least_rate: float) -> DataFrame:
    """One row: the admissible cell with the highest S, then own mean, then first key; and its A."""
    order = F.struct(-F.col("s"), -F.col("mean_net"), F.col(key))
    best = F.min_by(F.struct(key, "s", "mean_net", "a"), order)
    return scored.filter(F.col("rate") >= least_rate).agg(best.alias("r")).select("r.*")


# -------------------------------------------------------------------------- placebos


def placebo_level(draws: DataFrame, value: str, q: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """The placebos' percentile (linear)."""
    return draws.groupBy(*by).agg(
        F.percentile(value, F.lit(q)).alias("level"), F.count(value).alias("draws")
    )


def placebo_p(draws: DataFrame, truth: DataFrame, value: str, name: str) -> DataFrame:
    """One row: share of draws at or above the true value, the value itself counted."""
    joined = draws.join(F.broadcast(truth))  # one row
    out = joined.agg(
        F.count_if(F.col(value) >= F.col(name)).alias("_e"), F.count(value).alias("draws")
    )
    return out.select("draws", ((F.col("_e") + 1) / (F.col("draws") + 1)).alias("p"))


def hour_signs(seed: int, hour: object, draws: int) -> np.ndarray:
    """The signs of one hour in every draw: bits of MD5, 128 draws a digest, so SQL can repeat them."""
    text = "".join(hashlib.md5(f"{seed}:{hour}:{b}".encode()).hexdigest() for b in range(-(-draws // 128)))
    digits = np.array([int(c, 16) for c in text], dtype=np.int64)
    return 1.0 - 2.0 * ((digits[:, None] >> np.arange(4)) & 1).reshape(-1)[:draws]


def sign_nulls(
    cells: DataFrame, key: str, stratum: str, hour: str, value: str, draws: int = 999, seed: int = 7
) -> DataFrame:
    """Every cell's mean against its own and its stratum's best under random signs of whole hours.

    An hour has one sign in a draw for all cells, so cells stay dependent as they are. Rows are summed by
    hour first; a cell's hours times the sign matrix are its means in all draws at once, and the best of a
    stratum is an elementwise maximum, taken in each task and again over tasks: no row is repeated per
    draw. Means within 1e-9 are equal. Columns: stratum, key, mean, p_cell, p_stratum (the share of draws,
    the observation counted, whose own or best mean is at least the cell's).
    """
    hours = cells.groupBy(stratum, key, hour).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    known: dict[object, np.ndarray] = {}

    def signs(h: object) -> np.ndarray:
        if h not in known:
            known[h] = hour_signs(seed, h, draws)
        return known[h]

    def drawn(frame: pd.DataFrame) -> pd.DataFrame:
        n = frame["_rows"].sum()
        sums = frame["_sum"].to_numpy(float)
        null = np.round(sums @ np.stack([signs(h) for h in frame[hour].tolist()]) / n, 9)
        out = frame.iloc[:1][[stratum, key]].copy()
        out["mean"], out["null"] = round(float(sums.sum() / n), 9), [null]
        return out

    kinds = {c: cells.schema[c].dataType.simpleString() for c in (stratum, key)}
    schema = f"`{stratum}` {kinds[stratum]}, `{key}` {kinds[key]}, mean double, null array<double>"
    found = materialised(hours.groupBy(stratum, key).applyInPandas(drawn, schema))

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({stratum: frame[stratum].iloc[:1], "best": [np.stack(list(frame["best"])).max(axis=0)]})

    def partly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.rename(columns={"null": "best"}).groupby(stratum):
                yield best(part)

    top = found.select(stratum, "null").mapInPandas(partly, f"`{stratum}` {kinds[stratum]}, best array<double>")
    top = top.groupBy(stratum).applyInPandas(best, f"`{stratum}` {kinds[stratum]}, best array<double>")

    def share(null: str) -> Column:
        return (F.size(F.filter(null, lambda x: x >= F.col("mean"))) + 1) / F.lit(draws + 1.0)

    return found.join(top, stratum).select(
        stratum, key, "mean", share("null").alias("p_cell"), share("best").alias("p_stratum")
    )


def shift_nulls(
    cells: DataFrame, key: str, day: str, weight: str, value: str, low: int = 7
) -> DataFrame:
    """Every cell's weighted mean against those of its weights moved round the circle of days.

    Shift ``s`` puts a day's weight on the value of the day ``s`` places on; all shifts from ``low`` to the
    number of days less ``low`` are one circular correlation, by Fourier transform. Days on which a cell has
    no row weigh and pay nothing; rows of one day count as one. Columns: key, mean, shifts, p_value.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(day)  # one row per calendar day
    days = materialised(cells.select(day).distinct().withColumn("_i", F.row_number().over(order) - 1))
    n = days.count()
    daily = cells.groupBy(key, day).agg(F.sum(weight).alias("_w"), F.sum(value).alias("_v")).join(days, day)
    shifts = np.arange(low, n - low + 1)

    def turned(frame: pd.DataFrame) -> pd.DataFrame:
        weights, values = np.zeros(n), np.zeros(n)
        weights[frame["_i"]], values[frame["_i"]] = frame["_w"], frame["_v"]
        total = weights.sum()
        null = np.fft.irfft(np.conj(np.fft.rfft(weights)) * np.fft.rfft(values), n)[shifts] / total
        mean = float(weights @ values / total)
        above = int((np.round(null, 6) >= round(mean, 6)).sum())
        return pd.DataFrame(
            {key: frame[key].iloc[:1], "mean": mean, "shifts": len(shifts), "p_value": (above + 1) / (len(shifts) + 1)}
        )

    kind = cells.schema[key].dataType.simpleString()
    return daily.groupBy(key).applyInPandas(turned, f"`{key}` {kind}, mean double, shifts long, p_value double")


def rotated_pairs(rows: DataFrame, shifts: Sequence[int], key: Sequence[str], day: str) -> DataFrame:
    """Every day's values against the days ``shift`` places on, per key, for a list of shifts."""
    per = Window.partitionBy(*key)
    ranked = rows.select(
        "*",
        (F.row_number().over(per.orderBy(day)) - 1).alias("_i"),
        F.count(F.lit(1)).over(per).alias("_n"),
    )
    moved = ranked.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in shifts])))
    return moved.withColumn("_j", F.pmod(F.col("_i") + F.col("shift"), F.col("_n")))


# ------------------------------------------------------------------------ tables


def reliability(rows: DataFrame, predicted: str, actual: str, bins: int = 10) -> DataFrame:
    """Predicted against observed frequency in quantile buckets; equal edges are merged."""
    from tickloom.operators.quantiles import quantile_by

    rows = materialised(rows.select(predicted, actual))  # every edge reads it again
    edges: DataFrame | None = None
    for k in range(bins + 1):
        one = quantile_by(rows, [], predicted, k / bins, f"_e{k}")
        edges = one if edges is None else edges.join(F.broadcast(one))  # one row each
    assert edges is not None
    packed = edges.select(F.array_distinct(F.array(*[f"_e{k}" for k in range(bins + 1)])).alias("_e"))
    joined = rows.join(F.broadcast(packed))  # one row
    # Buckets are closed on the right, the first on both sides.
    below = F.size(F.filter("_e", lambda e: e < F.col(predicted)))
    return joined.groupBy(F.greatest(below, F.lit(1)).alias("bucket")).agg(
        F.avg(predicted).alias("predicted"),
        F.avg(F.col(actual).cast("double")).alias("observed"),
        F.count(F.lit(1)).alias("n"),
    )


def calibration_error(table: DataFrame) -> DataFrame:
    gap = F.abs(F.col("predicted") - F.col("observed"))
    return table.agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("calibration_error"))


def marginals(cells: DataFrame, axes: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Medians per axis value in one pass over grouping sets, with no group for the whole."""
    named = ", ".join(axes)
    sets = ", ".join(f"({a})" for a in axes)
    view = f"cells_{abs(hash((named, id(cells))))}"
    cells.createOrReplaceTempView(view)
    medians = ", ".join(f"percentile({n}, 0.5) AS {n}" for n in numbers)
    marks = ", ".join(f"grouping({a}) AS g_{a}" for a in axes)
    out = cells.sparkSession.sql(
        f"SELECT {named}, {marks}, count(*) AS cells, {medians} FROM {view} "
        f"GROUP BY GROUPING SETS ({sets})"
    )
    axis = F.coalesce(*[F.when(F.col(f"g_{a}") == 0, F.lit(a)) for a in axes])
    value = F.coalesce(*[F.when(F.col(f"g_{a}") == 0, F.col(a).cast("string")) for a in axes])
    return out.select(axis.alias("axis"), value.alias("value"), "cells", *numbers)


def axis_spread(table: DataFrame, number: str) -> DataFrame:
    return table.groupBy("axis").agg((F.max(number) - F.min(number)).alias("spread"))


def regime_map(daily: DataFrame, alarms: DataFrame, least_days: int = 10) -> DataFrame:
    """Segments of a daily series between alarms: days, mean, t (with enough days), sum.

    The segment of a day is the number of alarms at or before it, found by an as-of lookup.
    """
    from tickloom.operators.asof import asof_join

    w = Window.partitionBy("symbol").orderBy("us")
    counted = alarms.select("symbol", "us", F.row_number().over(w).alias("n_alarm"))
    placed = asof_join(
        daily.withColumn("_seq", F.col("us")), counted, ["n_alarm"], left_tie="_seq", right_tie="us"
    )
    segment = F.coalesce("n_alarm", F.lit(0)).alias("segment")
    return placed.groupBy("symbol", segment).agg(
        F.min("us").alias("start_us"),
        F.max("us").alias("end_us"),
        F.count(F.lit(1)).alias("days"),
        F.avg("net_bp").alias("mean"),
        F.when(F.count(F.lit(1)) >= least_days, t_stat(F.col("net_bp"))).alias("t"),
        F.sum("net_bp").alias("cumulative_net"),
    )


def allocate(
    daily: DataFrame, lookback: int = 5, least_trades: float = 10, least_edge: float | None = 0.0
) -> DataFrame:
    """For each day, the strategy with the best pooled edge over the days before it, or none.

    ``daily`` has one row per (day, strategy), so the windows are calendars.
    """
    days = daily.select("day").distinct()
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("day"))  # one row a day
    numbered = daily.join(days.select("day", place.alias("_d")), "day")
    # A row counts towards each of the next `lookback` days.
    ahead = F.explode(F.sequence(F.col("_d") + 1, F.col("_d") + lookback)).alias("_for")
    pooled = numbered.select("strategy", "trades", "net_bp", ahead).groupBy("_for", "strategy").agg(
        F.sum("trades").alias("_t"), F.sum("net_bp").alias("_n")
    )
    usable = pooled.filter(F.col("_t") >= least_trades).withColumn("edge", F.col("_n") / F.col("_t"))
    best = usable.groupBy("_for").agg(
        F.min_by(F.struct("strategy", "edge"), F.struct(-F.col("edge"), F.col("strategy"))).alias("b"),
        F.count(F.lit(1)).alias("candidates"),
    )
    calendar = days.select("day", place.alias("_d")).filter(F.col("_d") > lookback)
    chosen = calendar.join(best, calendar["_d"] == best["_for"], "left")
    enough = F.col("b.edge") >= (least_edge if least_edge is not None else float("-inf"))
    picked = chosen.select(
        "day",
        F.when(enough, F.col("b.strategy")).otherwise(F.lit("stand aside")).alias("strategy"),
        F.col("b.edge").alias("edge"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
    )
    realised = daily.select("day", "strategy", F.col("net_bp").alias("realised_bp"))
    return picked.join(realised, ["day", "strategy"], "left")


def pooled_groups(rows: DataFrame, window: str, keys: Sequence[str]) -> DataFrame:
    """Group summaries per window and over all windows together (ROLLUP on the window alone)."""
    traded = F.col("trades") > 0
    net = F.when(traded, F.col("net_bp"))
    grouped = rows.select("*", F.explode(F.array(F.col(window), F.lit("all"))).alias("_w"))
    return grouped.groupBy(F.col("_w").alias("window"), *keys).agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if(traded).alias("days_with_trade"),
        F.sum("trades").alias("trades"),
        ratio(F.sum("net_bp"), F.sum("trades")).alias("net_per_trade_bp"),
        F.avg(net).alias("net_bp_day_mean"),
        t_stat(net).alias("day_t"),
        F.avg(F.when(traded, (F.col("net_bp") > 0).cast("double"))).alias("share_positive"),
    )


def headroom(attempts: DataFrame, rungs: Sequence[float] = (0.01, 0.02, 0.05, 0.10)) -> DataFrame:
    """What the result is short of: the cost and the hit rate that would break even, and rungs."""
    filled = F.col("filled")
    facts = attempts.agg(
        F.avg("net_bp").alias("net"),
        F.avg("gross_bp").alias("gross"),
        F.avg("cost_bp").alias("cost"),
        F.avg(filled.cast("double")).alias("fill_rate"),
        F.avg(F.when(filled, (F.col("gross_bp") > 0).cast("double"))).alias("hit_rate"),
        F.coalesce(-F.avg(F.when(filled & (F.col("gross_bp") < 0), F.col("gross_bp"))), F.lit(0.0)).alias(
            "mean_loss"
        ),
    )
    point = F.col("fill_rate") * 2 * F.col("mean_loss")
    needed = (
        F.when(F.col("net") >= 0, F.lit(0.0))
        .when((point > 0) & (-F.col("net") / point <= F.lit(1.0) - F.col("hit_rate")), -F.col("net") / point)
    )
    levels = F.explode(F.array(*[F.lit(float(r)) for r in rungs])).alias("hit_gain")
    return facts.select("*", needed.alias("hit_gain_to_break_even"), levels).select(
        F.when(F.col("gross") > 0, F.col("gross")).alias("cost_to_break_even_bp"),
        "hit_gain_to_break_even",
        "hit_gain",
        (F.col("net") + point * F.col("hit_gain")).alias("net_per_attempt_bp"),
    )


def verdicts(modes: DataFrame, min_days: int) -> DataFrame:
    """Kills in order, then the bar: mean, placebo, days, Holm and t."""
    adjusted = adjusted_p(modes.withColumn("p_one_sided", F.coalesce("p_one_sided", F.lit(1.0))), "p_one_sided")
    bar = (F.col("holm") <= 0.05) & (F.coalesce("t", F.lit(0.0)) >= T_BAR)
    status = (
        F.when(~(F.col("mean") > 0), "killed: mean")
        .when(~(F.col("mean") > F.col("placebo_level")), "killed: placebo")
        .when(F.col("days") < min_days, "inconclusive: days")
        .when(bar, "passes")
        .otherwise("not shown")
    )
    return adjusted.withColumn("status", status)


def rank_ic(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks per group; NULL when either side is flat."""
    both = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.select(
        *by, average_rank(x, by).alias("_x"), average_rank(y, by).alias("_y")
    )
    return ranked.groupBy(*by).agg(corr("_x", "_y").alias("rank_ic"), F.count(F.lit(1)).alias("n"))


def breakeven_on_grid(nets: DataFrame, by: Sequence[str]) -> DataFrame:
    """The fee at which the net crosses zero: from the highest fee still positive to the next one.

    Infinite when positive everywhere, minus infinite when nowhere.
    """
    w = Window.partitionBy(*by).orderBy("fee_bp")
    steps = nets.filter(F.col("net_bp").isNotNull()).select(
        *by,
        "fee_bp",
        "net_bp",
        F.lead("fee_bp").over(w).alias("_f1"),
        F.lead("net_bp").over(w).alias("_v1"),
    )
    top = steps.groupBy(*by).agg(
        F.max_by(F.struct("fee_bp", "net_bp", "_f1", "_v1"), F.when(F.col("net_bp") > 0, F.col("fee_bp"))).alias("p")
    )
    cross = F.col("p.fee_bp") + (F.col("p._f1") - F.col("p.fee_bp")) * F.col("p.net_bp") / (
        F.col("p.net_bp") - F.col("p._v1")
    )
    value = (
        F.when(F.col("p").isNull(), F.lit(float("-inf")))
        .when(F.col("p._f1").isNull(), F.lit(float("inf")))
        .otherwise(cross)
    )
    return top.select(*by, value.alias("breakeven_bp"))


def catalogue(axes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every combination of the axes' values, its key and the key's hash.

    Each axis is a short list, so the product is the catalogue itself, not an accident.
    """
    out: DataFrame | None = None
    for c in columns:
        values = axes.agg(F.array_sort(F.collect_set(c)).alias(f"_{c}"))
        out = values if out is None else out.join(F.broadcast(values))  # one row each
    assert out is not None
    for c in columns:
        out = out.select("*", F.explode(f"_{c}").alias(c)).drop(f"_{c}")
    key = F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns])
    return out.withColumn("key", key).withColumn("sha", F.sha2("key", 256))


def fingerprint(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """An order-free fingerprint of a table: row count and the xor of row hashes."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("digest")
    )


def ledger_append(ledger: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ledger plus the rows whose key is not yet in it; a key repeated among the rows fails."""
    fresh = rows.join(ledger, list(keys), "left_anti")
    w = Window.partitionBy(*keys)
    twice = F.raise_error(F.lit("a trial is listed twice")).cast("long")
    n = F.count(F.lit(1)).over(w)
    checked = fresh.withColumn("_n", F.when(n > 1, twice).otherwise(n)).filter("_n = 1").drop("_n")
    return ledger.unionByName(checked)


def by_side_and_tier(trades: DataFrame, tiers: DataFrame, base_taker: float) -> DataFrame:
    """Daily net per side at every published taker fee: net is linear in the fee."""
    daily = trades.groupBy("day", "side").agg(
        F.sum("net_bp").alias("_net"), F.count(F.lit(1)).alias("trades")
    )
    fees = tiers.select("tier", (F.col("taker_bp") - base_taker).alias("_d"))
    return daily.join(F.broadcast(fees)).select(  # the fee table
        "day", "side", "tier", "trades", (F.col("_net") - 2 * F.col("_d") * F.col("trades")).alias("net_bp")
    )


def per_clip(daily: DataFrame, clip: float, by: str = "day") -> DataFrame:
    """Net per unit of clip, pooled over instruments by day."""
    return daily.groupBy(by).agg(
        (F.avg("net_bp") / clip).alias("per_clip"), F.count(F.lit(1)).alias("instruments")
    )


def paired_difference(a: DataFrame, b: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Daily mean difference on the instrument-days both have."""
    left = a.select(*on, F.col(value).alias("_a"))
    right = b.select(*on, F.col(value).alias("_b"))
    return left.join(right, list(on)).groupBy("day").agg(
        F.avg(F.col("_a") - F.col("_b")).alias("difference"), F.count(F.lit(1)).alias("pairs")
    )


def attribution(daily: DataFrame, flags: DataFrame, draws: int, seed: int = 7) -> DataFrame:
    """One row: mean inside and outside flagged days, and the inside means of hash-drawn flags."""
    marked = daily.join(flags.select("day", F.lit(1).alias("_f")), "day", "left")
    inside = F.col("_f").isNotNull()
    truth = marked.agg(
        F.avg(F.when(inside, F.col("net_bp"))).alias("inside_bp"),
        F.avg(F.when(~inside, F.col("net_bp"))).alias("outside_bp"),
        F.avg(inside.cast("double")).alias("_share"),
    )
    spread = daily.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    mark = F.pmod(F.xxhash64(F.lit(seed), "draw", "day"), F.lit(1_000_000)) / 1e6
    drawn = (
        spread.join(F.broadcast(truth.select("_share")))  # one row
        .filter(mark < F.col("_share"))
        .groupBy("draw")
        .agg(F.avg("net_bp").alias("drawn_bp"))
    )
    level = drawn.agg(F.percentile("drawn_bp", F.lit(0.95)).alias("drawn_p95_bp"))
    return truth.join(F.broadcast(level)).drop("_share")  # one row each


def carry_forward(ledger: DataFrame, key: str, months: DataFrame, embargo_days: int, least: float) -> DataFrame:
    """Per month: the best cell on the days before it, and its mean on the month after an embargo.

    Monthly sums come first; a month then adds up the months before it.
    """
    monthly = ledger.groupBy(key, F.trunc("day", "month").alias("m")).agg(
        F.sum("net_bp").alias("net"), F.count(F.lit(1)).alias("n"), F.sum("trades").alias("trades")
    )
    w = Window.partitionBy(key).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    # Every (cell, month) is listed so that a month without trades still carries the past.
    calendar = months.agg(F.array_sort(F.collect_set("month")).alias("_m"))  # one row
    grid = ledger.select(key).distinct().join(F.broadcast(calendar)).select(
        key, F.explode("_m").alias("month")
    )
    past = grid.join(monthly.withColumnRenamed("m", "month"), [key, "month"], "left").select(
        key,
        "month",
        F.sum("net").over(w).alias("_net"),
        F.sum("n").over(w).alias("_days"),
        F.sum("trades").over(w).alias("_trades"),
    )
    usable = past.filter((F.col("_trades") >= least) & (F.col("_days") > 0)).withColumn(
        "mean", F.col("_net") / F.col("_days")
    )
    best = usable.groupBy("month").agg(
        F.min_by(key, F.struct(-F.col("mean"), F.col(key))).alias(key)
    )
    scored = ledger.withColumn("month", F.trunc("day", "month")).filter(
        F.col("day") >= F.date_add("month", embargo_days)
    )
    held = scored.groupBy(key, "month").agg(F.avg("net_bp").alias("held_bp"))
    return best.join(held, [key, "month"], "left").select(
        "month", F.col(key).alias("chosen"), F.coalesce("held_bp", F.lit(0.0)).alias("held_bp")
    )


def ic_by_horizon(rows: DataFrame, feature: str, horizons: Sequence[int]) -> DataFrame:
    """Correlation of a feature with each forward move column ``fwd_<h>``."""
    wide = rows.agg(*[corr(feature, f"fwd_{h}").alias(str(h)) for h in horizons])
    return wide.unpivot([], [str(h) for h in horizons], "horizon", "ic").withColumn(
        "horizon", F.col("horizon").cast("long")
    )


def leaderboard(cells: DataFrame, key: str, stratum: str) -> DataFrame:
    """Cells ranked by mean net overall and inside their stratum (one row per cell)."""
    order = [F.desc("mean_net"), F.asc(key)]
    return cells.select(
        key,
        stratum,
        "mean_net",
        "trades",
        F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("rank"),
        F.row_number().over(Window.partitionBy(stratum).orderBy(*order)).alias("stratum_rank"),
    )

