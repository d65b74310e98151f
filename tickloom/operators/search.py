"""Searches: feature selection, exit policies, retraining schedules, successive halving."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import corr
from tickloom.functions.costs import TakerCosts
from tickloom.operators.trades import ExitRules, score, thin
from tickloom.session import materialised


def feature_scores(rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Per feature: variance and coefficient against the target, in one pass."""
    wide = rows.agg(
        *[F.struct(F.var_samp(f).alias("variance"), corr(f, target).alias("ic")).alias(f) for f in features]
    )
    items = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("s")) for f in features]))
    return wide.select(items.alias("r")).select("r.feature", "r.s.variance", "r.s.ic")


def feature_correlations(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Correlation of every pair of features, in one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    wide = rows.agg(*[corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return wide.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "corr").select(
        F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "corr"
    )


def select_features(
    rows: DataFrame, features: Sequence[str], target: str, *, least_variance: float = 1e-12, limit: float = 0.95, top: int = 10
) -> list[str]:
    """Features with variance, kept in order of coefficient unless too like one already kept.

    Only the small tables of scores and pair correlations reach the driver.
    """
    scored = feature_scores(rows, features, target).filter(F.col("variance") > least_variance)
    ranked = [r["feature"] for r in scored.orderBy(F.desc(F.abs("ic")), "feature").toLocalIterator()]
    like = {
        frozenset((r["a"], r["b"]))
        for r in feature_correlations(rows, features).filter(F.abs("corr") > limit).toLocalIterator()
    }
    kept: list[str] = []
    for f in ranked:
        if all(frozenset((f, k)) not in like for k in kept):
            kept.append(f)
    return kept[:top]


def binned_information(rows: DataFrame, feature: str, target: str, bins: int = 10) -> DataFrame:
    """One row: mutual information of equal-width bins of both, in nats."""
    edges = rows.agg(
        F.min(feature).alias("_fl"), F.max(feature).alias("_fh"), F.min(target).alias("_tl"), F.max(target).alias("_th")
    )
    joined = rows.filter(F.col(feature).isNotNull() & F.col(target).isNotNull()).join(F.broadcast(edges))  # one row

    def place(c: str, lo: str, hi: str):
        width = (F.col(hi) - F.col(lo)) / bins
        return F.least(F.floor(F.try_divide(F.col(c) - F.col(lo), width)), F.lit(bins - 1))

    cells = joined.groupBy(place(feature, "_fl", "_fh").alias("i"), place(target, "_tl", "_th").alias("j")).agg(
        F.count(F.lit(1)).alias("n")
    )
    whole = Window.partitionBy(F.lit(0))  # at most bins * bins cells
    n, ni, nj = (
        F.sum("n").over(whole),
        F.sum("n").over(Window.partitionBy("i")),
        F.sum("n").over(Window.partitionBy("j")),
    )
    terms = cells.select((F.col("n") / n * F.log(F.col("n") * n / (ni * nj))).alias("t"))
    return terms.agg(F.sum("t").alias("information"))


def exit_search(rows: DataFrame, policies: Sequence[ExitRules], costs: TakerCosts, least_trades: int) -> DataFrame:
    """Every exit policy's result on the same rows, the best with enough trades marked."""
    parts: DataFrame | None = None
    for i, rules in enumerate(policies):
        one = score(thin(rows, rules), costs).withColumn("policy", F.lit(i))
        parts = one if parts is None else parts.unionByName(one)
    assert parts is not None
    enough = F.col("trades") >= least_trades
    # One row per policy.
    best = F.max(F.when(enough, F.col("net_per_trade_bp"))).over(Window.partitionBy(F.lit(0)))
    return parts.select("policy", "trades", "net_bp", "net_per_trade_bp", (enough & (F.col("net_per_trade_bp") == best)).alias("chosen"))


def halving(scores: DataFrame, candidate: str, period: str, value: str, keep: float = 0.5, first: int = 1) -> DataFrame:
    """Successive halving: each rung judges the survivors on twice the periods of the one before.

    ``scores`` hold one row per candidate and period. Sums per rung come from one running total, so
    the rungs cost one pass; which candidates survive is settled on that small table.
    """
    periods = scores.select(period).distinct()
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(period))  # a calendar
    numbered = scores.join(periods.select(period, order.alias("_p")), period)
    total = periods.count()
    rungs = [min(total, first * 2**k) for k in range(int(math.log2(max(1, total / first))) + 1)]
    alive: DataFrame | None = None
    out: DataFrame | None = None
    for k, reach in enumerate(rungs):
        base = numbered.filter(F.col("_p") <= reach)
        base = base if alive is None else base.join(alive, candidate, "left_semi")
        mean = base.groupBy(candidate).agg(F.avg(value).alias("score"))
        scope = Window.partitionBy(F.lit(0))  # one row per candidate
        rank = F.row_number().over(scope.orderBy(F.desc("score"), candidate))
        n = F.count(F.lit(1)).over(scope)
        ranked = mean.select(candidate, "score", rank.alias("rank"), n.alias("_n"))
        rung = ranked.withColumn("survives", F.col("rank") <= F.greatest(F.ceil(F.col("_n") * keep), F.lit(1)))
        one = rung.select(F.lit(k).alias("rung"), candidate, "score", "rank", "survives")
        out = one if out is None else out.unionByName(one)
        alive = rung.filter("survives").select(candidate)
    assert out is not None
    return out


#: (days trained on, days served) of each schedule.
SCHEDULES = ((3, 1), (7, 1), (14, 1), (21, 1), (7, 3), (14, 3), (14, 7), (21, 7))


def refit_windows(
    rows: DataFrame,
    day: str,
    features: Sequence[str],
    target: str,
    cost: str,
    edge: float,
    schedules: Sequence[tuple[int, int]] = SCHEDULES,
) -> DataFrame:
    """A least-squares fit per schedule and window, and its result on the days that the window serves.

    A day is one line of sums and products of the features and the target; the lines of a window's
    training days add up to its normal equations, so rows are read once to fit all windows of
    all schedules and once to serve. A position is taken where the predicted ``target`` is beyond
    ``edge`` on either side and earns the target in that direction less ``cost``. A window whose equations
    cannot be solved has null coefficients and no rows. Rows with a missing value count nowhere. Columns:
    train_days, apply_days, window, train_rows, coefficients (intercept first), rows, trades, net_sum.
    """
    used = rows.select(day, cost, target, *features).na.drop()
    terms = [F.lit(1.0), *(F.col(f).cast("double") for f in features), F.col(target).cast("double")]
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    lines = used.groupBy(day).agg(*[F.sum(terms[i] * terms[j]).alias(f"_m{i}_{j}") for i, j in pairs])
    order = Window.partitionBy(F.lit(0))  # one row a calendar day
    lines = materialised(
        lines.select("*", (F.row_number().over(order.orderBy(day)) - 1).alias("_i"), F.count(F.lit(1)).over(order).alias("_n"))
    )
    plan = F.explode(F.array(*[F.struct(F.lit(a).alias("train_days"), F.lit(b).alias("apply_days")) for a, b in schedules]))
    placed = lines.withColumn("_s", plan).select("*", "_s.*").drop("_s")
    last = F.floor((F.col("_n") - F.col("train_days")) / F.col("apply_days")) - 1  # of whole windows
    oldest = F.greatest(F.ceil((F.col("_i") - F.col("train_days") + 1) / F.col("apply_days")), F.lit(0))
    newest = F.least(F.floor(F.col("_i") / F.col("apply_days")), last)
    taught = placed.where(oldest <= newest).withColumn("window", F.explode(F.sequence(oldest, newest)))
    sums = taught.groupBy("train_days", "apply_days", "window").agg(
        *[F.sum(f"_m{i}_{j}").alias(f"_m{i}_{j}") for i, j in pairs]
    )
    width = len(terms)

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = np.zeros((len(batch), width, width))
            for i, j in pairs:
                whole[:, i, j] = whole[:, j, i] = batch[f"_m{i}_{j}"]
            found = []
            for gram in whole:
                left, right = gram[:-1, :-1], gram[:-1, -1]
                good = gram[0, 0] > width - 1 and np.linalg.matrix_rank(left) == width - 1
                found.append(np.linalg.solve(left, right) if good else None)
            out = batch[["train_days", "apply_days", "window"]].copy()
            out["train_rows"], out["coefficients"] = whole[:, 0, 0].astype(int), found
            yield out

    fits = sums.mapInPandas(
        solved, "train_days int, apply_days int, window long, train_rows long, coefficients array<double>"
    )
    fits = materialised(fits)
    at = F.floor((F.col("_i") - F.col("train_days")) / F.col("apply_days"))
    served = placed.where((F.col("_i") >= F.col("train_days")) & (at <= last)).select(
        day, "train_days", "apply_days", at.alias("window")
    )
    served = served.join(fits.where("coefficients IS NOT NULL"), ["train_days", "apply_days", "window"])
    predicted = F.element_at("coefficients", 1)
    for k, f in enumerate(features):
        predicted = predicted + F.element_at("coefficients", k + 2) * F.col(f)
    side = F.when(predicted > edge, 1).when(predicted < -edge, -1).otherwise(0)
    keys = ["train_days", "apply_days", "window"]
    results = used.join(served, day).withColumn("_side", side).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.col("_side") != 0, 1)).alias("trades"),
        F.sum(F.when(F.col("_side") != 0, F.col("_side") * F.col(target) - F.col(cost))).alias("net_sum"),
    )
    return fits.join(results, keys, "left").select(
        *keys, "train_rows", "coefficients", F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("trades", F.lit(0)).alias("trades"), "net_sum",
    )


def retrain_search(windows: DataFrame, minimum_windows: int = 3) -> DataFrame:
    """Per schedule: its windows, those that could not be fitted, and the net result of a trade over all of
    them; ``chosen`` marks the best of those with ``minimum_windows`` fitted windows and a trade."""
    table = windows.groupBy("train_days", "apply_days").agg(
        F.count(F.lit(1)).alias("refits"),
        F.count(F.when(F.col("coefficients").isNull(), 1)).alias("skipped"),
        F.sum("rows").alias("rows"),
        F.sum("trades").alias("trades"),
        (F.sum("net_sum") / F.sum("trades")).alias("net_per_trade_bp"),
    )
    able = (F.col("refits") - F.col("skipped") >= minimum_windows) & F.col("net_per_trade_bp").isNotNull()
    order = Window.partitionBy(F.lit(0)).orderBy(  # one row a schedule
        F.when(able, F.col("net_per_trade_bp")).desc_nulls_last(), "train_days", "apply_days"
    )
    return table.withColumn("chosen", able & (F.row_number().over(order) == 1))
