"""Sequential rules against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.columns import corr
from tickloom.functions.distributions import normal_cdf, normal_quantile, t_upper_tail
from tickloom.operators import breaks, portfolio, rebuild, stats, trades
from tickloom.operators.bands import band_positions
from tickloom.operators.chunks import Layout


def greedy(rows):
    out, free = [], -(10**18)
    for at, until in sorted(rows):
        if at >= free:
            out.append(at)
            free = until
    return out


@pytest.mark.parametrize("chunk_rows", [1, 5, 10_000])
def test_greedy_entries_match_a_loop(spark, chunk_rows):
    rng = np.random.default_rng(2)
    at = np.sort(rng.choice(5_000, 600, replace=False))
    pdf = pd.DataFrame({"k": rng.choice(["hot", "cold"], 600, p=[0.9, 0.1]), "row": at})
    pdf["free_at"] = pdf["row"] + rng.integers(1, 90, 600)
    got = trades.greedy_entries(spark.createDataFrame(pdf), ["k"], bucket=64, chunk_rows=chunk_rows).toPandas()
    for key, part in pdf.groupby("k"):
        want = greedy(zip(part["row"], part["free_at"], strict=True))
        assert sorted(got.loc[got["k"] == key, "row"]) == want


def loop_thin(d, rules):
    """One position at a time, row by row, with every early exit."""
    out, side, at, free, best = [], 0, -1, 0, 0.0
    for i in range(len(d)):
        r = d.iloc[i]
        if side:
            move = side * (r.mid / d.mid[at] - 1) * 1e4
            best, reason = max(best, move), None
            held = r.p_buy if side > 0 else r.p_sell
            if rules.take_profit_bp and move >= rules.take_profit_bp:
                reason = "take_profit"
            elif rules.stop_loss_bp and move <= -rules.stop_loss_bp:
                reason = "stop_loss"
            elif rules.trailing_stop_bp and best > 0 and move <= best - rules.trailing_stop_bp:
                reason = "trailing_stop"
            elif rules.exit_below and held < rules.exit_below:
                reason = "signal_decay"
            elif i >= at + rules.hold:
                reason = "clock"
            elif rules.allow_reversal and r.decision == -side:
                reason = "reversal"
            if reason:
                out.append((at, i, side, reason))
                side, free = 0, i + rules.cooldown
        if side == 0 and r.decision and i >= free and not np.isnan(r.forward_bp):
            side, at, best = int(r.decision), i, 0.0
    if side:
        out.append((at, min(at + rules.hold, len(d) - 1), side, "end_of_data"))
    return out


@pytest.mark.parametrize(
    "rules",
    [
        trades.ExitRules(hold=7, cooldown=2),
        trades.ExitRules(hold=12, take_profit_bp=15, stop_loss_bp=10),
        trades.ExitRules(hold=15, trailing_stop_bp=8, exit_below=0.2),
        trades.ExitRules(hold=9, allow_reversal=True),
    ],
)
def test_thinning_matches_a_loop(spark, rules):
    rng = np.random.default_rng(8)
    n = 300
    d = pd.DataFrame(
        {
            "symbol": "s",
            "row": np.arange(n),
            "decision": rng.choice([-1, 0, 1], n, p=[0.2, 0.6, 0.2]),
            "mid": 100 * np.exp(np.cumsum(rng.normal(0, 5e-4, n))),
            "p_buy": rng.random(n),
            "spread_bp": 1.0,
        }
    )
    d["p_sell"] = 1 - d["p_buy"]
    # A forward move is known while the hold still fits, as in the data.
    d["forward_bp"] = (d["mid"].shift(-rules.hold) / d["mid"] - 1) * 1e4
    df = spark.createDataFrame(d).withColumn("forward_bp", F.when(~F.isnan("forward_bp"), F.col("forward_bp")))
    got = trades.thin(df, rules, bucket=32, chunk_rows=40).toPandas().sort_values("entry_row")
    want = loop_thin(d, rules)
    assert list(got[["entry_row", "exit_row", "direction", "exit_reason"]].itertuples(index=False, name=None)) == want


@pytest.mark.parametrize("chunk_rows", [3, 10_000])
def test_band_matches_a_loop(spark, chunk_rows):
    rng = np.random.default_rng(4)
    z = np.round(rng.normal(0, 1.5, 200), 2)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "s", "us": np.arange(200) * 10**6, "z": z}))
    layout = Layout(order=("us",), bucket_s=5, chunk_rows=chunk_rows)
    got = band_positions(df, entry=2, exit_at=0.5, layout=layout).toPandas().sort_values("us")["position"]
    held, want = 0, []
    for x in z:
        if held == 0:
            held = 1 if x <= -2 else (-1 if x >= 2 else 0)
        elif (held == 1 and x >= -0.5) or (held == -1 and x <= 0.5):
            held = 0
        want.append(held)
    assert list(got) == want


def test_rebuilt_book_does_not_depend_on_chunks(spark, fx):
    from tickloom.plans.queries_sources import book_log
    from tickloom.sources.messages import book_messages

    log = book_messages(book_log(fx))
    order = ["symbol", "us", "seq"]
    whole = rebuild.rebuild(log, 2).toPandas().sort_values(order).reset_index(drop=True)
    cut = rebuild.rebuild(log, 2, bucket_s=1200, chunk_rows=4).toPandas().sort_values(order).reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, cut)


def test_a_snapshot_inside_a_bin_adds_no_row(spark):
    def level(kind, us, update, bids, asks):
        return ("s", us, us, update, kind, bids, asks)

    two = [["10", "1"], ["9", "1"]], [["11", "1"], ["12", "1"]]
    log = spark.createDataFrame(
        [
            level("snapshot", 0, 1, *two),
            level("delta", 30_000, 2, [["10", "5"]], []),
            level("snapshot", 60_000, 3, *two),
            level("delta", 130_000, 4, [["10", "7"]], []),
        ],
        "symbol string, us long, recv long, update_id long, kind string, b array<array<string>>, a array<array<string>>",
    )
    got = rebuild.rebuild(log, 2).orderBy("us").collect()
    assert [(r.us, r.seq, r.bid_size_0) for r in got] == [(0, 1, 1.0), (130_000, 4, 7.0)]
    every = rebuild.rebuild(log, 2, grid_us=None).orderBy("us").collect()
    assert [(r.us, r.seq, r.bid_size_0) for r in every] == [(0, 1, 1.0), (30_000, 2, 5.0), (60_000, 3, 1.0), (130_000, 4, 7.0)]


def test_restarts_match_a_loop(spark):
    z = np.round(np.random.default_rng(3).normal(0, 1.4, 400), 3)
    z[5] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"symbol": "s", "us": range(400), "z": z}))
    got = [tuple(r) for r in breaks.switch_with_restart(df, 0.1, 3.0).orderBy("us").select("us", "kind").collect()]
    value, live, want = 0.0, True, []
    for i, x in enumerate(z):
        if not np.isnan(x):
            value = max(0.0, value + (-x if live else x) - 0.1)
            if value > 3.0:
                want.append((i, "stop" if live else "restart"))
                value, live = 0.0, not live
    assert got == want and len(want) > 4


def test_kill_switch_closed_form(spark):
    rng = np.random.default_rng(9)
    ret = np.concatenate([rng.normal(0, 1, 150), rng.normal(-1, 1, 100)])
    df = spark.createDataFrame(pd.DataFrame({"symbol": "s", "us": np.arange(250) * 3_600_000_000, "ret": ret}))
    got = breaks.kill_switch(df, k=0.5, h=4.0, warm_up=72).toPandas().sort_values("us")
    down, first = 0.0, None
    for i in range(72, 250):
        down = max(0.0, down - ret[i] / np.std(ret[:i], ddof=1) - 0.5)
        if down > 4.0 and first is None:
            first = i
    assert int(got.loc[got["over"], "us"].min() // 3_600_000_000) == first


def test_carry_spells_by_hand(spark):
    jan, feb, mar = (pd.Timestamp(f"2024-0{m}-01").date() for m in (1, 2, 3))
    table = spark.createDataFrame(
        [("x", jan, 100.0, 110.0, 2.0), ("x", feb, 110.0, 100.0, -1.0), ("x", mar, 100.0, 90.0, 4.0), ("y", jan, 50.0, 52.0, 3.0)],
        "coin string, month date, open double, close double, pnl double",
    )
    chosen = spark.createDataFrame([("r", jan, "x"), ("r", mar, "x"), ("r", jan, "y")], "rule string, month date, coin string")
    got = {(r.coin, r.entry_month): r.net_bp for r in portfolio.carry_holdings(table, chosen).collect()}
    side = 19 / 1e4
    assert got[("x", jan)] == pytest.approx((2 - side * (100 + 110)) / 100 * 1e4)
    assert got[("x", mar)] == pytest.approx((4 - side * (100 + 90)) / 100 * 1e4)
    assert got[("y", jan)] == pytest.approx((3 - side * (50 + 52)) / 50 * 1e4)


def test_band_trades_rearm_only_after_an_exit(spark):
    z = [0.0, 2.1, 4.5, 2.2, 1.0, 2.3, 0.2, 0.0]
    df = spark.createDataFrame(
        [("a", "b", 0, i, v, 1.0, 100.0 + i, 100.0) for i, v in enumerate(z)],
        "a string, b string, window long, row long, z double, beta double, oa1 double, ob1 double",
    )
    got = portfolio.trade_bands(df, portfolio.BandRule()).toPandas().sort_values("entry_row")
    assert list(zip(got["entry_row"], got["exit_row"], got["reason"], strict=True)) == [(1, 2, "stop"), (5, 6, "exit")]


def test_probabilities(spark):
    z = spark.createDataFrame([(float(v),) for v in np.linspace(-5, 5, 41)], "z double")
    for r in z.select("z", normal_cdf(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["z"] / math.sqrt(2)), abs=1e-14)
    for r in z.select("z", normal_quantile(normal_cdf(F.col("z"))).alias("back")).collect():
        assert r["back"] == pytest.approx(r["z"], abs=1e-6)
    known = [(2.0, 10, 0.03669401738537018), (1.0, 1, 0.25), (-1.5, 7, 0.9113509), (12.0, 3, 0.0006231)]
    df = spark.createDataFrame([(t, n) for t, n, _ in known], "t double, n long")
    got = [r["p"] for r in df.select(t_upper_tail(F.col("t"), F.col("n")).alias("p")).collect()]
    assert got == pytest.approx([p for _, _, p in known], abs=1e-5)


def test_correlation_of_a_flat_series_is_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(corr("x", "y").alias("c")).first()["c"] is None


def test_holm_counts_missing_members(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", None)], "name string, p double")
    got = {r["name"]: r["holm"] for r in stats.adjusted_p(df, "p").collect()}
    assert got["a"] == pytest.approx(0.03) and got["b"] == pytest.approx(0.08) and got["c"] is None


def test_neighbourhoods_never_pair_everything(spark):
    df = spark.createDataFrame([(f"{i},{j}", i, j) for i in range(6) for j in range(6)], "key string, x int, y int")
    near = stats.neighbourhoods(df, "key", ["x", "y"]).groupBy("key").count().toPandas()["count"]
    assert near.min() == 4 and near.max() == 9


def test_pair_windows_without_a_trip_leave_no_rows(spark):
    """Text columns of windows without rows keep their type."""
    from tickloom.plans import catalog
    from tickloom.plans.registry import QUERIES, runner

    catalog.load()
    for name in ("r8_band_trades", "r9_daily_pair_result"):
        assert runner(QUERIES[name])(spark, "/root/testdata/sf0.001").count() >= 0
