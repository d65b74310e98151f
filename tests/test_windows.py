"""Cutting instruments into chunks must leave no trace, however the rows are spread."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import flow, labels
from tickloom.functions.book import FEATURES, build_features
from tickloom.functions.panel import normalised, positioning_features
from tickloom.operators.asof import asof_join
from tickloom.operators.chunks import BARS, BOOK, Layout, chunk_map, last_known, running
from tickloom.operators import quantiles
from tickloom.operators.quantiles import quantile_by

TINY = replace(BOOK, bucket_s=7_200.0, chunk_rows=17)
NAMES = [
    n
    for n in FEATURES
    if n in "ofi_20_norm mid_return_20_bp realized_vol_50_bp touch_persistence_20 spread_pressure_20".split()
]


def frame(df, keys=("symbol", "us", "seq")):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(b)], check_dtype=False, rtol=1e-9, atol=1e-9)


def test_features_do_not_depend_on_chunks(fx):
    same(
        frame(build_features(fx.book, NAMES, spine=fx.spine)),
        frame(build_features(fx.book, NAMES, layout=TINY)),
    )


def test_features_do_not_depend_on_partitions(spark, fx):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    wide = frame(build_features(fx.book, NAMES))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        same(wide, frame(build_features(fx.book, NAMES)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_forward_labels_do_not_depend_on_chunks(fx):
    same(
        frame(labels.triple_barrier(fx.book, 12, 40, 40)),
        frame(labels.triple_barrier(fx.book, 12, 40, 40, layout=TINY)),
    )


def test_pandas_windows_do_not_depend_on_chunks(fx):
    base = flow.base_quantities(fx.book)
    same(
        frame(flow.ewm(base, ["spread_bp"], [5])),
        frame(flow.ewm(base, ["spread_bp"], [5], layout=TINY)),
    )
    rows = fx.book.select("symbol", "us", "seq", F.col("ask_price_0").alias("x"))
    same(
        frame(flow.winsorise(rows, "x", 7200, (0.1, 0.9))),
        frame(flow.winsorise(rows, "x", 7200, (0.1, 0.9), layout=TINY)),
    )


def test_normaliser_does_not_depend_on_chunks(fx):
    same(
        frame(normalised(fx.book, ["bid_size_0"], window=20)),
        frame(normalised(fx.book, ["bid_size_0"], window=20, layout=TINY)),
    )


def test_a_floor_holds_where_no_scale_is_known(spark):
    """Equal values have no spread, and too few deviations for the stand-in."""
    rows = [("s", k, k, 5.0) for k in range(10)] + [("s", 10, 10, 3.0)]
    book = spark.createDataFrame(rows, "symbol string, us long, seq long, x double")
    floors = spark.createDataFrame([(4.0,)], "x double")
    got = frame(normalised(book, ["x"], window=40, least=10, floors=floors))["x"]
    assert list(got[:10].isna()) == [True] * 10 and got[10] == -0.5


def test_positioning_does_not_depend_on_chunks(fx):
    metrics = fx.bars.select("symbol", "us", F.col("volume").alias("sum_open_interest"))
    small = replace(BARS, bucket_s=7_200.0, chunk_rows=17)
    same(
        frame(positioning_features(metrics, windows=(12,)), ("symbol", "us")),
        frame(positioning_features(metrics, windows=(12,), layout=small), ("symbol", "us")),
    )


def test_a_busy_instrument_is_spread_over_many_chunks(spark):
    """One key holding nearly every row is cut into even pieces."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 50 == 0, "quiet").otherwise("busy").alias("symbol"),
        (F.col("id") * 1_000_000).alias("us"),
    )
    layout = Layout(bucket_s=60, chunk_rows=500)
    sizes = (
        rows.withColumn("_bucket", layout.bucket())
        .join(chunk_map(rows, layout, rows_back=20), ["symbol", "_bucket"])
        .filter("symbol = 'busy'")
        .groupBy("_c")
        .count()
        .toPandas()["count"]
    )
    assert len(sizes) >= 35 and sizes.max() <= 600


def test_scans_match_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"symbol": rng.choice(["a", "b"], 400), "us": np.sort(rng.integers(0, 10**9, 400))})
    pdf["seq"] = np.arange(400)
    pdf["x"] = np.where(rng.random(400) < 0.7, np.nan, rng.normal(size=400))
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    layout = replace(BOOK, bucket_s=20.0)
    got = frame(running(last_known(df, {"seen": F.col("x")}, layout), {"total": F.lit(1)}, layout))
    want = pdf.sort_values(["symbol", "us", "seq"]).reset_index(drop=True)
    want["seen"] = want.groupby("symbol")["x"].ffill()
    want["total"] = want.groupby("symbol").cumcount() + 1
    assert np.allclose(got["seen"].astype(float), want["seen"], equal_nan=True)
    assert (got["total"] == want["total"]).all()


@pytest.mark.parametrize("tolerance", [None, 30.0])
def test_asof_matches_merge_asof(spark, tolerance):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"symbol": "s", "us": np.sort(rng.integers(0, 10**9, 200))})
    left["seq"] = np.arange(len(left))
    right = pd.DataFrame({"symbol": "s", "us": np.sort(rng.integers(0, 10**9, 60))})
    right["seq"] = np.arange(len(right))
    right["v"] = rng.normal(size=60)
    got = frame(
        asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["v"], tolerance_s=tolerance)
    )
    limit = None if tolerance is None else int(tolerance * 1e6)
    want = pd.merge_asof(left, right.drop(columns=["symbol", "seq"]), on="us", tolerance=limit)
    assert np.allclose(got["v"].astype(float), want["v"], equal_nan=True)


def test_prints_on_a_tie_come_before_rows(spark):
    left = spark.createDataFrame([("s", 10, 1)], "symbol string, us long, seq long")
    right = spark.createDataFrame([("s", 10, 7, 2.0), ("s", 10, 8, 3.0), ("s", 11, 9, 4.0)], "symbol string, us long, seq long, v double")
    assert asof_join(left, right, ["v"]).first()["v"] == 3.0
    assert asof_join(left, right, ["v"], strict=True).first()["v"] is None
    assert asof_join(left, right, ["v"], forward=True).first()["v"] == 2.0
    assert asof_join(left, right, ["v"], forward=True, strict=True).first()["v"] == 4.0


@pytest.mark.parametrize("n_slices", [3, 4096])
def test_exact_quantiles(spark, monkeypatch, n_slices):
    monkeypatch.setattr(quantiles, "SLICES", n_slices)
    rng = np.random.default_rng(11)
    values = np.round(rng.normal(size=5_000), 2)
    df = spark.createDataFrame(pd.DataFrame({"k": rng.choice(["a", "b"], 5_000, p=[0.9, 0.1]), "v": values}))
    for q in (0.0, 0.1, 0.5, 0.99, 1.0):
        got = {r["k"]: r["x"] for r in quantile_by(df, ["k"], "v", q, "x").collect()}
        want = df.toPandas().groupby("k")["v"].quantile(q)
        assert got == pytest.approx(want.to_dict(), abs=1e-12)


def test_quantiles_put_no_key_into_one_task(spark):
    values = spark.range(1000).selectExpr("id % 2 AS k", "id * 0.5 AS _v")
    counts = quantiles.counted(values, ["k"]).selectExpr("k", "_v", "_c", "499L AS _low", "500L AS _high")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = quantiles.at_ranks(counts, ["k"])._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan


def test_long_rolling_moments_match_pandas(spark):
    """Running sums give pandas' rolling values, and exactly zero where nothing moved."""
    rng = np.random.default_rng(21)
    n = 400
    x = np.round(100 + np.cumsum(rng.normal(size=n)), 2)
    x[150:260] = x[150]
    pdf = pd.DataFrame({"symbol": "s", "us": np.arange(n) * 10**6, "seq": np.arange(n), "v": x})
    out = flow.expand(
        spark.createDataFrame(pdf), windows=(40,), lags=(1,), levels=("v",), diffs=("v",), layout=replace(BOOK, bucket_s=30.0, chunk_rows=60)
    )
    got = frame(out)
    roll = pdf["v"].rolling(40)
    step = pdf["v"].diff().rolling(40)
    assert np.allclose(got["v_mean40"].astype(float), roll.mean(), equal_nan=True)
    assert np.allclose(got["v_std40"].astype(float), roll.std(), equal_nan=True, atol=1e-7)
    assert np.allclose(got["v_vol40"].astype(float), step.std(), equal_nan=True, atol=1e-7)
    assert (got.loc[190:259, "v_std40"] == 0).all() and (got.loc[190:259, "v_z40"] == 0).all()


def test_paths_are_scanned_in_short_chunks(spark, monkeypatch):
    from tickloom.operators import trades

    seen = []
    cut = trades.chunked
    monkeypatch.setattr(trades, "chunked", lambda df, lay, **k: seen.append(lay.chunk_rows) or cut(df, lay, **k))
    rows = spark.createDataFrame([("s", i, 0, 0.0, 1.0, 100.0, 0.5, 0.5) for i in range(9)], "symbol string, row long, decision int, forward_bp double, spread_bp double, mid double, p_buy double, p_sell double")
    last = rows.groupBy("symbol").agg(F.max("row").alias("_last"))
    found = trades.exits_on_path(rows, trades.ExitRules(hold=3, stop_loss_bp=5.0), last, ["symbol"], BOOK)
    assert found.count() == 0 and seen == [trades.ROW_BUCKET]
