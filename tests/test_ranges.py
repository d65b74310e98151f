import os
import re
import time
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from tickloom.functions import flow
from tickloom.functions.labels import triple_barrier
from tickloom.operators import ranges
from tickloom.operators.chunks import BOOK
from tickloom.operators.ranges import Blocks, Ranked, first_beyond, merged, trailing, within
from tickloom.plans import catalog
from tickloom.plans.registry import QUERIES, runner

catalog.load()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("n", [0, 1, 2, 17, 300])
def test_first_beyond_matches_a_scan(n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 30, n).astype(float)
    low = rng.integers(0, n + 1, 200)
    high = low + rng.integers(0, n + 1, 200)
    high = np.minimum(high, n)
    bar = rng.integers(0, 33, 200)
    up = first_beyond(values, np.maximum, low, high, lambda v, i: v >= bar[i])
    down = first_beyond(values, np.minimum, low, high, lambda v, i: v <= bar[i] - 5)
    for a, b, at, u, d in zip(low, high, bar, up, down, strict=True):
        assert u == next((k for k in range(a, b) if values[k] >= at), b)
        assert d == next((k for k in range(a, b) if values[k] <= at - 5), b)


@pytest.mark.parametrize("n,kinds", [(0, 3), (1, 1), (40, 1), (257, 4), (300, 1000)])
def test_order_statistics_match_numpy(n, kinds):
    rng = np.random.default_rng(kinds)
    values = rng.integers(0, kinds, n) / 7.0
    values[rng.random(n) < 0.2] = np.nan
    ranked = Ranked(values)
    for window, itself in ((1, True), (5, False), (64, True), (1000, False)):
        low, high = trailing(n, window, itself)
        for q in (0.0, 0.25, 0.5, 0.9, 1.0):
            got = ranked.quantile(low, high, q, least=3)
            for a, b, x in zip(low, high, got, strict=True):
                there = values[a:b][~np.isnan(values[a:b])]
                want = np.quantile(there, q) if len(there) >= 3 else np.nan
                assert np.isclose(x, want, equal_nan=True, rtol=1e-12)


def test_quantiles_of_endless_values_are_not_lost():
    values = np.array([np.inf, np.inf, 1.0, -np.inf])
    low, high = np.array([0, 0]), np.array([2, 3])
    assert Ranked(values).quantile(low, high, 0.5).tolist() == [np.inf, np.inf]


def test_barriers_with_unknown_mids_and_short_series_match_a_walk(spark):
    rng = np.random.default_rng(5)
    rows = []
    for symbol, n in (("A", 700), ("B", 90), ("C", 1)):
        mid = 100 * np.exp(np.cumsum(rng.normal(0, 2e-4, n)))
        for k, m in enumerate(mid.tolist()):
            rows.append((symbol, k * 400_000_000, k, None if k in (33, 400) else m, m))
    book = spark.createDataFrame(rows, "symbol string, us long, seq long, bid_price_0 double, ask_price_0 double")
    horizon, bar = 150, 35.0
    want = {}
    for symbol in "ABC":
        mids = [None if b is None else (b + a) / 2 for s, _, _, b, a in rows if s == symbol]
        for k, m in enumerate(mids):
            path = mids[k + 1 : k + 1 + horizon]
            label = None
            if m is not None and len(path) == horizon and None not in path:
                moves = [(x / m - 1) * 1e4 for x in path]
                up = next((j for j, v in enumerate(moves) if v >= bar), horizon)
                down = next((j for j, v in enumerate(moves) if v <= -bar), horizon)
                label = 0 if up == down == horizon else 1 if up <= down else -1
            want[symbol, k] = label
    for layout in (BOOK, replace(BOOK, bucket_s=7_200.0, chunk_rows=50)):
        got = {(r.symbol, r.seq): r.label for r in triple_barrier(book, horizon, bar, bar, layout=layout).collect()}
        assert got == want
    assert {-1, 0, 1, None} <= set(want.values())


@pytest.mark.parametrize("n", [1, 2, 5, 64, 301])
def test_blocks_add_up_to_what_a_range_holds(n):
    rng = np.random.default_rng(n)
    values = 1e9 + np.round(rng.normal(size=n), 1) * (rng.random(n) < 0.7)
    us = np.sort(rng.integers(0, n, n))
    low, high = within(us, -n // 4, 0)
    there = np.ones(n)
    count, mean, square = Blocks((there, values, np.zeros(n)), merged).of(low, high)
    (total,) = Blocks((values,)).of(low, high)
    for i in range(n):
        own = values[(us >= us[i] - n // 4 - (n % 4 > 0)) & (us <= us[i])]
        assert count[i] == len(own) and total[i] == pytest.approx(own.sum(), rel=1e-15)
        assert mean[i] == pytest.approx(own.mean(), rel=1e-15)
        assert square[i] == pytest.approx(((own - own.mean()) ** 2).sum(), rel=1e-6, abs=1e-9)
        assert square[i] == 0 or len(set(own)) > 1


def busy(spark, n):
    """A series of n rows, four a second, as book rows and prints."""
    rows = spark.range(n).selectExpr(
        "'A' AS symbol", "id * 250000 AS us", "id AS seq", "id AS trade_id",
        "100.0 + id % 7 AS bid_price_0", "100.0 + id % 7 AS ask_price_0", "IF(id % 5 < 3, 1, -1) AS aggressor",
        "100.0 + id % 7 AS price", "1.0 AS quantity", "1.0 AS size", "id % 3 = 0 AS is_buyer_maker",
    )
    return rows.coalesce(1)


def test_spans_of_many_rows_are_not_walked_for_every_row(spark):
    """120,000 rows whose spans hold all of them: minutes where each row walks its frame."""
    n = 120_000
    rows = busy(spark, n)
    span = n
    started = time.monotonic()
    got = flow.turn_counts(rows, (span,)).agg({f"turn_count_{span}s": "max"}).first()[0]
    step = np.sign(np.diff(np.arange(n) % 7))
    assert got == (step[1:] == -step[:-1]).sum()
    assert flow.run_lengths(rows, rows, span).agg({"trade_run_length": "max"}).first()[0] == 3
    stats = flow.rolling_trade_stats(rows, (span,)).orderBy("us").tail(1)[0]
    assert stats[f"trade_count_{span}s"] == n
    assert stats[f"trade_price_std_{span}s"] == pytest.approx(np.std(100.0 + np.arange(n) % 7, ddof=1))
    assert flow.log_change_std(rows, span).filter("sigma >= 0").count() == n - 2
    assert time.monotonic() - started < 90


@pytest.mark.parametrize("n", [1, 7, 400])
def test_rolled_parts_match_pandas(n):
    rng = np.random.default_rng(n)
    x = np.where(rng.random(n) < 0.2, np.nan, 1e6 + np.round(rng.normal(size=n), 2))
    x[n // 2 : n // 2 + 60] = x[n // 2]
    for w, parts in ranges.rolled(ranges.moments(x), [1, 2, 5, 50, 64, 1000], ranges.merged).items():
        roll = pd.Series(x).rolling(w, min_periods=1)
        assert np.allclose(ranges.known(parts), roll.mean(), equal_nan=True)
        assert np.allclose(ranges.deviation(parts), roll.std() if w > 1 else np.nan, equal_nan=True, atol=1e-4)


@pytest.mark.parametrize("name", ["t5_flow_set", "t16_generated_expansion", "f26_trailing_z_book", "f27_auxiliary_inputs"])
def test_long_row_windows_are_not_walked_for_every_row(spark, name):
    plan = runner(QUERIES[name])(spark, SF)._jdf.queryExecution().toString()
    frames = [int(k) for k in re.findall(r"RowFrame, -(\d+)", plan)]
    assert max(frames, default=0) < 60


def test_wide_results_are_made_in_short_chunks():
    assert ranges.array_layout(BOOK, 200).chunk_rows < ranges.array_layout(BOOK).chunk_rows < BOOK.chunk_rows
