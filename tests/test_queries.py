"""A spread of named queries against their SQL, and the contract of all of them."""

from __future__ import annotations

import os

import pytest

from tickloom.operators import chunks
from tickloom.plans import catalog
from tickloom.plans.check import compare, connect
from tickloom.plans.registry import QUERIES, full_sql, runner, tidy

catalog.load()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = (
    "f9_ofi_20_norm f21_depth_set j1_asof_tolerance j3_forward_bucket g2_filled_grid g13_book_from_deltas "
    "t2_rolling_trade_stats t7_turn_counts l11_walked_taker_label x1_thinned_trades x16_print_fills "
    "e7_pbo_splits e25_marginals r5_dickey_fuller v2_purged_folds v10_truncation_check b3_kill_switch "
    "w2_streamed_book_state w5_trailing_features q9_time_gaps s1_read_plane"
).split()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    q = QUERIES[name]
    assert compare(runner(q)(spark, SF), con, full_sql(q)) == ""


CUT = (
    "p5_market_gate p6_stamped_gate t5_flow_set t6_short_volatility f9_ofi_20_norm l10_triple_barrier "
    "t3_joined_trade_stats"
).split()


@pytest.mark.parametrize("name", [n for n in CUT if n in QUERIES])
def test_result_does_not_depend_on_the_chunks(spark, con, name, monkeypatch):
    monkeypatch.setattr(chunks, "MAX_CHUNK_ROWS", 50)
    q = QUERIES[name]
    assert compare(runner(q)(spark, SF), con, full_sql(q)) == ""


def test_last_digits_round_as_in_sql(spark, con):
    halves = [(k + 0.5) / 1e6 for k in range(0, 400_000_000, 39_999)]  # 10,001 of them, stored just off the half
    values = [*halves, *[-v for v in halves[:999]], 0.0, 1e305, float("inf"), float("nan"), None]
    got = tidy(spark.createDataFrame([(v,) for v in values], "v double")).toArrow()["v"]
    want = con.execute("SELECT round(v, 6) + 0.0 FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()
    assert [str(v.as_py()) for v in got] == [str(r[0]) for r in want]


def test_a_spine_that_lacks_a_bucket_is_an_error(spark):
    rows = spark.createDataFrame([("s", i * 3_600_000_000, i) for i in range(5)], "symbol string, us long, seq long")
    spine = chunks.SameRows(rows.filter("seq <> 3"))
    with pytest.raises(Exception, match="lacks a bucket"):
        chunks.chunked(rows, rows_back=1, spine=spine).collect()


def test_every_statement_is_valid_sql(con):
    for q in QUERIES.values():
        if q.sql is not None:
            con.execute(f"EXPLAIN {full_sql(q)}")


def test_flagship_has_rows(spark):
    from tickloom.plans.flagship import flagship

    assert flagship(spark, SF).count() == 5
