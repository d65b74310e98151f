"""Contracts, archives on disk, stored planes, plugins."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from tickloom import plugins
from tickloom.operators import quality
from tickloom.operators.splits import walk_forward
from tickloom.sources import archives, store
from tickloom.sources.contracts import TRADES, ContractError, check_contract
from tickloom.sources.prints import checked


def test_missing_and_mistyped_columns_are_refused(spark):
    df = spark.createDataFrame([(1.0,)], "price double")
    with pytest.raises(ContractError, match="missing"):
        check_contract(df, TRADES)


@pytest.mark.parametrize(("scale", "offset"), [(1, 0), (1_000, 0), (1_000_000, 0), (1_000_000_000, 0)])
def test_epoch_units_by_magnitude(spark, scale, offset):
    seconds = 1_704_067_200
    raw = spark.createDataFrame([(str(seconds * scale + offset),)], "t string")
    assert archives.with_micros(raw, "t").first()["us"] == seconds * 1_000_000


def test_agg_trades_from_a_file(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/trades.csv"
    with open(path, "w") as f:
        f.write("a,p,q,T,m,time\n1,100.5,2,x, True ,1704067200000\n2,101,3,x,false,1704067200500\n")
    out = archives.agg_trades(archives.read_csv(spark, path), F.lit("S"), "file").orderBy("trade_id").collect()
    assert [r["is_buyer_maker"] for r in out] == [True, False]
    with pytest.raises(ContractError):
        archives.agg_trades(spark.createDataFrame([("1",)], "a string"), F.lit("S"), "file")


def test_a_broken_print_fails_the_job(spark):
    df = spark.createDataFrame([(1, -5.0, 1.0, 1)], "trade_id long, price double, size double, aggressor int")
    with pytest.raises(Exception, match="breaks the contract"):
        checked(df).collect()


def test_day_folders_are_pruned(spark, fx):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    store.write_plane(fx.prints, path, "prints")
    day = store.read_plane(spark, path, "prints", first_day="2024-01-10", last_day="2024-01-10").select("symbol", "price")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "ReadSchema: struct<price:double>" in plan


def test_unreadable_settlements_are_refused(spark):
    hour = 3_600_000_000
    df = spark.createDataFrame([("s", 0), ("s", 8 * hour), ("s", 12 * hour)], "symbol string, us long")
    with pytest.raises(Exception, match="not uniform"):
        quality.settlement_interval(df).collect()


def test_a_gap_in_the_calendar_is_refused(spark):
    days = spark.sql("SELECT explode(array(DATE'2024-01-01', DATE'2024-01-03')) AS day")
    with pytest.raises(Exception, match="not contiguous"):
        walk_forward(days, 1, 1, 1).collect()


def test_plugins_are_checked():
    with pytest.raises(KeyError):
        plugins.get("strategy", "nobody")
    with pytest.raises(ValueError, match="already"):
        plugins.add("strategy", "book_imbalance", object)
