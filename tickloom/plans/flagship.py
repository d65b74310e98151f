"""The flagship query: an instrument screen from raw prints to edge over cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.columns import corr

from tickloom.functions.book import build_features
from tickloom.functions.labels import forward_return, three_class
from tickloom.plans.fixtures import Fixtures
from tickloom.plans.registry import tidy


def flagship(spark: SparkSession, sf_dir: str, horizon: int = 20) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    names = ["spread_bp", "queue_imbalance", "mid_return_20_bp"]
    features = build_features(fx.book, names, spine=fx.spine)
    moves = forward_return(fx.book, horizon, spine=fx.spine)
    rows = features.join(moves, ["symbol", "us", "seq"])
    label = three_class(F.col("forward_bp"), 50.0)
    out = rows.withColumn("label", label).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("spread_bp").alias("mean_spread_bp"),
        corr("queue_imbalance", "forward_bp").alias("information_coefficient"),
        corr("mid_return_20_bp", "forward_bp").alias("momentum_coefficient"),
        F.stddev_samp("forward_bp").alias("volatility_bp"),
        F.avg(F.abs("label").cast("double")).alias("share_moving"),
    )
    edge = F.abs("information_coefficient") * F.col("volatility_bp") / (F.col("mean_spread_bp") + 11)
    return tidy(out.withColumn("edge_over_cost", edge)).orderBy(F.desc("edge_over_cost"), "symbol")
