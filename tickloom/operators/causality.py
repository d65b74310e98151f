"""Checks that a feature reads only the past, and no further back than it says.

A check builds its features twice, and each build plans chunks on its rows: they are written once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import materialised

KEYS = ("symbol", "us", "seq")
Builder = Callable[[DataFrame], DataFrame]


def differing(full: DataFrame, other: DataFrame, columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Per column: rows both have, and rows whose values differ (a missing one equals a missing one)."""
    named = other.select(*KEYS, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = full.select(*KEYS, *columns).join(named, list(KEYS))

    def off(c: str):
        a, b = F.col(c), F.col(f"_{c}")
        gap = F.abs(a - b) > F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs(a))
        return F.count_if((a.isNull() != b.isNull()) | F.coalesce(gap, F.lit(False)))

    wide = joined.agg(F.count(F.lit(1)).alias("rows"), *[off(c).alias(c) for c in columns])
    return wide.unpivot(["rows"], list(columns), "column", "differing")


def truncation_check(rows: DataFrame, build: Builder, columns: Sequence[str], cut_us: int) -> DataFrame:
    """Values before a cut must not change when everything after it is taken away."""
    rows = materialised(rows)
    full = build(rows).filter(F.col("us") < cut_us)
    return differing(full, build(rows.filter(F.col("us") < cut_us)), columns)


def lookback_check(rows: DataFrame, build: Builder, columns: Sequence[str], lookback: int) -> DataFrame:
    """The last row of each series must not change when only the declared look-back is kept."""
    rows = materialised(rows)
    w = Window.partitionBy("symbol").orderBy(F.desc("us"), F.desc("seq"))
    # A top-k per series: Spark keeps only the last rows of each task before the sort.
    kept = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= lookback + 1).drop("_r")
    last = rows.groupBy("symbol").agg(F.max(F.struct("us", "seq")).alias("k")).select("symbol", "k.*")
    return differing(build(rows).join(last, list(KEYS)), build(kept).join(last, list(KEYS)), columns)


def mutation_check(rows: DataFrame, build: Builder, columns: Sequence[str], cut_us: int, value: str) -> DataFrame:
    """One row: digests of the values before a cut, with and without every later input changed."""
    rows = materialised(rows)
    changed = rows.withColumn(value, F.when(F.col("us") >= cut_us, F.col(value) * 1.5 + 7).otherwise(F.col(value)))

    def digest(df: DataFrame, name: str) -> DataFrame:
        kept = df.filter(F.col("us") < cut_us)
        rounded = [F.round(c, 9) for c in columns]
        return kept.agg(F.bit_xor(F.xxhash64(*KEYS, *rounded)).alias(name), F.count(F.lit(1)).alias(f"{name}_rows"))

    a, b = digest(build(rows), "plain"), digest(build(changed), "changed")
    return a.join(F.broadcast(b)).select(  # one row each
        F.col("plain_rows").alias("rows"), (F.col("plain") == F.col("changed")).alias("equal")
    )
