"""Exact order statistics of large groups without holding a group, or sorting it, in one task.

What a key comes to (its range, its total, the slice chosen) is one line a key and broadcast: a join by
the key would put all values of a key into one task.

Equal values are counted first. The value range of each key is then cut into slices of equal width;
the counts of the slices, a few thousand a key, show which slice holds a wanted rank, and only its
values go on. After ``ROUNDS`` rounds a slice is some ten-millionth of the range, and what is left
of it is ranked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import materialised

SLICES = 4096
ROUNDS = 2


def narrowed(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The values of the slices that hold ranks ``_low`` and ``_high``, with ranks counted anew."""
    bounds = counts.groupBy(*by).agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    width = F.col("_max") - F.col("_min")
    slice_ = F.when((width > 0) & (width < float("inf")), F.width_bucket("_v", "_min", "_max", F.lit(SLICES)))
    placed = counts.join(F.broadcast(bounds), list(by)).withColumn("_s", F.coalesce(slice_, F.lit(1)))
    run = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    slices = (
        placed.groupBy(*by, "_s")
        .agg(
            F.sum("_c").alias("_c"),
            F.min("_v").alias("_a"),
            F.max("_v").alias("_z"),
            F.first("_low").alias("_low"),
            F.first("_high").alias("_high"),
        )
        .withColumn("_end", F.sum("_c").over(run))
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )
    holds = [(F.col("_start") <= F.col(r)) & (F.col(r) < F.col("_end")) for r in ("_low", "_high")]
    chosen = slices.filter(holds[0] | holds[1]).groupBy(*by).agg(
        F.min("_a").alias("_from"), F.max("_z").alias("_to"), F.min("_start").alias("_below")
    )
    kept = counts.join(F.broadcast(chosen), list(by)).filter(F.col("_v").between(F.col("_from"), F.col("_to")))
    ranks = [(F.col(r) - F.col("_below")).alias(r) for r in ("_low", "_high")]
    return kept.select(*by, "_v", "_c", *ranks)


def at_ranks(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per key the values ``_x`` and ``_y`` at ranks ``_low <= _high``, counted from 0 upwards.

    ``counts``, which is read several times and so best stored, has distinct values ``_v``, their
    numbers ``_c``, and the ranks on every row.
    """
    left = counts
    for _ in range(ROUNDS):
        left = narrowed(left, by)
    run = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = left.withColumn("_cum", F.sum("_c").over(run))
    return ranked.groupBy(*by).agg(
        F.min(F.when(F.col("_cum") > F.col("_low"), F.col("_v"))).alias("_x"),
        F.min(F.when(F.col("_cum") > F.col("_high"), F.col("_v"))).alias("_y"),
    )


def counted(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct values ``_v`` per key with their numbers ``_c`` and the key's total ``_n``."""
    found = values.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    return found.join(F.broadcast(found.groupBy(*by).agg(F.sum("_c").alias("_n"))), list(by))


def quantiles_by(df: DataFrame, keys: Sequence[str], value: Column | str, qs: Mapping[str, float]) -> DataFrame:
    """One row per key: the linearly interpolated quantiles ``qs`` of the non-missing values, which are
    counted once for all of them."""
    v = F.col(value) if isinstance(value, str) else value
    by = list(keys) or ["_all"]
    base = df.select(*(keys or [F.lit(1).alias("_all")]), v.cast("double").alias("_v"))
    stored = materialised(counted(base.filter(F.col("_v").isNotNull() & ~F.isnan("_v")), by))
    out = stored.groupBy(*by).agg(F.first("_n").alias("_n"))
    for name, q in qs.items():
        at = (F.col("_n") - 1) * F.lit(q)
        low = F.floor(at)
        ranks = [low.alias("_low"), F.least(low + 1, F.col("_n") - 1).alias("_high")]
        ends = at_ranks(stored.select(*by, "_v", "_c", *ranks), by)
        found = (F.col("_x") + (F.col("_y") - F.col("_x")) * (at - low)).alias(name)
        out = out.join(ends, by).select(*out.columns, found)
    return out.select(*keys, *qs)


def quantile_by(df: DataFrame, keys: Sequence[str], value: Column | str, q: float, name: str) -> DataFrame:
    """One row per key: the linearly interpolated ``q`` quantile of the non-missing values."""
    return quantiles_by(df, keys, value, {name: q})
