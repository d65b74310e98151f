"""What several passes read is computed once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import causality


def counted(df, seen):
    """``df``, adding the rows it computes to an accumulator."""

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema)


def test_checks_compute_their_rows_once(spark):
    rows = spark.range(200).select(
        F.lit("a").alias("symbol"), (F.col("id") * 1000).alias("us"), F.col("id").alias("seq"), F.col("id").cast("double").alias("x")
    )
    build = lambda df: df.withColumn("y", F.col("x") * 2)
    for check, want in (
        (lambda r: causality.truncation_check(r, build, ["y"], 100_000), [(100, "y", 0)]),
        (lambda r: causality.lookback_check(r, build, ["y"], 3), [(1, "y", 0)]),
        (lambda r: causality.mutation_check(r, build, ["y"], 100_000, "x"), [(100, True)]),
    ):
        seen = spark.sparkContext.accumulator(0)
        assert [tuple(r) for r in check(counted(rows, seen)).collect()] == want
        assert seen.value == 200


def test_trips_without_brackets_are_those_with(spark):
    """The rule's prices of entries and exits do not depend on looking up the others."""
    from tickloom.operators import fills

    prints = spark.range(400).select(
        F.lit("a").alias("symbol"), (F.col("id") * 7_000_003).alias("us"), F.col("id").alias("trade_id"),
        (100 + F.col("id") % 13).cast("double").alias("price"), (1 + F.col("id") % 3).cast("double").alias("size"),
        F.when(F.col("id") % 5 < 2, 1).otherwise(-1).alias("aggressor"),
    )
    rows = spark.range(300).select(F.lit("a").alias("symbol"), (F.col("id") * 9_000_011).alias("us"), F.col("id").alias("seq"))
    settings = fills.FillSettings(clip=4.0)
    groups = fills.stamp_groups(prints, settings)
    both = fills.both_sides(rows)
    whole = fills.round_trips(both, rows, groups, 60, settings, flatten=False)
    rule = fills.round_trips(both, rows, groups, 60, settings, flatten=False, brackets=False)
    assert "entry_stale" not in rule.columns and "exit_pessimistic" not in rule.columns
    order = ["side", "seq"]
    want = whole.select(rule.columns).orderBy(*order).collect()
    assert len(want) > 400 and rule.orderBy(*order).collect() == want


def test_extremes_of_ranges():
    import numpy as np

    from tickloom.operators.ranges import extreme_of

    rng = np.random.default_rng(5)
    x = rng.normal(size=70)
    x[rng.random(70) < 0.2] = np.nan
    low, high = (rng.integers(0, 71, 500) for _ in range(2))
    for extreme, plain in ((np.fmax, max), (np.fmin, min)):
        got = extreme_of(x, extreme, low, np.maximum(low, high))
        want = [plain((v for v in x[a:b] if v == v), default=np.nan) for a, b in zip(low, np.maximum(low, high), strict=True)]
        assert np.array_equal(got, want, equal_nan=True)
    assert len(extreme_of(x[:0], np.fmax, low[:0], high[:0])) == 0
