"""Walk-forward folds, purging per series, retraining schedules, and stacking folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import day_of

BLOCKS = ("train", "validation", "test")


def contiguous(days: DataFrame) -> DataFrame:
    """One row: the calendar's length and whether no day is missing."""
    facts = days.select("day").distinct().agg(
        F.count(F.lit(1)).alias("days"), F.min("day").alias("first"), F.max("day").alias("last")
    )
    return facts.withColumn("unbroken", F.datediff("last", "first") + 1 == F.col("days"))


def walk_forward(
    days: DataFrame, train: int = 14, validation: int = 7, test: int = 7, step: int = 1, *, refuse: bool = True
) -> DataFrame:
    """``(fold, block, first_day, last_day)`` over a gap-free calendar."""
    span = contiguous(days)
    gap = F.raise_error(F.lit("days are not contiguous")).cast("int")
    length = F.col("days") if not refuse else F.when(F.col("unbroken"), F.col("days")).otherwise(gap)
    width = train + validation + test
    folds = span.select(
        "first", F.explode(F.sequence(F.lit(0), F.floor((length - width) / F.lit(step)).cast("int"))).alias("fold")
    )
    starts = {"train": 0, "validation": train, "test": train + validation}
    sizes = {"train": train, "validation": validation, "test": test}
    blocks = F.explode(
        F.array(
            *[F.struct(F.lit(b).alias("block"), F.lit(starts[b]).alias("a"), F.lit(sizes[b]).alias("n")) for b in BLOCKS]
        )
    ).alias("b")
    rows = folds.select("fold", "first", blocks)
    begin = F.date_add("first", (F.col("fold") * step + F.col("b.a")).cast("int"))
    return rows.select(
        "fold",
        F.col("b.block").alias("block"),
        begin.alias("first_day"),
        F.date_add(begin, (F.col("b.n") - 1).cast("int")).alias("last_day"),
    )


def assign(rows: DataFrame, folds: DataFrame, purge: int, series: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rows with their fold and block, each series' last ``purge`` rows of train and validation gone.

    The folds are a calendar (few rows). The tail of a series is found per day first: a day is
    dropped whole, kept whole, or cut, so no block is sorted in one task.
    """
    keys = list(series)
    dated = rows.withColumn("day", day_of("us"))
    counts = dated.groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("_c"))
    placed = counts.join(
        F.broadcast(folds), (F.col("day") >= F.col("first_day")) & (F.col("day") <= F.col("last_day"))
    )
    later = Window.partitionBy(*keys, "fold", "block").orderBy(F.desc("day")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    after = F.coalesce(F.sum("_c").over(later), F.lit(0))
    kept = placed.select(*keys, "day", "fold", "block", after.alias("_after"), "_c")
    tail = Window.partitionBy(*keys, "day").orderBy(F.desc("us"), F.desc("seq"))
    # Only days that can lose rows are ranked; a day further back is kept as it is.
    near = kept.filter((F.col("block") != "test") & (F.col("_after") < purge))
    cut_days = near.select(*keys, "day").distinct().withColumn("_cut", F.lit(True))
    marked = dated.join(cut_days, [*keys, "day"], "left")
    ranked = marked.filter("_cut").withColumn("_r", F.row_number().over(tail))
    whole = marked.filter("_cut IS NULL").withColumn("_r", F.lit(None).cast("int"))
    joined = ranked.unionByName(whole).join(kept, [*keys, "day"])
    keep = (F.col("block") == "test") | F.col("_r").isNull() | (F.col("_r") + F.col("_after") > purge)
    return joined.filter(keep).select(*rows.columns, "fold", "block")


def retrain_windows(days: DataFrame, train: int, every: int) -> DataFrame:
    """``(window, train_first, train_last, use_first, use_last)`` of a refit every ``every`` days."""
    span = contiguous(days)
    count = F.floor((F.col("days") - train - 1) / F.lit(every)).cast("int")
    rows = span.select("first", "last", F.explode(F.sequence(F.lit(0), count)).alias("window"))
    use = F.date_add("first", (F.lit(train) + F.col("window") * every).cast("int"))
    return rows.select(
        "window",
        F.date_sub(use, train).alias("train_first"),
        F.date_sub(use, 1).alias("train_last"),
        use.alias("use_first"),
        F.least(F.date_add(use, every - 1), F.col("last")).alias("use_last"),
    )


def split_span(days: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Chronological parts of a calendar by share, in order."""
    span = contiguous(days)
    edges = [sum(shares[:k]) for k in range(len(shares) + 1)]
    parts = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("part"), F.lit(a).alias("a"), F.lit(b).alias("b"))
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))
            ]
        )
    ).alias("p")
    rows = span.select("first", "days", parts)
    begin = F.floor(F.col("p.a") * F.col("days")).cast("int")
    end = F.floor(F.col("p.b") * F.col("days")).cast("int") - 1
    return rows.select(
        "p.part", F.date_add("first", begin).alias("first_day"), F.date_add("first", end).alias("last_day")
    )


def forward_chain(days: DataFrame, folds: int, purge_days: int) -> DataFrame:
    """Folds that fit on everything before a stretch and predict the stretch, with a gap between."""
    span = contiguous(days)
    rows = span.select("first", "days", F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold"))
    edge = lambda k: F.floor(F.col("days") * k / F.lit(folds + 1)).cast("int")
    begin, end = edge(F.col("fold")), edge(F.col("fold") + 1)
    return rows.select(
        "fold",
        F.col("first").alias("fit_first"),
        F.date_add("first", begin - 1 - purge_days).alias("fit_last"),
        F.date_add("first", begin).alias("predict_first"),
        F.date_add("first", end - 1).alias("predict_last"),
    )
