"""Runs of equal labels (events) and one entry per event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import US
from tickloom.operators.chunks import BOOK, Layout, chunked, own, running
from tickloom.operators.trades import TIME_BUCKET, greedy_entries


def runs(rows: DataFrame, label: str, max_gap_s: float, layout: Layout = BOOK) -> DataFrame:
    """Rows with the id of their run: the label changes, or the gap is longer than allowed."""
    cut = chunked(rows, layout, rows_back=1)
    w = layout.window()
    was, gap = F.lag(label).over(w), F.col("us") - F.lag("us").over(w)
    new = was.isNull() | (was != F.col(label)) | (gap > round(max_gap_s * US))
    marked = own(cut.select(*rows.columns, "_chunk", "_own", new.cast("long").alias("_new")))
    return running(marked, {"run": F.col("_new")}, layout).drop("_new")


def first_of_events(
    rows: DataFrame, label: str, *, max_gap_s: float, cooldown_s: float, layout: Layout = BOOK
) -> DataFrame:
    """The first row of each traded event; the next event must start a cooldown after its end."""
    spans = (
        runs(rows, label, max_gap_s, layout)
        .groupBy("symbol", "run")
        .agg(
            F.min(F.struct("us", "seq", F.col(label).alias("side"))).alias("a"),
            F.max("us").alias("b"),
        )
        .select("symbol", "a.us", "a.seq", "a.side", "b")
        .filter("side != 0")
    )
    free = F.greatest(F.col("b") + round(cooldown_s * US), F.col("us") + 1)
    picked = greedy_entries(
        spans.withColumn("free_at", free), ["symbol"], at="us", bucket=TIME_BUCKET
    )
    return picked.select("symbol", "us", "seq", "side")
