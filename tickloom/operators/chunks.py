"""Time-ordered windows that never put a whole instrument into one task.

A window partitioned by ``symbol`` alone puts every row of the busiest instrument into one
task. Here an instrument's rows are cut into consecutive *chunks* of about ``chunk_rows`` rows.
Each chunk also receives the rows before (and after) it that its windows can reach, marked
``_own = False`` and dropped when the window has been computed. The cut is exact: a window over
``(key, _chunk)`` sees the same frame as a window over ``key``.

The cut is planned on a summary with one line per ``(key, time bucket)``. That summary is
map-side combined, small, and joined back; adaptive execution decides from its measured size
whether it is broadcast.

Unbounded frames (last known value, running sums) use the usual two-level scan: within the
bucket, then over one summary line per bucket, then the carry joined back.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


#: No chunk is planned for more rows than this; tests lower it to cut small tables too.
MAX_CHUNK_ROWS = 1 << 20


@dataclass(frozen=True)
class Layout:
    """How a plane is keyed, ordered and cut."""

    key: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("us", "seq")
    bucket_s: float = 3600.0
    chunk_rows: int = MAX_CHUNK_ROWS
    us: str = "us"

    def with_order(self, *order: str) -> Layout:
        return replace(self, order=tuple(order))

    def bucket(self) -> Column:
        return F.floor(F.col(self.us) / F.lit(int(self.bucket_s * 1_000_000))).cast("long")

    def window(self) -> WindowSpec:
        """The window over one chunk, in the plane's order."""
        return Window.partitionBy(*self.key, "_chunk").orderBy(*self.order)

    def time_window(self) -> WindowSpec:
        """The same chunk ordered by the stamp alone, for RANGE frames."""
        return Window.partitionBy(*self.key, "_chunk").orderBy(self.us)


@dataclass(frozen=True)
class SameRows:
    """A cheap frame with ``key`` and ``us`` of exactly the rows of another, save for extra rows
    before the first of a key: what a chunk plan may be counted on in that frame's place."""

    rows: DataFrame


BOOK = Layout()
PRINTS = Layout(order=("us", "trade_id"))
BARS = Layout(order=("us",), bucket_s=86_400.0 * 7)
DAILY = Layout(order=("us",), bucket_s=86_400.0 * 90)


def chunk_map(
    spine: DataFrame,
    layout: Layout,
    rows_back: int = 0,
    rows_ahead: int = 0,
    secs_back: float = 0.0,
    secs_ahead: float = 0.0,
) -> DataFrame:
    """Per ``(key, bucket)``: its own chunk and the range of chunks that must see its rows."""
    key = list(layout.key)
    size = min(layout.chunk_rows, MAX_CHUNK_ROWS)
    by_bucket = Window.partitionBy(*key).orderBy("_bucket")
    counts = (
        spine.select(*key, layout.bucket().alias("_bucket"))
        .groupBy(*key, "_bucket")
        .agg(F.count(F.lit(1)).alias("_cnt"))
        .select(
            *key,
            "_bucket",
            "_cnt",
            F.sum("_cnt")
            .over(by_bucket.rowsBetween(Window.unboundedPreceding, 0))
            .alias("_end"),
        )
        .select(
            *key,
            "_bucket",
            "_end",
            (F.col("_end") - F.col("_cnt")).alias("_start"),
        )
        .withColumn("_c", F.floor(F.col("_start") / F.lit(size)).cast("long"))
    )
    # Rows are counted back (ahead) from what a time look-back reaches, so the two add up.
    counts = counts.withColumn("_late", F.col("_c")).withColumn("_soon", F.col("_c"))
    if secs_back > 0:
        reach = by_bucket.rangeBetween(0, math.ceil(secs_back / layout.bucket_s))
        counts = counts.withColumn("_late", F.max("_c").over(reach))
    if secs_ahead > 0:
        reach = by_bucket.rangeBetween(-math.ceil(secs_ahead / layout.bucket_s), 0)
        counts = counts.withColumn("_soon", F.min("_c").over(reach))
    highs: list[Column] = [F.col("_late")]
    lows: list[Column] = [F.col("_soon")]
    if rows_back > 0:
        reach = Window.partitionBy(*key).orderBy("_start").rangeBetween(0, rows_back - 1)
        counts = counts.withColumn("_h", F.max("_late").over(reach))
        highs.append(F.lead("_h").over(by_bucket))
    if rows_ahead > 0:
        reach = Window.partitionBy(*key).orderBy("_end").rangeBetween(-(rows_ahead - 1), 0)
        counts = counts.withColumn("_l", F.min("_soon").over(reach))
        lows.append(F.lag("_l").over(by_bucket))
    high = F.greatest(*highs) if len(highs) > 1 else highs[0]
    low = F.least(*lows) if len(lows) > 1 else lows[0]
    return counts.select(*key, "_bucket", "_c", low.alias("_lo"), high.alias("_hi"))


def chunked(
    df: DataFrame,
    layout: Layout = BOOK,
    *,
    rows_back: int = 0,
    rows_ahead: int = 0,
    secs_back: float = 0.0,
    secs_ahead: float = 0.0,
    spine: SameRows | DataFrame | None = None,
) -> DataFrame:
    """``df`` with ``_chunk`` and ``_own``, ready for windows over ``layout.window()``.

    ``spine`` is a cheap frame holding ``key`` and ``us``, used for the summary so that an
    expensive ``df`` is not computed twice. Look-backs counted in rows need its rows to be those of
    ``df``, so they are planned on ``df`` itself unless the spine is declared ``SameRows``; time
    look-backs may use any spine that covers the buckets. A bucket the spine lacks is an error.
    """
    same = isinstance(spine, SameRows)
    if spine is None or ((rows_back or rows_ahead) and not same):
        counted = df
    else:
        counted = spine.rows if same else spine
    plan = chunk_map(counted, layout, rows_back, rows_ahead, secs_back, secs_ahead)
    key = list(layout.key)
    joined = df.withColumn("_bucket", layout.bucket()).join(plan, [*key, "_bucket"], "left")
    if counted is not df:
        lacking = F.raise_error(F.lit("the spine lacks a bucket of the frame it stands for"))
        joined = joined.withColumn("_lo", F.when(F.col("_c").isNull(), lacking.cast("long")).otherwise(F.col("_lo")))
    spread = joined.withColumn("_chunk", F.explode(F.sequence("_lo", "_hi")))
    return spread.withColumn("_own", F.col("_chunk") == F.col("_c")).drop(
        "_bucket", "_c", "_lo", "_hi"
    )


def own(df: DataFrame) -> DataFrame:
    """Drop the rows a chunk only borrowed."""
    return df.filter("_own").drop("_chunk", "_own")


def last_known(
    df: DataFrame,
    values: Mapping[str, Column],
    layout: Layout = BOOK,
    *,
    forward: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Add, per row, the last non-null value of each expression at or before it.

    ``forward`` looks at or after instead; ``strict`` leaves the row itself out. Two levels:
    the bucket's own rows, then one summary line per bucket.
    """
    key = list(layout.key)
    names = list(values)
    desc = [F.desc(c) for c in layout.order]
    order = desc if forward else list(layout.order)
    local = Window.partitionBy(*key, "_bucket").orderBy(*order)
    frame = local.rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    staged = df.withColumn("_bucket", layout.bucket()).select(
        "*", *[values[n].alias(f"_v_{n}") for n in names]
    )
    stamp = F.struct(*layout.order)
    pick = F.min_by if forward else F.max_by
    summary = staged.groupBy(*key, "_bucket").agg(
        *[
            pick(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), stamp)).alias(f"_s_{n}")
            for n in names
        ]
    )
    over = Window.partitionBy(*key).orderBy(F.desc("_bucket") if forward else "_bucket")
    carry = summary.select(
        *key,
        "_bucket",
        *[
            F.last(f"_s_{n}", ignorenulls=True)
            .over(over.rowsBetween(Window.unboundedPreceding, -1))
            .alias(f"_k_{n}")
            for n in names
        ],
    )
    inside = staged.select(
        "*", *[F.last(f"_v_{n}", ignorenulls=True).over(frame).alias(f"_l_{n}") for n in names]
    )
    joined = inside.join(carry, [*key, "_bucket"], "left")
    return joined.select(
        *df.columns,
        *[F.coalesce(f"_l_{n}", f"_k_{n}").alias(n) for n in names],
    )


def running(
    df: DataFrame,
    sums: Mapping[str, Column],
    layout: Layout = BOOK,
    *,
    minima: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Running sums, minima and maxima per key, by the same two-level scan."""
    key = list(layout.key)
    kinds = (
        [(n, c, F.sum) for n, c in sums.items()]
        + [(n, c, F.min) for n, c in (minima or {}).items()]
        + [(n, c, F.max) for n, c in (maxima or {}).items()]
    )
    local = Window.partitionBy(*key, "_bucket").orderBy(*layout.order)
    frame = local.rowsBetween(Window.unboundedPreceding, 0)
    staged = df.withColumn("_bucket", layout.bucket()).select(
        "*", *[c.alias(f"_v_{n}") for n, c, _ in kinds]
    )
    over = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        staged.groupBy(*key, "_bucket")
        .agg(*[f(f"_v_{n}").alias(f"_s_{n}") for n, _, f in kinds])
        .select(*key, "_bucket", *[f(f"_s_{n}").over(over).alias(f"_k_{n}") for n, _, f in kinds])
    )
    inside = staged.select("*", *[f(f"_v_{n}").over(frame).alias(f"_l_{n}") for n, _, f in kinds])
    joined = inside.join(summary, [*key, "_bucket"], "left")

    def merged(name: str, fn: object) -> Column:
        here, before = F.col(f"_l_{name}"), F.col(f"_k_{name}")
        if fn is F.sum:
            both = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
            return F.when(here.isNotNull() | before.isNotNull(), both)
        return F.least(here, before) if fn is F.min else F.greatest(here, before)

    return joined.select(*df.columns, *[merged(n, f).alias(n) for n, _, f in kinds])


def numbered(df: DataFrame, layout: Layout = BOOK, name: str = "row") -> DataFrame:
    """A gap-free row number per key (from 1), without one task per key."""
    return running(df, {name: F.lit(1).cast("long")}, layout)


def with_columns_over(
    df: DataFrame, stages: Sequence[Mapping[str, Column]], keep: Sequence[str] | None = None
) -> DataFrame:
    """Apply stages of window columns in order; all share the chunk's one sort."""
    for stage in stages:
        df = df.select("*", *[c.alias(n) for n, c in stage.items()])
    return df if keep is None else df.select(*keep)
