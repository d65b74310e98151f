"""As-of joins: nearest earlier or later row, with exact tie rules, and what is built on them.

The two sides are unioned, ordered once, and the nearest row of the right side is carried onto
the left rows. With a tolerance the carry never looks further than the tolerance, so chunks with
a bounded look-back are enough; without one the two-level scan of ``last_known`` is used. No task
holds a whole instrument, and no range join is needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import US, day_of
from tickloom.operators.chunks import Layout, chunked, last_known, own, running
from tickloom.session import materialised

PAIRED = Layout(order=("us", "_tag", "_tie"))


def _union(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    key: Sequence[str],
    left_us: Column,
    left_tie: str,
    right_tie: str,
    right_first: bool,
) -> DataFrame:
    left_tag, right_tag = (1, 0) if right_first else (0, 1)
    packed_left = F.struct(*left.columns)
    packed_right = F.struct(F.col("us").alias("r_us"), *[F.col(v) for v in values])
    a = left.select(
        *key,
        left_us.cast("long").alias("us"),
        F.lit(left_tag).alias("_tag"),
        F.col(left_tie).cast("long").alias("_tie"),
        packed_left.alias("_l"),
    )
    b = right.select(
        *key,
        F.col("us").cast("long").alias("us"),
        F.lit(right_tag).alias("_tag"),
        F.col(right_tie).cast("long").alias("_tie"),
        packed_right.alias("_r"),
    )
    return a.unionByName(b, allowMissingColumns=True)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    *,
    key: Sequence[str] = ("symbol",),
    at: Column | None = None,
    left_tie: str = "seq",
    right_tie: str = "seq",
    tolerance_s: float | None = None,
    strict: bool = False,
    forward: bool = False,
    names: Mapping[str, str] | None = None,
    layout: Layout | None = None,
    spine: DataFrame | None = None,
    stored: bool = False,
) -> DataFrame:
    """``left`` with ``values`` and ``r_us`` of the nearest right row.

    Backward by default: the last right row stamped at or before ``at`` (default: the row's own
    ``us``), or strictly before with ``strict``. ``forward`` takes the first at or after (after
    with ``strict``). A match further than ``tolerance_s`` is missing. ``names`` renames outputs.
    ``stored`` writes ``left`` to the shared folder first: the scan reads its input twice, so a left
    side that is itself the result of an as-of join would otherwise be computed again and again.
    """
    if stored:
        left = materialised(left)
    when = F.col("us") if at is None else at
    lay = layout or Layout(key=tuple(key), order=("us", "_tag", "_tie"))
    # Backward and inclusive: right rows sort first on a tie. Strict or forward flips it once.
    right_first = strict == forward
    both = _union(left, right, values, key, when, left_tie, right_tie, right_first)
    if tolerance_s is None:
        joined = last_known(both, {"_m": F.col("_r")}, lay, forward=forward)
        match = F.col("_m")
        kept = joined.filter(F.col("_l").isNotNull())
    else:
        reach = {"secs_ahead": tolerance_s} if forward else {"secs_back": tolerance_s}
        cut = chunked(both, lay, spine=spine, **reach)
        w = lay.window()
        if forward:
            near = F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        else:
            near = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        limit = round(tolerance_s * US)
        gap = F.abs(F.col("us") - F.col("_n.r_us"))
        kept = own(cut.withColumn("_n", near).filter(F.col("_l").isNotNull()))
        match = F.when(gap <= limit, F.col("_n"))
    rename = dict(names or {})
    return kept.withColumn("_m", match).select(
        "_l.*",
        *[F.col(f"_m.{v}").alias(rename.get(v, v)) for v in ["r_us", *values]],
    )


def count_through(left: DataFrame, right: DataFrame, name: str = "n_before") -> DataFrame:
    """For each left row, how many right rows are stamped at or before it."""
    both = _union(left, right, [], ["symbol"], F.col("us"), "seq", "trade_id", True)
    counted = running(both, {name: F.col("_r").isNotNull().cast("long")}, PAIRED)
    return counted.filter(F.col("_l").isNotNull()).select("_l.*", name)


def bucket_prints(
    rows: DataFrame, prints: DataFrame, *, containing: bool = False
) -> DataFrame:
    """Sums of the prints each row owns, zero where it owns none.

    By default a print belongs to the first row stamped at or after it. With ``containing`` it
    belongs to the row whose interval it falls into (the last row at or before it).
    """
    mid = (F.col("bid_price_0") + F.col("ask_price_0")) / 2
    placed = asof_join(
        prints,
        rows.select("symbol", "us", "seq"),
        ["seq"],
        left_tie="trade_id",
        forward=not containing,
    ).filter(F.col("r_us").isNotNull())
    notional = F.col("size") * F.col("price")
    buy = F.col("aggressor") > 0
    sums = placed.groupBy("symbol", F.col("r_us").alias("us"), "seq").agg(
        F.sum(F.when(buy, F.col("size")).otherwise(0.0)).alias("buy_volume"),
        F.sum(F.when(~buy, F.col("size")).otherwise(0.0)).alias("sell_volume"),
        F.count(F.lit(1)).cast("double").alias("trade_count"),
        F.sum(F.col("aggressor") * notional).alias("signed_notional"),
        F.sum(notional).alias("traded_notional"),
        F.max(notional).alias("largest_trade"),
    )
    joined = rows.select("symbol", "us", "seq", mid.alias("mid")).join(
        sums, ["symbol", "us", "seq"], "left"
    )
    names = (
        "buy_volume sell_volume trade_count signed_notional traded_notional largest_trade"
    ).split()
    volume = F.col("buy_volume") + F.col("sell_volume")
    vwap = F.try_divide("traded_notional", volume)
    return joined.select(
        "symbol",
        "us",
        "seq",
        "mid",
        *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names],
        F.coalesce((vwap / F.col("mid") - 1) * 1e4, F.lit(0.0)).alias("vwap_deviation_bp"),
    )


def entry_exit(
    decisions: DataFrame,
    book: DataFrame,
    values: Sequence[str],
    *,
    hold_s: float,
    latency_ms: float = 10.0,
) -> DataFrame:
    """Entry row: the first at or after the decision plus latency; exit row: the first at or
    after the entry's stamp plus the hold. Missing where no row follows."""
    columns = {v: f"entry_{v}" for v in values} | {"r_us": "entry_us"}
    entry = asof_join(
        decisions,
        book,
        values,
        at=F.col("us") + round(latency_ms * 1000),
        forward=True,
        names=columns,
    )
    columns = {v: f"exit_{v}" for v in values} | {"r_us": "exit_us"}
    # A decision without an entry cannot have an exit: it looks from beyond every stamp.
    at = F.col("entry_us") + round(hold_s * US)
    found = asof_join(
        entry.filter(F.col("entry_us").isNotNull()),
        book,
        values,
        at=at,
        forward=True,
        names=columns,
        stored=True,
    )
    return found.unionByName(
        entry.filter(F.col("entry_us").isNull()), allowMissingColumns=True
    )


def symbol_pairs(df: DataFrame, values: Sequence[str], on: str = "us") -> DataFrame:
    """Every unordered pair of symbols on their common stamps."""
    a = df.select(on, F.col("symbol").alias("a"), *[F.col(v).alias(f"{v}_a") for v in values])
    b = df.select(on, F.col("symbol").alias("b"), *[F.col(v).alias(f"{v}_b") for v in values])
    return a.join(b, on).filter("a < b")


def with_every_day(df: DataFrame, days: DataFrame, key: str = "symbol") -> DataFrame:
    """Rows whose key has every day of the calendar (left semi)."""
    wanted = days.select("day").distinct()
    need = wanted.agg(F.count(F.lit(1)).alias("need"))
    full = (
        df.withColumn("day", day_of("us"))
        .select(key, "day")
        .distinct()
        .join(wanted, "day", "left_semi")
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("have"))
        .join(F.broadcast(need))  # one row
        .filter("have = need")
    )
    return df.join(full, key, "left_semi")


def refuse_outside(df: DataFrame, grid: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not on the registered grid (left anti); callers raise on any."""
    return df.join(grid, list(on), "left_anti")


def rotated(df: DataFrame, shift: int, *, values: Sequence[str], n: str = "n", row: str = "row") -> DataFrame:
    """Each row takes its values from row ``(row + shift) mod n`` of its key."""
    source = df.select(
        "symbol", F.col(row).alias("_src"), *[F.col(v).alias(f"{v}_rotated") for v in values]
    )
    target = df.withColumn("_src", F.pmod(F.col(row) + F.lit(shift), F.col(n)))
    return target.join(source, ["symbol", "_src"]).drop("_src")
