"""Data quality as aggregates: one pass per plane, findings as rows.

Findings carry ``check, severity, symbol, count``. Arrival order is an explicit column, because
a DataFrame has none of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import US, day_of
from tickloom.operators.chunks import BOOK, Layout, chunked, own
from tickloom.operators.quantiles import quantile_by

ERROR, WARNING, INFO = "error", "warning", "info"
#: Rows of arrival order a chunk bucket holds.
ARRIVAL_WIDTH = 1 << 16


def arrival_layout(column: str, width: int = ARRIVAL_WIDTH) -> Layout:
    """A layout that runs along an arrival counter instead of time."""
    return Layout(order=(column,), us=column, bucket_s=width / 1e6)


def findings(per_symbol: DataFrame, checks: Sequence[tuple[str, str]]) -> DataFrame:
    """Unpivot one wide row per symbol into findings; checks with nothing found give no row."""
    items = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                F.lit(severity).alias("severity"),
                F.col(name).cast("long").alias("count"),
            )
            for name, severity in checks
        ]
    )
    return (
        per_symbol.select("symbol", F.explode(items).alias("f"))
        .select("f.check", "f.severity", "symbol", "f.count")
        .filter("count > 0")
    )


def raise_if_failed(report: DataFrame) -> None:
    """Raise when any finding is an error. Reads one aggregate row."""
    worst = report.filter(F.col("severity") == ERROR).agg(
        F.count(F.lit(1)).alias("n"), F.min("check").alias("first")
    ).first()
    if worst is not None and worst["n"]:
        raise ValueError(f"{worst['n']} failed check(s), the first {worst['first']}")


def examples(df: DataFrame, broken: Column, order: Sequence[str], n: int = 3) -> DataFrame:
    """The first rows that break a rule (a report of ``n`` rows)."""
    return df.filter(broken).orderBy(*order).limit(n)


def timestamp_checks(df: DataFrame, arrival: str) -> DataFrame:
    """Null stamps, stamps that go backwards in arrival order, and the span covered."""
    layout = arrival_layout(arrival)
    stamped = df.select("symbol", "us", arrival)
    cut = chunked(stamped.filter(F.col("us").isNotNull()), layout, rows_back=1)
    back = F.col("us") < F.lag("us").over(layout.window())
    steps = own(cut.select("symbol", "us", "_chunk", "_own", back.alias("_back")))
    moved = steps.groupBy("symbol").agg(
        F.count_if("_back").alias("timestamp_monotonic"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
    )
    missing = stamped.groupBy("symbol").agg(F.count_if(F.col("us").isNull()).alias("timestamp_null"))
    return missing.join(moved, "symbol", "left").select(
        "symbol",
        "timestamp_null",
        F.coalesce("timestamp_monotonic", F.lit(0)).alias("timestamp_monotonic"),
        "first_us",
        "last_us",
    )


def positive_checks(
    df: DataFrame, columns: Sequence[str], *, allow_zero: bool = False
) -> DataFrame:
    """Per column and symbol: values that are missing, negative or (unless allowed) zero."""

    def bad(c: str) -> Column:
        low = F.col(c) < 0 if allow_zero else F.col(c) <= 0
        return F.count_if(F.col(c).isNull() | low).alias(c)

    wide = df.groupBy("symbol").agg(*[bad(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("bad")) for c in columns])
    return wide.select("symbol", F.explode(rows).alias("r")).select("symbol", "r.column", "r.bad")


def id_checks(df: DataFrame, column: str, arrival: str) -> DataFrame:
    """Duplicate ids, ids that go back or stand still, jumps and the ids they skip."""
    layout = arrival_layout(arrival)
    cut = chunked(df.select("symbol", column, arrival), layout, rows_back=1)
    step = F.col(column) - F.lag(column).over(layout.window())
    steps = own(cut.select("symbol", column, "_chunk", "_own", step.alias("_step")))
    moved = steps.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_step") < 0).alias("decreasing"),
        F.count_if(F.col("_step") <= 0).alias("not_increasing"),
        F.count_if(F.col("_step") > 1).alias("gaps"),
        F.coalesce(F.sum(F.when(F.col("_step") > 1, F.col("_step") - 1)), F.lit(0)).alias("missing"),
    )
    # Distinct ids counted in two steps, so a busy symbol's ids spread over the cluster.
    distinct = (
        df.select("symbol", column).distinct().groupBy("symbol").agg(F.count(F.lit(1)).alias("_d"))
    )
    return moved.join(distinct, "symbol").select(
        "symbol",
        (F.col("rows") - F.col("_d")).alias("duplicates"),
        "decreasing",
        "not_increasing",
        "gaps",
        "missing",
    )


def bar_checks(bars: DataFrame) -> DataFrame:
    """Bars whose open or close leaves the range, that close before they open, or repeat."""
    low_body = F.least("open", "close")
    high_body = F.greatest("open", "close")
    rows = bars.groupBy("symbol").agg(
        F.count_if((F.col("low") > low_body) | (F.col("high") < high_body)).alias("bar_range"),
        F.count_if(F.col("open_us") >= F.col("us")).alias("bar_order"),
        F.count(F.lit(1)).alias("_rows"),
    )
    closes = bars.select("symbol", "us").distinct().groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_closes")
    )
    return rows.join(closes, "symbol").select(
        "symbol", "bar_range", "bar_order", (F.col("_rows") - F.col("_closes")).alias("bar_unique")
    )


def crossed_checks(book: DataFrame) -> DataFrame:
    """Crossed (error) and locked (warning) snapshots."""
    return book.groupBy("symbol").agg(
        F.count_if(F.col("bid_price_0") > F.col("ask_price_0")).alias("not_crossed"),
        F.count_if(F.col("bid_price_0") == F.col("ask_price_0")).alias("not_locked"),
    )


def level_order_checks(book: DataFrame, depth: int) -> DataFrame:
    """Per level pair: snapshots whose bids do not fall or asks do not rise away from the touch."""
    pairs = [(i, i + 1) for i in range(depth - 1)]
    wide = book.groupBy("symbol").agg(
        *[
            F.struct(
                F.count_if(F.col(f"bid_price_{i}") <= F.col(f"bid_price_{j}")).alias("bids"),
                F.count_if(F.col(f"ask_price_{i}") >= F.col(f"ask_price_{j}")).alias("asks"),
            ).alias(f"p{i}")
            for i, j in pairs
        ]
    )
    rows = F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"p{i}").alias("p")) for i, _ in pairs])
    return wide.select("symbol", F.explode(rows).alias("r")).select(
        "symbol", "r.level", F.col("r.p.bids").alias("bad_bids"), F.col("r.p.asks").alias("bad_asks")
    )


def time_gaps(df: DataFrame, layout: Layout = BOOK) -> DataFrame:
    """Long pauses per symbol: threshold, count, longest, share of the span, median spacing.

    A pause counts when it exceeds 30 s or 5 % of the span, whichever is less, and at least 1 ms.
    """
    cut = chunked(df.select("symbol", *layout.order), layout, rows_back=1)
    gap = F.col("us") - F.lag("us").over(layout.window())
    gaps = own(cut.select("symbol", "us", "_chunk", "_own", gap.alias("gap")))
    span = gaps.groupBy("symbol").agg(
        (F.max("us") - F.min("us")).alias("span"), F.count(F.lit(1)).alias("rows")
    )
    threshold = F.greatest(
        F.lit(1000.0), F.least(F.lit(30.0 * US), F.col("span") * 0.05)
    )
    limits = span.filter("rows >= 3").withColumn("threshold", threshold)
    judged = gaps.filter(F.col("gap").isNotNull()).join(limits, "symbol")
    long_ = F.col("gap") > F.col("threshold")
    counted = judged.groupBy("symbol", "threshold", "span").agg(
        F.count_if(long_).alias("pauses"),
        F.max("gap").alias("longest"),
        F.coalesce(F.sum(F.when(long_, F.col("gap"))), F.lit(0)).alias("lost"),
    )
    middle = quantile_by(gaps, ["symbol"], "gap", 0.5, "median_gap")
    return counted.join(middle, "symbol").select(
        "symbol",
        "threshold",
        "pauses",
        "longest",
        "median_gap",
        F.try_divide(F.col("lost"), F.col("span")).alias("share_lost"),
    )


def longest_gaps(df: DataFrame, n: int = 3, layout: Layout = BOOK) -> DataFrame:
    """The ``n`` longest pauses per symbol (a top-k report; ties by time)."""
    cut = chunked(df.select("symbol", *layout.order), layout, rows_back=1)
    gap = F.col("us") - F.lag("us").over(layout.window())
    gaps = own(cut.select("symbol", "us", "_chunk", "_own", gap.alias("gap"))).filter(
        F.col("gap").isNotNull()
    )
    # First per hour, then per symbol: no task sorts a whole instrument.
    hour = F.floor(F.col("us") / F.lit(3600 * US))
    order = [F.desc("gap"), F.asc("us")]
    inner = Window.partitionBy("symbol", "_h").orderBy(*order)
    outer = Window.partitionBy("symbol").orderBy(*order)
    few = gaps.withColumn("_h", hour).withColumn("_n", F.row_number().over(inner)).filter(
        F.col("_n") <= n
    )
    return few.withColumn("rank", F.row_number().over(outer)).filter(F.col("rank") <= n).select(
        "symbol", "rank", "us", "gap"
    )


def validate_trades(trades: DataFrame, arrival: str) -> DataFrame:
    """All findings of the trades plane."""
    stamps = timestamp_checks(trades, arrival)
    ids = id_checks(trades, "trade_id", arrival)
    values = positive_checks(trades, ["price", "quantity"]).groupBy("symbol").agg(
        F.sum("bad").alias("positive_values")
    )
    wide = stamps.join(ids, "symbol").join(values, "symbol").select(
        "symbol",
        "timestamp_null",
        "timestamp_monotonic",
        "positive_values",
        F.col("duplicates").alias("trade_id_unique"),
        F.col("gaps").alias("trade_id_gaps"),
        F.col("decreasing").alias("trade_id_monotonic"),
    )
    return findings(
        wide,
        [
            ("timestamp_null", ERROR),
            ("timestamp_monotonic", ERROR),
            ("positive_values", ERROR),
            ("trade_id_unique", ERROR),
            ("trade_id_gaps", INFO),
            ("trade_id_monotonic", ERROR),
        ],
    )


def day_exclusions(
    book: DataFrame, tick: float, max_gaps: Column | float, sequence: str = "seq"
) -> DataFrame:
    """Per (symbol, day): the reasons it is left out of every verdict."""
    layout = BOOK
    cut = chunked(book, layout, rows_back=1)
    step = F.col(sequence) - F.lag(sequence).over(layout.window())
    rows = own(
        cut.select(
            "symbol", "us", "bid_price_0", "ask_price_0", "_chunk", "_own", step.alias("_step")
        )
    )
    prices = [F.col("bid_price_0"), F.col("ask_price_0")]
    off = [F.abs(F.round(p / tick) * tick - p) > 1e-6 * tick for p in prices]
    facts = rows.groupBy("symbol", day_of("us").alias("day")).agg(
        F.count_if((prices[0] <= 0) | (prices[1] <= 0)).alias("non_positive"),
        F.count_if(off[0] | off[1]).alias("off_grid"),
        F.count_if(F.col("_step") > 1).alias("gaps"),
    )
    limit = max_gaps if isinstance(max_gaps, Column) else F.lit(max_gaps)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("non_positive") > 0, F.lit("non_positive_price")),
            F.when(F.col("off_grid") > 0, F.lit("off_grid_price")),
            F.when(F.col("gaps") > limit, F.lit("sequence_gaps")),
        )
    )
    return facts.select("symbol", "day", "gaps", reasons.alias("reasons"))


def exclusion_counts(days: DataFrame) -> DataFrame:
    """Excluded days by reason; a day with two reasons counts under each."""
    return (
        days.select(F.explode("reasons").alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("days"))
    )


def block_unreadable(days: DataFrame) -> DataFrame:
    """Per symbol: whether more than a quarter of the days are excluded."""
    out = days.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("days"), F.count_if(F.size("reasons") > 0).alias("excluded")
    )
    return out.withColumn("unreadable", F.col("excluded") * 4 > F.col("days"))


def gap_allowance(days: DataFrame) -> DataFrame:
    """One row: the 95th percentile of per-day gap counts, rounded up (float noise removed)."""
    return days.agg(
        F.ceil(F.round(F.percentile("gaps", F.lit(0.95)), 9)).alias("max_sequence_gaps")
    )


def _gcd_fold(values: Column) -> Column:
    """Greatest common divisor of a short array of longs, by Euclid's steps."""

    def gcd(a: Column, b: Column) -> Column:
        # 96 halving-or-better steps cover any pair of longs.
        steps = F.sequence(F.lit(1), F.lit(96))
        start = F.struct(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
        return F.aggregate(
            steps,
            start,
            lambda s, _: F.when(s["y"] == 0, s).otherwise(
                F.struct(s["y"].alias("x"), F.pmod(s["x"], F.nullif(s["y"], F.lit(0).cast("long"))).alias("y"))
            ),
            lambda s: s["x"],
        )

    return F.aggregate(values, F.lit(0).cast("long"), gcd)


def grid_step(
    df: DataFrame, value: Column, name: str, *, differences: bool = True, decimals: int = 8
) -> DataFrame:
    """Greatest common divisor per symbol: of differences of distinct prices, or of sizes.

    Values become whole multiples of ``10**-decimals``. Divisors are folded per slice of the
    value range first, then over the slices, so distinct values never meet in one array.
    """
    scale = 10**decimals
    whole = df.select("symbol", F.round(value * scale).cast("long").alias("v")).distinct()
    base = whole.groupBy("symbol").agg(F.min("v").alias("low"))
    shifted = (
        whole.join(base, "symbol").select("symbol", (F.col("v") - F.col("low")).alias("v"))
        if differences
        else whole
    )
    positive = shifted.filter("v > 0")
    sliced = positive.groupBy("symbol", F.pmod(F.xxhash64("v"), F.lit(4096)).alias("_s")).agg(
        F.collect_list("v").alias("vs")
    )
    halves = sliced.select("symbol", _gcd_fold(F.col("vs")).alias("v"))
    return (
        halves.groupBy("symbol")
        .agg(F.collect_set("v").alias("vs"))
        .select("symbol", (_gcd_fold(F.col("vs")) / F.lit(float(scale))).alias(name))
    )


def off_grid_rows(df: DataFrame, value: str, steps: DataFrame, step: str) -> DataFrame:
    """Per symbol: values that are no multiple of their step (relative 1e-6)."""
    joined = df.select("symbol", value).join(steps, "symbol")
    away = F.abs(F.round(F.col(value) / F.col(step)) * F.col(step) - F.col(value))
    return joined.groupBy("symbol").agg(F.count_if(away > F.col(step) * 1e-6).alias("off_grid"))


def settlement_interval(funding: DataFrame, *, refuse: bool = True) -> DataFrame:
    """Hours between settlements: one whole number on its own boundary, else refused.

    NULL with fewer than two settlements.
    """
    w = Window.partitionBy("symbol").orderBy("us")
    gaps = funding.select("symbol", "us", (F.col("us") - F.lag("us").over(w)).alias("gap"))
    hour = F.lit(3600 * US)
    facts = gaps.groupBy("symbol").agg(
        F.min("gap").alias("low"),
        F.max("gap").alias("high"),
        F.min("us").alias("first"),
    )
    uniform = (F.col("low") == F.col("high")) & (F.pmod(F.col("low"), hour) == 0)
    on_grid = F.pmod(F.col("first"), F.nullif(F.col("low"), F.lit(0).cast("long"))) == 0
    hours = (F.col("low") / hour).cast("long")
    bad = (
        F.raise_error(F.concat(F.lit("settlements are not uniform: "), F.col("symbol"))).cast("long")
        if refuse
        else F.lit(-1).cast("long")
    )
    value = (
        F.when(F.col("low").isNull(), F.lit(None).cast("long"))
        .when(uniform & on_grid, hours)
        .otherwise(bad)
    )
    return facts.select("symbol", value.alias("interval_h"))


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: share of rows on which every named column is present."""
    present = F.lit(True)
    for c in columns:
        present = present & F.col(c).isNotNull()
    return df.agg(F.avg(present.cast("double")).alias("coverage"))


def clock_offset_profile(
    book: DataFrame, prints: DataFrame, deltas_ms: Sequence[int] = tuple(range(-50, 51, 5))
) -> DataFrame:
    """How well prints explain touch-size changes, per clock shift (the shifts are a fixed list).

    Each print is placed in the snapshot interval its shifted stamp falls into. Only intervals in
    which the touch price stood still count.
    """
    from tickloom.operators.asof import asof_join

    layout = BOOK
    cut = chunked(
        book.select(
            "symbol",
            "us",
            "seq",
            "bid_price_0",
            "bid_size_0",
            "ask_price_0",
            "ask_size_0",
        ),
        layout,
        rows_back=1,
    )
    w = layout.window()
    steps = own(
        cut.select(
            "*",
            F.lag("bid_price_0").over(w).alias("_bp"),
            F.lag("bid_size_0").over(w).alias("_bs"),
            F.lag("ask_price_0").over(w).alias("_ap"),
            F.lag("ask_size_0").over(w).alias("_as"),
        )
    )

    def side_of(side: int, name: str, p: str, s: str) -> Column:
        return F.struct(
            F.lit(side).alias("side"),
            F.col(f"{name}_price_0").alias("touch"),
            F.col(f"{name}_size_0").alias("size_now"),
            F.col(p).alias("was"),
            F.col(s).alias("size_was"),
        )

    both = F.array(side_of(1, "bid", "_bp", "_bs"), side_of(-1, "ask", "_ap", "_as"))
    still = (
        steps.select("symbol", "us", "seq", F.explode(both).alias("t"))
        .select("symbol", "us", "seq", "t.*")
        .filter("was = touch")
    )
    shifts = F.explode(F.array(*[F.lit(int(d)) for d in deltas_ms])).alias("delta_ms")
    moved = prints.select(
        "symbol", "us", "trade_id", "price", "size", (-F.col("aggressor")).alias("side"), shifts
    )
    placed = asof_join(
        moved,
        book.select("symbol", "us", "seq"),
        ["seq"],
        at=F.col("us") + F.col("delta_ms") * 1000,
        left_tie="trade_id",
        forward=True,
        names={"seq": "row_seq", "r_us": "row_us"},
    ).filter(F.col("row_us").isNotNull())
    hits = placed.groupBy(
        "symbol", F.col("row_us").alias("us"), F.col("row_seq").alias("seq"), "side", "delta_ms", "price"
    ).agg(F.sum("size").alias("traded"))
    # The residual is size_was - traded - size_now. Rows without prints contribute the same to
    # every shift, so only rows with prints are compared per shift.
    key = ["symbol", "us", "seq", "side"]
    plain = F.col("size_was") - F.col("size_now")
    base = still.groupBy("side").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(plain * plain).alias("sq"),
        F.count_if(plain < -1e-12).alias("neg"),
    )
    touched = still.join(hits, key).filter(F.col("price") == F.col("touch"))
    left = plain - F.col("traded")
    change = touched.groupBy("side", "delta_ms").agg(
        F.sum(left * left - plain * plain).alias("d_sq"),
        F.sum((left < -1e-12).cast("int") - (plain < -1e-12).cast("int")).alias("d_neg"),
    )
    grid = base.select("*", shifts)
    scored = grid.join(change, ["side", "delta_ms"], "left").select(
        "delta_ms",
        ((F.col("sq") + F.coalesce("d_sq", F.lit(0.0))) / F.col("n")).alias("mean_sq_residual"),
        ((F.col("neg") + F.coalesce("d_neg", F.lit(0))) / F.col("n")).alias("share_negative"),
    )
    return scored.groupBy("delta_ms").agg(
        F.avg("mean_sq_residual").alias("mean_sq_residual"),
        F.avg("share_negative").alias("share_negative"),
    )


def best_clock_offset(profile: DataFrame) -> DataFrame:
    """One row: the shift with the smallest residual, the earliest on ties."""
    return profile.agg(
        F.min_by("delta_ms", F.struct("mean_sq_residual", "delta_ms")).alias("delta_ms")
    )
