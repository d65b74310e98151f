"""Position state: one position at a time, exits on the path, and what the trades made.

Which row closes a position depends only on its entry row, so exits are found for every candidate
at once. Which candidates are then taken is sequential; it is solved chunk by chunk. A chunk
reports, for every state it can be entered with, the state it leaves; those short maps are chained
per key; then every chunk picks its entries from its known starting state. No task ever holds a
whole key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import BP, ratio
from tickloom.functions.costs import TakerCosts
from tickloom.operators.chunks import BOOK, Layout, chunk_map, chunked, numbered
from tickloom.session import materialised

CHUNK = 1 << 18
#: Rows of a bucket when the axis is a row number.
ROW_BUCKET = 1 << 16
#: Microseconds of a bucket when the axis is time.
TIME_BUCKET = 3_600_000_000


def greedy_entries(
    candidates: DataFrame,
    key: Sequence[str],
    *,
    at: str = "row",
    free: str = "free_at",
    bucket: int = ROW_BUCKET,
    chunk_rows: int = CHUNK,
) -> DataFrame:
    """Candidates taken greedily: the first, then each first one at or after the last one's ``free``.

    ``at`` and ``free`` are positions on one axis (row numbers or microseconds); ``free > at``.
    Chunks hold about ``chunk_rows`` candidates, cut on buckets of ``bucket`` positions.
    """
    keys = list(key)
    layout = Layout(
        key=tuple(keys), order=(at,), us=at, bucket_s=bucket / 1e6, chunk_rows=chunk_rows
    )
    stored = materialised(candidates)
    plan = chunk_map(stored, layout).select(*keys, "_bucket", F.col("_c").alias("_chunk"))
    # A state carried into a chunk lies within the longest hold of the chunk's first candidate.
    reach = stored.groupBy(*keys).agg(F.max(F.col(free) - F.col(at)).alias("_reach"))
    placed = (
        stored.withColumn("_bucket", layout.bucket()).join(plan, [*keys, "_bucket"]).drop("_bucket")
    )
    key_fields = [f for f in candidates.schema.fields if f.name in keys]
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields)
    key_names = [f.name for f in key_fields]

    def outcomes(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(at)
        pos, until = frame[at].to_numpy(), frame[free].to_numpy()
        nxt = np.searchsorted(pos, until, side="left")
        leaves = until.copy()
        for i in range(len(pos) - 1, -1, -1):
            if nxt[i] < len(pos):
                leaves[i] = leaves[nxt[i]]
        # The first candidate at or after any state that can be carried in, and no others.
        used = int(np.searchsorted(pos, pos[0] + frame["_reach"].iloc[0], side="left")) + 1
        head = frame.iloc[:used][[*key_names, "_chunk"]].copy()
        head["pos"], head["leaves"] = pos[:used], leaves[:used]
        return head

    maps = (
        placed.join(reach, keys)
        .groupBy(*keys, "_chunk")
        .applyInPandas(outcomes, f"{key_ddl}, _chunk long, pos long, leaves long")
    )

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        state, out = np.iinfo(np.int64).min, []
        for number, part in frame.sort_values(["_chunk", "pos"]).groupby("_chunk", sort=True):
            out.append((number, state))
            i = int(np.searchsorted(part["pos"].to_numpy(), state, side="left"))
            if i < len(part):
                state = int(part["leaves"].to_numpy()[i])
        result = pd.DataFrame(out, columns=["_chunk", "_state"])
        for name in reversed(key_names):
            result.insert(0, name, frame[name].iloc[0])
        return result

    states = maps.groupBy(*keys).applyInPandas(chain, f"{key_ddl}, _chunk long, _state long")
    schema = candidates.schema

    def take(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(at)
        pos, until = frame[at].to_numpy(), frame[free].to_numpy()
        state, chosen = frame["_state"].iloc[0], []
        i = int(np.searchsorted(pos, state, side="left"))
        while i < len(pos):
            chosen.append(i)
            i = int(np.searchsorted(pos, until[i], side="left"))
        return frame.iloc[chosen][schema.names]

    return (
        placed.join(states, [*keys, "_chunk"])
        .groupBy(*keys, "_chunk")
        .applyInPandas(take, schema)
    )


def one_per_event(candidates: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Push a candidate's ``free_at`` past the end of its own event."""
    last = rows.filter("event >= 0").groupBy(*key, "event").agg(F.max("row").alias("_last"))
    joined = candidates.join(last, [*key, "event"])
    return joined.withColumn("free_at", F.greatest("free_at", F.col("_last") + 1)).drop("_last")


@dataclass(frozen=True)
class ExitRules:
    """When a position closes, in the order the rules are checked."""

    hold: int
    cooldown: int = 0
    allow_reversal: bool = False
    hold_scale: float = 0.0
    take_profit_bp: float | None = None
    stop_loss_bp: float | None = None
    trailing_stop_bp: float | None = None
    exit_below: float | None = None
    exit_on_flip: bool = False

    @property
    def reads_path(self) -> bool:
        return (
            any((self.take_profit_bp, self.stop_loss_bp, self.trailing_stop_bp, self.exit_below))
            or self.exit_on_flip
            or self.hold_scale > 0
            or self.allow_reversal
        )

    @property
    def longest(self) -> int:
        return max(1, round(self.hold * (1 + self.hold_scale)))


def exits_on_clock(rows: DataFrame, rules: ExitRules, last: DataFrame, key: Sequence[str]) -> DataFrame:
    """Candidates that leave on the clock; one that outlives the data ends with it."""
    taken = rows.filter(
        (F.col("decision") != 0) & F.col("forward_bp").isNotNull() & F.col("spread_bp").isNotNull()
    ).join(last, list(key))
    ends = F.col("row") + rules.hold > F.col("_last")
    exit_row = F.least(F.col("row") + rules.hold, F.col("_last"))
    return taken.select(
        *key,
        F.col("row").alias("row"),
        F.col("decision").alias("direction"),
        exit_row.alias("exit_row"),
        F.col("spread_bp").alias("entry_spread_bp"),
        F.col("forward_bp").alias("move_bp"),
        F.when(ends, "end_of_data").otherwise("clock").alias("exit_reason"),
        (F.col("row") + rules.hold + rules.cooldown).alias("free_at"),
    )


def exits_on_path(
    rows: DataFrame,
    rules: ExitRules,
    last: DataFrame,
    key: Sequence[str],
    layout: Layout,
    marker: str | None = None,
) -> DataFrame:
    """Candidates with the first exit their path meets, read inside chunks with a look-ahead."""
    ahead = rules.longest
    used = ["row", "decision", "forward_bp", "spread_bp", "mid", "p_buy", "p_sell"]
    marks = [marker] if marker else []
    rows = rows.join(F.broadcast(last), list(key))  # one row a key
    lay = Layout(key=tuple(key), order=("row",), us="row", bucket_s=ROW_BUCKET / 1e6, chunk_rows=ROW_BUCKET)
    cut = chunked(rows.select(*key, *used, *marks, "_last"), lay, rows_ahead=ahead + 1)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in key) + (
        ", row long, direction int, exit_row long, entry_spread_bp double, move_bp double, "
        "exit_reason string, free_at long"
    )

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row").reset_index(drop=True)
        side = frame["decision"].fillna(0).to_numpy(dtype=int)
        mid, fwd = frame["mid"].to_numpy(float), frame["forward_bp"].to_numpy(float)
        spread, row = frame["spread_bp"].to_numpy(float), frame["row"].to_numpy()
        buy, sell = frame["p_buy"].to_numpy(float), frame["p_sell"].to_numpy(float)
        mark = frame[marker].fillna(False).to_numpy(bool) if marker else None
        final = int(frame["_last"].iloc[0])
        ok = (side != 0) & frame["_own"].to_numpy(bool) & ~np.isnan(fwd) & ~np.isnan(spread)
        out = []
        for i in np.flatnonzero(ok):
            d = side[i]
            hold = rules.hold
            if rules.hold_scale > 0:
                sure = buy[i] if d > 0 else sell[i]
                hold = max(1, round(hold * (1 + rules.hold_scale * max(0.0, (sure - 0.5) * 2))))
            stop = min(i + hold, len(row) - 1)
            window = slice(i + 1, stop + 1)
            ahead_bp = d * (mid[window] / mid[i] - 1.0) * BP
            size = len(ahead_bp)
            hits: list[tuple[int, int, str]] = []

            def first(flag: np.ndarray, order: int, reason: str) -> None:
                if flag.any():
                    hits.append((int(flag.argmax()), order, reason))

            if size:
                if rules.take_profit_bp:
                    first(ahead_bp >= rules.take_profit_bp, 0, "take_profit")
                if rules.stop_loss_bp:
                    first(ahead_bp <= -rules.stop_loss_bp, 1, "stop_loss")
                if rules.trailing_stop_bp:
                    best = np.maximum.accumulate(np.maximum(ahead_bp, 0.0))
                    given = (best > 0) & (ahead_bp <= best - rules.trailing_stop_bp)
                    first(given, 2, "trailing_stop")
                held = (buy if d > 0 else sell)[window]
                against = (sell if d > 0 else buy)[window]
                if rules.exit_below is not None:
                    first(held < rules.exit_below, 3, "signal_decay")
                if rules.exit_on_flip:
                    first(against > held, 4, "flip")
                if mark is not None:
                    first(mark[window], 5, "marker")
                if i + hold < len(row):
                    hits.append((hold - 1, 6, "clock"))
                if rules.allow_reversal:
                    first(side[window] == -d, 7, "reversal")
            if hits:
                offset, _, reason = min(hits)
                j = i + 1 + offset
                exact = reason == "clock" and j - i == rules.hold
                move = fwd[i] if exact else (mid[j] / mid[i] - 1.0) * BP
                exit_row, free = row[j], row[j] + rules.cooldown
            else:
                reason, move = "end_of_data", fwd[i]
                exit_row = min(row[i] + hold, final)
                free = final + 1
            out.append((row[i], int(d), int(exit_row), spread[i], move, reason, int(free)))
        result = pd.DataFrame(
            out,
            columns=["row", "direction", "exit_row", "entry_spread_bp", "move_bp", "exit_reason", "free_at"],
        )
        for name in reversed(list(key)):
            result.insert(0, name, frame[name].iloc[0])
        return result

    return cut.groupBy(*key, "_chunk").applyInPandas(scan, schema)


def thin(
    rows: DataFrame,
    rules: ExitRules,
    key: Sequence[str] = ("symbol",),
    *,
    marker: str | None = None,
    bucket: int = ROW_BUCKET,
    chunk_rows: int = CHUNK,
    layout: Layout = BOOK,
) -> DataFrame:
    """One position at a time over rows numbered from 0 in ``row``.

    Needs ``decision, forward_bp, spread_bp`` and, when exits read the path, ``mid, p_buy,
    p_sell``. A closed position frees its own row again after the cooldown.
    """
    last = rows.groupBy(*key).agg(F.max("row").alias("_last"))
    if rules.reads_path or marker:
        found = exits_on_path(rows, rules, last, key, layout, marker)
    else:
        found = exits_on_clock(rows, rules, last, key)
    picked = greedy_entries(found, key, bucket=bucket, chunk_rows=chunk_rows)
    return picked.drop("free_at").withColumnRenamed("row", "entry_row")


def with_rows(df: DataFrame, key: Sequence[str] = ("symbol",), layout: Layout = BOOK) -> DataFrame:
    """Rows numbered from 0 in order."""
    lay = Layout(key=tuple(key), order=layout.order, bucket_s=layout.bucket_s)
    return numbered(df, lay, "row").withColumn("row", F.col("row") - 1)


def score(trades: DataFrame, costs: TakerCosts, by: Sequence[str] = (), days: float | None = None) -> DataFrame:
    """Gross, cost, net, per-trade figures and hit rate."""
    gross = F.col("direction") * F.col("move_bp")
    cost = costs.round_trip("entry_spread_bp")
    out = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum(gross).alias("gross_bp"),
        F.sum(cost).alias("cost_bp"),
        F.sum(gross - cost).alias("net_bp"),
        F.avg(gross).alias("gross_per_trade_bp"),
        F.avg(gross - cost).alias("net_per_trade_bp"),
        F.avg((gross > 0).cast("double")).alias("hit_rate"),
    )
    if days is None:
        return out
    return out.select(
        "*",
        (F.col("trades") / F.lit(days)).alias("trades_per_day"),
        (F.col("net_bp") / F.lit(days)).alias("net_bp_per_day"),
    )


def equity(trades: DataFrame, key: Sequence[str], layout: Layout, net: str = "net_bp") -> DataFrame:
    """Running result, its peak (from zero) and how far under it, per trade in order."""
    from tickloom.operators.chunks import running

    lay = Layout(key=tuple(key), order=layout.order, us=layout.us, bucket_s=layout.bucket_s)
    summed = running(trades, {"equity_bp": F.col(net), "trade": F.lit(1).cast("long")}, lay)
    peaked = running(summed, {}, lay, maxima={"_top": F.col("equity_bp")})
    peak = F.greatest("_top", F.lit(0.0))
    return peaked.select(
        *trades.columns,
        (F.col("trade") - 1).alias("trade"),
        "equity_bp",
        peak.alias("peak_bp"),
        (F.col("equity_bp") - peak).alias("underwater_bp"),
    )


def metrics(curve: DataFrame, key: Sequence[str], days: float, net: str = "net_bp") -> DataFrame:
    """Totals, per day, drawdown and its length in trades, profit factor, hit rate.

    The drawdown runs from the first trade at the peak before the deepest trough (the first of
    equal troughs); before any gain the peak is the start.
    """
    keys = list(key)
    trough = curve.groupBy(*keys).agg(
        F.min(F.struct("underwater_bp", "trade")).alias("t"),
        F.min_by("peak_bp", F.struct("underwater_bp", "trade")).alias("_peak"),
    )
    at_peak = (
        curve.join(trough, keys)
        .filter((F.col("trade") <= F.col("t.trade")) & (F.col("equity_bp") >= F.col("_peak") - 1e-9))
        .groupBy(*keys)
        .agg(F.min("trade").alias("_from"))
    )
    value = F.col(net)
    totals = curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum(value).alias("net_bp"),
        F.avg(value).alias("net_per_trade_bp"),
        F.sum(F.when(value > 0, value).otherwise(0.0)).alias("_won"),
        F.sum(F.when(value < 0, -value).otherwise(0.0)).alias("_lost"),
        F.avg((value > 0).cast("double")).alias("hit_rate"),
    )
    joined = totals.join(trough, keys).join(at_peak, keys, "left")
    depth = F.when(F.col("t.underwater_bp") < 0, -F.col("t.underwater_bp")).otherwise(0.0)
    start = F.when(F.col("_peak") > 0, F.coalesce("_from", F.lit(0))).otherwise(F.lit(0))
    length = F.when(depth > 0, F.col("t.trade") - start).otherwise(F.lit(0))
    return joined.select(
        *keys,
        "trades",
        (F.col("trades") / F.lit(days)).alias("trades_per_day"),
        "net_bp",
        "net_per_trade_bp",
        (F.col("net_bp") / F.lit(days)).alias("net_bp_per_day"),
        depth.alias("max_drawdown_bp"),
        length.cast("long").alias("drawdown_trades"),
        ratio("_won", "_lost").alias("profit_factor"),
        "hit_rate",
        ratio(F.col("net_bp"), depth).alias("return_over_drawdown"),
    )


# ------------------------------------------------------------------ walked book round trips


def hold_table(
    book: DataFrame,
    holds_s: Sequence[float],
    *,
    clip: float,
    depth: int,
    latency_ms: float = 10.0,
    fee_bp: float = 0.0,
) -> DataFrame:
    """Every row's walked round trip for each hold, both sides, after latency.

    The entry is the first row at or after the decision plus latency, the exit the first at or
    after the entry plus the hold.
    """
    from tickloom.functions.costs import with_walks
    from tickloom.operators.asof import asof_join

    values = ["mid", "buy_vwap", "buy_exceeds", "sell_vwap", "sell_exceeds"]
    walks = with_walks(book, clip, depth)
    rows = walks.select("symbol", "us", "seq", *values)
    named = {v: f"entry_{v}" for v in values} | {"r_us": "entry_us"}
    entry = asof_join(
        rows.select("symbol", "us", "seq"),
        rows,
        values,
        at=F.col("us") + round(latency_ms * 1000),
        forward=True,
        names=named,
    )
    spans = F.explode(F.array(*[F.lit(float(h)) for h in holds_s])).alias("hold_s")
    named = {v: f"exit_{v}" for v in values} | {"r_us": "exit_us"}
    both = asof_join(
        entry.filter("entry_us IS NOT NULL").select("*", spans),
        rows,
        values,
        at=F.col("entry_us") + (F.col("hold_s") * 1_000_000).cast("long"),
        forward=True,
        names=named,
        stored=True,
    )
    mid = F.col("entry_mid")
    long_ = (F.col("exit_sell_vwap") - F.col("entry_buy_vwap")) / mid * BP - 2 * fee_bp
    short = (F.col("entry_sell_vwap") - F.col("exit_buy_vwap")) / mid * BP - 2 * fee_bp
    known = F.col("exit_us").isNotNull()
    return both.select(
        "symbol",
        "us",
        "seq",
        "hold_s",
        "entry_us",
        "exit_us",
        long_.alias("long_bp"),
        short.alias("short_bp"),
        (F.when(known, F.col("entry_buy_exceeds") | F.col("entry_sell_exceeds")).otherwise(False)).alias(
            "entry_exceeds"
        ),
        (F.when(known, F.col("exit_buy_exceeds") | F.col("exit_sell_exceeds")).otherwise(False)).alias(
            "exit_exceeds"
        ),
    )


def walked_label(table: DataFrame) -> Column:
    """-1 / 0 / +1 from a hold table's row; missing where unknown or the entry exceeds the book."""
    side = F.when(F.col("short_bp") > 0, -1).when(F.col("long_bp") > 0, 1).otherwise(0)
    return F.when(F.col("long_bp").isNotNull() & ~F.col("entry_exceeds"), side)


def take_from_table(
    table: DataFrame, decisions: DataFrame, fee_bp: float
) -> DataFrame:
    """Decisions traded from a hold table, one position at a time.

    A decision whose entry exceeds the book is skipped; the next may be taken after the exit row.
    """
    joined = decisions.filter("side != 0").join(table, ["symbol", "us", "seq"])
    usable = joined.filter(F.col("exit_us").isNotNull() & ~F.col("entry_exceeds"))
    pnl = F.when(F.col("side") > 0, F.col("long_bp")).otherwise(F.col("short_bp")) - 2 * fee_bp
    rows = usable.select(
        "symbol",
        "hold_s",
        "us",
        "seq",
        "side",
        "entry_us",
        "exit_us",
        pnl.alias("net_bp"),
        "exit_exceeds",
        (F.col("exit_us") + 1).alias("free_at"),
    )
    return greedy_entries(rows, ["symbol", "hold_s"], at="us", bucket=TIME_BUCKET).drop("free_at")

