"""Stateful streams keyed by instrument: book state, trailing features, monitors.

State is one JSON document per instrument. A trigger's rows are put in event order before use.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.rebuild import Ladder, flat_levels, level_names

State = dict[str, Any]
Step = Callable[[State, pd.DataFrame], list[tuple] | pd.DataFrame]


def stateful(stream: DataFrame, step: Step, columns: list[str], schema: str, order: list[str], start: State) -> DataFrame:
    """Run ``step`` per instrument over each trigger's rows with its saved state."""
    blank = json.dumps(start)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved = json.loads(state.get[0] if state.exists else blank)
        frame = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = pd.DataFrame(step(saved, frame), columns=columns)
        state.update((json.dumps(saved),))
        out.insert(0, "symbol", key[0])
        yield out

    return stream.groupBy("symbol").applyInPandasWithState(
        update, f"symbol string, {schema}", "doc string", "append", GroupStateTimeout.NoTimeout
    )


def book_state(changes: DataFrame, depth: int, grid_us: int | None = 100_000) -> DataFrame:
    """Book rows from level changes, at most one per grid bin (without a grid one per message), with
    sequence breaks marked.

    ``changes`` are level changes with ``kind, us, recv, update_id, side, price, size``.
    """
    names = level_names(depth)

    def step(saved: State, frame: pd.DataFrame) -> list[tuple]:
        bids, asks = Ladder(1, saved["b"]), Ladder(-1, saved["a"])
        out = []
        for (us, recv, update, kind), part in frame.groupby(["us", "recv", "update_id", "kind"], sort=False):
            if kind == "snapshot":
                bids, asks = Ladder(1), Ladder(-1)
            gap = kind == "delta" and saved["last"] is not None and update != saved["last"] + 1
            for side, price, size in zip(part["side"], part["price"], part["size"], strict=True):
                (bids if side == "b" else asks).put(price, size)
            saved["last"] = int(update)
            if not (bids.ranks and asks.ranks) or (grid_us and us // grid_us == saved["bin"]):
                continue
            saved["bin"] = int(us // grid_us) if grid_us else None
            levels = flat_levels(bids, asks, depth)
            if levels is not None:
                out.append((us, update, bool(gap), *levels))
        saved |= {"b": bids.levels(), "a": asks.levels()}
        return out

    schema = "us long, seq long, gap boolean, " + ", ".join(f"{n} double" for n in names)
    start = {"b": [], "a": [], "last": None, "bin": None}
    return stateful(changes, step, ["us", "seq", "gap", *names], schema, ["us", "recv"], start)


def trailing_features(book: DataFrame, rows_back: int = 20) -> DataFrame:
    """Spread, imbalance, return and summed order-flow imbalance over the last rows, per row.

    The state keeps as many touch rows as the longest feature looks back.
    """
    touch = ["bid_price_0", "bid_size_0", "ask_price_0", "ask_size_0"]

    def flow(now: list[float], was: list[float]) -> float:
        bid = now[1] if now[0] > was[0] else (now[1] - was[1] if now[0] == was[0] else -was[1])
        ask = now[3] if now[2] < was[2] else (now[3] - was[3] if now[2] == was[2] else -was[3])
        return bid - ask

    def step(saved: State, frame: pd.DataFrame) -> list[tuple]:
        kept, out = saved["rows"], []
        for us, seq, *now in frame[["us", "seq", *touch]].itertuples(index=False):
            now = [float(v) for v in now]
            kept.append(now)
            del kept[: -(rows_back + 1)]
            mid = (now[0] + now[2]) / 2
            move = total = None
            if len(kept) == rows_back + 1:
                first = kept[0]
                move = 1e4 * math.log(mid / ((first[0] + first[2]) / 2))
                total = sum(flow(b, a) for a, b in zip(kept, kept[1:], strict=False))
            spread = 1e4 * (now[2] - now[0]) / mid
            imbalance = (now[1] - now[3]) / (now[1] + now[3])
            out.append((us, seq, spread, imbalance, move, total))
        return out

    columns = ["us", "seq", "spread_bp", "queue_imbalance", f"mid_return_{rows_back}_bp", f"ofi_{rows_back}"]
    schema = "us long, seq long, " + ", ".join(f"{c} double" for c in columns[2:])
    return stateful(book, step, columns, schema, ["us", "seq"], {"rows": []})


def merged_by_time(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """Rows and prints as one stream of events; at equal stamps prints come first."""
    from pyspark.sql import functions as F

    a = rows.select("symbol", "us", F.lit(1).alias("kind"), F.col("seq").alias("id"), F.col("bid_price_0").alias("value"))
    b = prints.select("symbol", "us", F.lit(0).alias("kind"), F.col("trade_id").alias("id"), F.col("price").alias("value"))
    both = a.unionByName(b)

    def step(saved: State, frame: pd.DataFrame) -> pd.DataFrame:
        first = saved["n"] + 1
        saved["n"] += len(frame)
        return frame[["us", "kind", "id", "value"]].assign(place=range(first, saved["n"] + 1)).reset_index(drop=True)

    return stateful(
        both, step, ["us", "kind", "id", "value", "place"],
        "us long, kind int, id long, value double, place long", ["us", "kind", "id"], {"n": 0},
    )


def decisions(rows: DataFrame, every: int, threshold: float) -> DataFrame:
    """A side at every ``every``-th row of an instrument, counted across triggers."""

    def step(saved: State, frame: pd.DataFrame) -> list[tuple]:
        out = []
        for us, seq, score in frame[["us", "seq", "score"]].itertuples(index=False):
            if saved["n"] % every == 0:
                out.append((us, seq, 1 if score > threshold else (-1 if score < -threshold else 0)))
            saved["n"] += 1
        return out

    return stateful(rows, step, ["us", "seq", "side"], "us long, seq long, side int", ["us", "seq"], {"n": 0})


def drift_monitor(trades: DataFrame, k: float, h: float, warm_up: int) -> DataFrame:
    """CUSUM of trade results scored on the trades before: six numbers of state."""

    def step(saved: State, frame: pd.DataFrame) -> list[tuple]:
        out = []
        for us, ret in frame[["us", "ret"]].itertuples(index=False):
            n, mean, m2 = saved["n"], saved["mean"], saved["m2"]
            if n >= warm_up:
                sd = math.sqrt(m2 / (n - 1)) if m2 > 0 else 0.0
                z = ret / sd if sd > 0 else 0.0
                saved["down"] = max(0.0, saved["down"] - z - k)
                out.append((us, z, saved["down"], saved["down"] > h))
            n += 1
            delta = ret - mean
            mean += delta / n
            saved |= {"n": n, "mean": mean, "m2": m2 + delta * (ret - mean)}
        return out

    return stateful(
        trades, step, ["us", "z", "statistic", "over"], "us long, z double, statistic double, over boolean",
        ["us"], {"n": 0, "mean": 0.0, "m2": 0.0, "down": 0.0},
    )


def regime_monitor(mids: DataFrame, recent: int, h: float) -> DataFrame:
    """Two-sided CUSUM of returns and the log ratio of recent to past variance, on sampled mids."""

    def step(saved: State, frame: pd.DataFrame) -> list[tuple]:
        out = []
        for us, mid in frame[["us", "mid"]].itertuples(index=False):
            if saved["last"] is not None:
                ret = math.log(mid / saved["last"])
                n, sq = saved["n"], saved["sq"]
                if n >= recent:
                    sd = math.sqrt(sq / n) or 1.0
                    z = ret / sd
                    saved["up"] = max(0.0, saved["up"] + z - 0.5)
                    saved["down"] = max(0.0, saved["down"] - z - 0.5)
                    tail = saved["tail"]
                    ratio = math.log(max(sum(tail) / len(tail), 1e-300) / (sq / n))
                    out.append((us, saved["up"], saved["down"], ratio, max(saved["up"], saved["down"]) > h))
                saved["n"], saved["sq"] = n + 1, sq + ret * ret
                saved["tail"] = [*saved["tail"], ret * ret][-recent:]
            saved["last"] = mid
        return out

    return stateful(
        mids, step, ["us", "up", "down", "variance_ratio", "alarm"],
        "us long, up double, down double, variance_ratio double, alarm boolean", ["us"],
        {"last": None, "n": 0, "sq": 0.0, "up": 0.0, "down": 0.0, "tail": []},
    )


def stale_after(events: DataFrame, seconds: float) -> DataFrame:
    """Pauses longer than ``seconds`` between an instrument's consecutive events."""

    def step(saved: State, frame: pd.DataFrame) -> list[tuple]:
        out = []
        for us in frame["us"]:
            if saved["last"] is not None and us - saved["last"] > seconds * 1e6:
                out.append((int(saved["last"]), int(us), (us - saved["last"]) / 1e6))
            saved["last"] = int(us)
        return out

    return stateful(
        events, step, ["from_us", "to_us", "seconds"], "from_us long, to_us long, seconds double", ["us"], {"last": None}
    )
