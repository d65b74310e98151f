"""Event-time streams on typed state and timers: the ordered merge of feeds, and silent feeds.

Both need a watermark on ``ts`` and the RocksDB state store (``flows.drained(..., typed=True)`` sets it for
its query). A timer fires when the watermark passes it, whether or not its instrument sends anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickloom.streaming.flows import WATERMARK


def watched(stream: DataFrame, delay: str = WATERMARK) -> DataFrame:
    return stream.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", delay)


#: An event as held in state, and how many share one value of it: a value a row costs a message each.
EVENT = np.dtype([("us", "<i8"), ("kind", "<i4"), ("id", "<i8"), ("value", "<f8")])
ROWS_A_BLOCK = 1 << 16


class Merge(StatefulProcessor):
    """Holds an instrument's events until the watermark has passed them, then lets them go in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "block binary")
        self.sent = handle.getValueState("sent", "n long")

    def hold(self, events: np.ndarray) -> None:
        for at in range(0, len(events), ROWS_A_BLOCK):
            self.held.appendValue((events[at : at + ROWS_A_BLOCK].tobytes(),))
        # Rounded up: the timer's millisecond has wholly passed when it fires.
        self.handle.registerTimer(int(events["us"].min()) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        fresh = pd.concat(list(rows))
        events = np.empty(len(fresh), EVENT)
        for name in EVENT.names:
            events[name] = fresh[name].to_numpy()
        self.hold(events)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        blocks = [np.frombuffer(r[0], EVENT) for r in self.held.get()] if self.held.exists() else []
        held = np.concatenate([np.empty(0, EVENT), *blocks])
        passed = held["us"] < limit
        ready, rest = held[passed], held[~passed]
        if not len(ready):
            # Another of the instrument's timers has let them go; what is left still needs one.
            if len(rest):
                self.handle.registerTimer(int(rest["us"].min()) // 1000 + 1)
            return
        self.held.clear()
        if len(rest):
            self.hold(rest)
        sent = self.sent.get()[0] if self.sent.exists() else 0
        self.sent.update((sent + len(ready),))
        order = np.lexsort((ready["value"], ready["id"], ready["kind"], ready["us"]))
        for at in range(0, len(order), ROWS_A_BLOCK):
            part = ready[order[at : at + ROWS_A_BLOCK]]
            out = pd.DataFrame({name: part[name] for name in EVENT.names})
            out.insert(0, "symbol", key[0])
            out["place"] = np.arange(sent + at + 1, sent + at + len(part) + 1)
            yield out

    def close(self) -> None:
        pass


def merged(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Events (symbol, us, kind, id, value) in the order of (us, kind, id), over all triggers.

    An event leaves when the watermark passes it; one that comes later than that is dropped and counted
    by the query's progress. ``place`` numbers an instrument's events.
    """
    rows = watched(events, delay).select("symbol", "us", F.col("kind").cast("int").alias("kind"), "id", "value", "ts")
    return rows.groupBy("symbol").transformWithStateInPandas(
        Merge(), "symbol string, us long, kind int, id long, value double, place long", "Append", "EventTime"
    )


class Silence(StatefulProcessor):
    """Reports an instrument once it has been silent for longer than the limit, and forgets it."""

    def __init__(self, limit_us: int) -> None:
        self.limit_us = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        stamps = pd.concat([f[["us"]] for f in rows])["us"].sort_values().to_numpy()
        seen = [int(self.last.get()[0])] if self.last.exists() else []
        chain = [*seen, *map(int, stamps)]
        gaps = [(key[0], a, b, (b - a) / 1e6) for a, b in zip(chain, chain[1:], strict=False) if b - a > self.limit_us]
        last = max(chain)
        self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.limit_us) // 1000 + 1)
        if gaps:
            yield pd.DataFrame(gaps, columns=["symbol", "from_us", "to_us", "seconds"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        last = int(self.last.get()[0])
        self.last.clear()
        out = pd.DataFrame({"symbol": [key[0]], "from_us": [last], "to_us": [None], "seconds": [None]})
        yield out.astype({"to_us": "Int64", "seconds": "float64"})

    def close(self) -> None:
        pass


def silent(events: DataFrame, seconds: float, delay: str = WATERMARK) -> DataFrame:
    """Pauses of more than ``seconds``: closed ones when the next event comes, and one without an end
    (``to_us`` null) as soon as the watermark is that far past an instrument's last event, whose state is then gone."""
    rows = watched(events, delay).select("symbol", "us", "ts")
    return rows.groupBy("symbol").transformWithStateInPandas(
        Silence(int(seconds * 1e6)), "symbol string, from_us long, to_us long, seconds double", "Append", "EventTime"
    )
