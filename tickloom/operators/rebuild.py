"""Order books rebuilt from snapshots and deltas."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.chunks import Layout, chunk_map, running
from tickloom.session import materialised
from tickloom.sources.messages import level_changes


class Ladder:
    """One side of a book: prices in order, best at the end, with their sizes."""

    def __init__(self, sign: int, levels: Iterable[tuple[float, float]] = ()):
        self.sign = sign  # +1 where the highest price is best
        self.ranks: list[float] = []
        self.sizes: dict[float, float] = {}
        for price, size in levels:
            self.put(price, size)

    def put(self, price: float, size: float) -> None:
        """Set a level; size zero removes it."""
        rank = self.sign * price
        at = bisect_left(self.ranks, rank)
        known = at < len(self.ranks) and self.ranks[at] == rank
        if size and not known:
            self.ranks.insert(at, rank)
        elif known and not size:
            del self.ranks[at]
        if size:
            self.sizes[rank] = size

    def best(self, depth: int) -> list[tuple[float, float]]:
        """Up to ``depth`` levels, best first."""
        return [(self.sign * r, self.sizes[r]) for r in self.ranks[: -depth - 1 : -1]]

    def levels(self) -> list[tuple[float, float]]:
        return [(self.sign * r, self.sizes[r]) for r in self.ranks]


def flat_levels(bids: Ladder, asks: Ladder, depth: int) -> list[float] | None:
    """Prices and sizes level by level, bid before ask; None where a side lacks levels."""
    rows = [v for pair in zip(bids.best(depth), asks.best(depth), strict=False) for level in pair for v in level]
    return rows if len(rows) == 4 * depth else None


def level_names(depth: int) -> list[str]:
    return [n for i in range(depth) for n in (f"bid_price_{i}", f"bid_size_{i}", f"ask_price_{i}", f"ask_size_{i}")]


def sequence_gaps(messages: DataFrame) -> DataFrame:
    """Per symbol: deltas whose update id does not follow the one before (snapshots heal the book,
    not the count)."""
    w = Window.partitionBy("symbol", "_day").orderBy("us", "recv")
    day = F.floor(F.col("us") / F.lit(86_400_000_000))
    step = F.col("update_id") - F.lag("update_id").over(w)
    placed = messages.withColumn("_day", day).withColumn("_step", step)
    broken = (F.col("kind") == "delta") & (F.col("_step") != 1)
    return placed.groupBy("symbol").agg(F.count_if(broken).alias("gaps"))


def rebuild(
    messages: DataFrame, depth: int, *, grid_us: int | None = 100_000, bucket_s: float = 600.0, chunk_rows: int = 1 << 18
) -> DataFrame:
    """Top ``depth`` levels at the first complete message of every grid bin, or without a grid at every
    complete message.

    A snapshot opens an epoch. An epoch is cut into chunks of time, and each chunk is handed the
    levels standing at its start, found from the last change of every level in earlier chunks; so a
    chunk is replayed on its own and an epoch of any length is spread over the cluster.
    """
    by_symbol = Layout(order=("us", "recv"), bucket_s=bucket_s)
    opened = running(messages, {"epoch": (F.col("kind") == "snapshot").cast("long")}, by_symbol)
    stored = materialised(opened.filter("epoch > 0"))
    layout = Layout(key=("symbol", "epoch"), order=("us", "recv"), bucket_s=bucket_s, chunk_rows=chunk_rows)
    key = ["symbol", "epoch"]
    plan = chunk_map(stored, layout).select(*key, "_bucket", F.col("_c").alias("chunk"))
    placed = stored.withColumn("_bucket", layout.bucket()).join(plan, [*key, "_bucket"]).drop("_bucket")
    changes = level_changes(placed).select(*key, "chunk", "us", "recv", "update_id", "side", "price", "size")
    last = changes.groupBy(*key, "side", "price", "chunk").agg(F.max_by("size", F.struct("us", "recv")).alias("size"))
    ends = plan.groupBy(*key).agg(F.max("chunk").alias("_end"))
    level = Window.partitionBy(*key, "side", "price").orderBy("chunk")
    standing = last.withColumn("_next", F.lead("chunk").over(level)).join(ends, key)
    until = F.coalesce("_next", "_end")
    carried = standing.filter((F.col("size") > 0) & (until > F.col("chunk"))).select(
        *key,
        F.explode(F.sequence(F.col("chunk") + 1, until)).alias("chunk"),
        F.lit(-1).cast("long").alias("us"),
        F.lit(-1).cast("long").alias("recv"),
        F.lit(-1).cast("long").alias("update_id"),
        "side",
        "price",
        "size",
    )
    names = level_names(depth)

    blank = [None] * len(names)

    def replay(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["us", "recv"], kind="stable")
        recv = frame["recv"].to_numpy()
        us, update = frame["us"].to_numpy(), frame["update_id"].to_numpy()
        side = (frame["side"] == "b").tolist()
        price, size = frame["price"].tolist(), frame["size"].tolist()
        bids, asks = Ladder(1), Ladder(-1)
        done = int((recv < 0).sum())  # levels standing at the start come first
        for bid, p, q in zip(side[:done], price[:done], size[:done], strict=True):
            (bids if bid else asks).put(p, q)
        # messages in order; of each bin the first whose book has both sides is a candidate
        starts = done + np.flatnonzero(np.r_[True, recv[done + 1 :] != recv[done:-1]]) if done < len(recv) else []
        out, used = [], None
        for low, high in zip(starts, [*starts[1:], len(recv)], strict=True):
            for bid, p, q in zip(side[low:high], price[low:high], size[low:high], strict=True):
                (bids if bid else asks).put(p, q)
            place = us[low] // grid_us if grid_us else len(out)
            if place != used and bids.ranks and asks.ranks:
                used = place
                levels = flat_levels(bids, asks, depth)
                out.append((place, us[low], recv[low], update[low], levels is not None, *(levels or blank)))
        result = pd.DataFrame(out, columns=["bin", "us", "recv", "seq", "whole", *names])
        result.insert(0, "symbol", frame["symbol"].iloc[0])
        return result

    schema = "symbol string, bin long, us long, recv long, seq long, whole boolean, "
    schema += ", ".join(f"{n} double" for n in names)
    found = changes.unionByName(carried).groupBy(*key, "chunk").applyInPandas(replay, schema)
    if not grid_us:
        return found.filter("whole").select("symbol", "us", "seq", *names)
    # a bin that a snapshot or a chunk divides has a candidate on either side: the first counts
    row = F.struct("us", "recv", "seq", "whole", *names)
    first = found.groupBy("symbol", "bin").agg(F.min_by(row, F.struct("us", "recv")).alias("r"))
    return first.filter("r.whole").select("symbol", "r.us", "r.seq", *[f"r.{n}" for n in names])
