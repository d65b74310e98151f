"""Positions that open beyond a band and close inside a narrower one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.chunks import Layout, chunk_map
from tickloom.session import materialised

STATES = (-1, 0, 1)


def effects(z: np.ndarray, entry: float, exit_at: float) -> np.ndarray:
    """What rows 0..i together do to each state, as an index of STATES: one row per i.

    A single score maps the states (short, flat, long) to states; maps compose, and doubling the
    composed length gives all prefixes in log n steps.
    """
    with np.errstate(invalid="ignore"):
        short = np.where(z <= exit_at, 1, 0)
        flat = np.select([z <= -entry, z >= entry], [2, 0], 1)
        long = np.where(z >= -exit_at, 1, 2)
    maps = np.stack([short, flat, long], axis=1)
    maps[np.isnan(z)] = (0, 1, 2)
    reach = 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    return maps


def band_positions(
    rows: DataFrame, *, entry: float, exit_at: float, layout: Layout | None = None
) -> DataFrame:
    """+1 while bought below ``-entry``, -1 while sold above it, until the score is back inside.

    There are three states, so a chunk's effect is a map of three: the chunks are run from each
    of them, the maps are chained per key, and every chunk then knows its start.
    """
    lay = layout or Layout(order=("us",), bucket_s=86_400.0 * 30)
    stored = materialised(rows)
    plan = chunk_map(stored, lay).select(*lay.key, "_bucket", F.col("_c").alias("_chunk"))
    placed = stored.withColumn("_bucket", lay.bucket()).join(plan, [*lay.key, "_bucket"]).drop("_bucket")
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    key_ddl = ", ".join(f"{k} {fields[k]}" for k in lay.key)
    order, key = list(lay.order), list(lay.key)

    def ends(frame: pd.DataFrame) -> pd.DataFrame:
        z = frame.sort_values(order)["z"].to_numpy(float)
        head = frame.iloc[:1][[*key, "_chunk"]].copy()
        head[["from_0", "from_1", "from_2"]] = effects(z, entry, exit_at)[-1] - 1
        return head

    maps = placed.groupBy(*key, "_chunk").applyInPandas(
        ends, f"{key_ddl}, _chunk long, from_0 long, from_1 long, from_2 long"
    )

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        frame, held, starts = frame.sort_values("_chunk"), 0, []
        for _, r in frame.iterrows():
            starts.append(held)
            held = int(r[f"from_{held + 1}"])
        frame["_start"] = starts
        return frame[[*key, "_chunk", "_start"]]

    states = maps.groupBy(*key).applyInPandas(chain, f"{key_ddl}, _chunk long, _start long")
    schema = ", ".join(f"`{n}` {t}" for n, t in fields.items()) + ", position long"
    names = [*fields, "position"]

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        z = frame["z"].to_numpy(float)
        frame["position"] = effects(z, entry, exit_at)[:, int(frame["_start"].iloc[0]) + 1] - 1
        return frame[names]

    return placed.join(states, [*key, "_chunk"]).groupBy(*key, "_chunk").applyInPandas(walk, schema)
