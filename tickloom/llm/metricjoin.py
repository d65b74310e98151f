"""Embedding near-duplicates: an exact metric range join.

On unit vectors the angle bound is a distance bound r. Pivots partition the vectors: each belongs
to the cell of its nearest pivot. If w lies within r of v and belongs to the cell of c, the
triangle inequality bounds what v can be: no farther from c than the cell's radius plus r, no
nearer than its inner radius less r, and on v's side of the plane between c and v's own pivot by at
most r. v visits exactly the cells that pass, and every cell is joined on its own: its members
against its visitors, so each ordered pair is seen once, in the cell of its second vector.

Cells are cut into blocks of bounded size; a block of members meets a block of visitors in one
task. Equal vectors are collapsed first. A block emits counts and a spanning forest, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.components import components
from tickloom.session import materialised

PIVOTS = 16
BLOCK = 1024


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def encoded(vector: np.ndarray) -> bytes:
    """Bytes of a vector, in single precision where that loses nothing."""
    short = np.asarray(vector, np.float64).astype(np.float32)
    return (short if np.array_equal(short.astype(np.float64), vector) else np.asarray(vector, np.float64)).tobytes()


def choose_pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """``count`` pivots far from one another, out of a bounded seeded sample of 64 times as many."""
    rows = vectors.orderBy(F.xxhash64("_id"), "_id").limit(64 * count).select("v").collect()
    if not rows:
        return np.zeros((0, 0))
    dims = max(len(r["v"]) for r in rows)
    sample = unit(np.array([r["v"] for r in rows if len(r["v"]) == dims], dtype=float))
    chosen = [0]
    near = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(count, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (v @ pivots.T), 0.0))


def near_vectors(
    vectors: DataFrame,
    cosine: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    pivots: int = PIVOTS,
) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id`` (smallest id reachable), ``kept``, one row per vector.

    Two vectors of one non-null label and one length link if their cosine in double precision is at
    least ``cosine`` (0 < cosine <= 1). A vector that is null, empty, zero or holds a null or
    non-finite component links with nothing, and neither does one without label or id. Rows that
    repeat an id count as vectors of their own in ``n_links`` and share a component. Extra columns
    are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    radius = math.sqrt(2.0 - 2.0 * cosine) + 1e-9
    raw = F.col(vector_col).cast("array<double>")
    fine = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = fine & F.exists(raw, lambda x: x != 0) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    good = vectors.where(usable).select(
        F.col(id_col).alias("_id"), F.col(label_col).alias("label"), raw.alias("v")
    )
    heads = materialised(good.groupBy("label", "v").agg(F.min("_id").alias("head"), F.count("*").alias("copies")))
    # the head of a group and its label name it: equal ids under two labels stay apart
    points = heads.select(F.xxhash64("label", "head", "v").alias("point"), "head", "label", "copies", "v")
    centres = choose_pivots(heads.select(F.col("head").alias("_id"), "v"), pivots)
    n_pivots = len(centres)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1)
            size = np.diff(np.asarray(at.offsets))
            flat = np.asarray(at.flatten())
            cell = np.zeros(len(size), np.int32)
            away = np.zeros(len(size))
            if n_pivots:
                rows = np.flatnonzero(size == centres.shape[1])
                if len(rows):
                    inside = np.repeat(size == centres.shape[1], size)
                    d = distances(unit(flat[inside].reshape(len(rows), -1)), centres)
                    cell[rows] = d.argmin(axis=1)
                    away[rows] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size.astype(np.int32)), pa.array(cell), pa.array(away)],
                ["point", "size", "cell", "away"],
            )

    placed = points.select("point", "v").mapInArrow(homes, "point long, size int, cell int, away double")
    placed = materialised(placed.join(points.select("point", "label", "head", "copies"), "point"))
    cells = placed.groupBy("label", "size", "cell").agg(
        F.count("*").alias("n"), F.min("away").alias("inner"), F.max("away").alias("outer")
    )
    cells = materialised(cells.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    # all cells of a label and length, for its vectors to choose from: at most one per pivot
    menu = cells.groupBy("label", "size").agg(F.collect_list(F.struct("cell", "inner", "outer", "blocks")).alias("menu"))
    chosen = placed.join(points.select("point", "v"), "point").join(menu, ["label", "size"])
    chosen = chosen.select("point", "label", "size", "cell", "away", "copies", "v", "menu")
    between = distances(centres, centres) if n_pivots else np.zeros((0, 0))
    label_type = chosen.schema["label"].dataType.simpleString()

    def visits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (size, _), part in frame.groupby(["size", "label"]):
                v = unit(np.stack(part["v"].to_numpy()).astype(float))
                options = part["menu"].iat[0]
                regular = n_pivots and size == centres.shape[1]
                d = distances(v, centres) if regular else np.zeros((len(part), 1))
                home, own = part["cell"].to_numpy(), part["away"].to_numpy()
                salt = part["point"].to_numpy()
                for option in options:
                    c = option["cell"]
                    goes = home == c
                    if regular:
                        away = d[:, c]
                        plane = (away**2 - own**2) / np.maximum(2 * between[home, c], 1e-12)
                        goes |= (away <= option["outer"] + radius) & (away >= option["inner"] - radius) & (plane <= radius)
                    some = part[goes]
                    if not len(some):
                        continue
                    member = (home == c)[goes]
                    blocks = option["blocks"]
                    own_block = (salt[goes] % blocks).astype(int)
                    for block in range(blocks):
                        yield pd.DataFrame(
                            {
                                "label": some["label"], "size": size, "cell": c, "block": block,
                                "visitors": own_block, "member": member & (own_block == block),
                                "point": some["point"], "copies": some["copies"],
                                "v": [encoded(x) for x in some["v"]],
                            }
                        )

    visitors = chosen.mapInPandas(
        visits,
        f"label {label_type}, size int, cell int, block int, visitors int, member boolean, point long, "
        "copies long, v binary",
    )
    # a block of members is needed by every block of visitors of its cell
    spread = F.when(F.col("member"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array())
    meeting = visitors.join(cells.select("label", "size", "cell", "blocks"), ["label", "size", "cell"])
    meeting = meeting.select("*", F.explode(F.array_union(F.array("visitors"), spread)).alias("turn"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        size = int(group["size"].iat[0])
        raw = np.stack([np.frombuffer(x, np.float32 if len(x) == 4 * size else np.float64) for x in group["v"]])
        raw = raw.astype(np.float64)
        norms = np.sqrt((raw * raw).sum(axis=1))
        ids, copies = group["point"].to_numpy(), group["copies"].to_numpy()
        members = np.flatnonzero(group["member"].to_numpy())
        asking = np.flatnonzero(group["visitors"].to_numpy() == group["turn"].to_numpy())
        links = np.zeros(len(group), np.int64)
        a, b = [], []
        for low in range(0, len(asking), 256):
            rows = asking[low : low + 256]
            near = raw[rows] @ raw[members].T / np.outer(norms[rows], norms[members]) >= cosine
            near &= ids[rows][:, None] != ids[members][None, :]
            links[rows] = near @ copies[members]
            x, y = np.nonzero(near)
            forest = spanning(rows[x], members[y], len(group))
            a.append(ids[rows[x][forest]])
            b.append(ids[members[y][forest]])
        asked = links[asking] > 0
        joined_a, joined_b = np.concatenate(a or [ids[:0]]), np.concatenate(b or [ids[:0]])
        return pd.DataFrame(
            {
                "a": np.concatenate([ids[asking[asked]], joined_a]),
                "b": np.concatenate([ids[asking[asked]], joined_b]),
                "links": np.concatenate([links[asking[asked]], np.zeros(len(joined_a), np.int64)]),
            }
        )

    found = materialised(
        meeting.groupBy("label", "size", "cell", "block", "turn").applyInPandas(meet, "a long, b long, links long")
    )
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    groups = components(found.where("a <> b").select("a", "b"))
    named = placed.select("point", "head", "copies").join(counts, F.col("point") == F.col("a"), "left")
    named = named.join(groups, F.col("point") == F.col("id"), "left").select(
        "point", "head", "copies",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "point").alias("component"),
    )
    named = materialised(named)
    least = named.groupBy("component").agg(F.min("head").alias("component_id"))
    keyed = named.join(least, "component").select("point", "n_links", "component_id")
    linked = vectors.where(usable).select(
        F.col(id_col).alias("_id"), F.col(label_col).alias("label"), raw.alias("v")
    ).join(points.join(keyed, "point").select("label", "v", "n_links", "component_id"), ["label", "v"])
    apart = vectors.where(~F.coalesce(usable, F.lit(False))).select(F.col(id_col).alias("_id"))
    out = linked.select("_id", "n_links", "component_id").unionByName(apart, allowMissingColumns=True)
    component = F.coalesce("component_id", "_id")
    return out.select(
        F.col("_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"),
    )


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Indices of links that join what earlier links left apart."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        i, j = root(i), root(j)
        if i != j:
            parent[i] = j
            kept.append(k)
    return np.array(kept, dtype=np.int64)
