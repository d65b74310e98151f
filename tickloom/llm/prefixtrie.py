"""Prefix trie of conversations, by union-find over neighbours' common depths.

A conversation becomes a row of *marks*, one a turn: the mark of depth d is a SHA-256 (cut to 16 bytes)
of the mark before it and the turn, so two conversations share d turns exactly if their marks of depth d
are equal. Equal conversations are contracted first, with their members hashed block by block. The
distinct rows are range partitioned and sorted, which puts the members of every node side by side.

Inside a part, neighbours' common depths are taken in descending order and joined by union-find: a
merge at a depth makes the branching node there, or lets the left component's node of that depth grow.
What is left between branching nodes are paths of nodes with the same members.

A node may reach over the ends of a part. Only the nodes of a part's first and last row can, its
spines; their marks are grouped over all parts, which tells each part how deep its neighbours reach
into it and who the smallest members of the shared nodes are. Every part then counts a shared node's
own turn in the first part that has it, so what parts say of a node adds up, and the last sum merges
the parts' forests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import materialised

MARK = 16
BLOCK = 4096
PART_ROWS = 20_000
#: Depth of the sort key's part that deals rows to ranges; rows are sorted by all of it.
DEALT_DEPTH = 32
GROUP = 100
HEADS = 6


def rebuilt(turns: DataFrame) -> DataFrame:
    """Every conversation with the first turns of its group's first one: ``conv_id``, ``turns``.

    ``turns`` holds (digest, code points) in order; h = crc32 of the decimal id modulo 6 turns come from
    conversation c - c % 100. Turns are ordered by number, null first, then role and text.
    """
    own = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    digest = F.unhex(F.sha2(F.concat(F.length(F.encode("role", "UTF-8")), F.lit(":"), "role", "text"), 256))
    line = F.struct(
        "turn", "role", F.xxhash64("text").alias("tie"), digest.alias("digest"), F.length("text").cast("long").alias("points")
    )
    # the order of texts of one turn number and role needs the texts, which are only carried where they tie
    placed = own.select(
        "conv_id", line.alias("line"), "text",
        F.count("*").over(Window.partitionBy("conv_id", "turn", "role")).alias("ties"),
    )
    placed = placed.select(
        "conv_id",
        F.struct(
            "line.turn", "line.role", F.when(F.col("ties") > 1, F.col("text")).alias("text"), "line.digest", "line.points"
        ).alias("line"),
    )
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    nulls_first = F.concat(
        F.filter("lines", lambda x: x["turn"].isNull()), F.filter("lines", lambda x: x["turn"].isNotNull())
    )
    short = F.transform(nulls_first, lambda x: F.struct(x["digest"].alias("digest"), x["points"].alias("points")))
    whole = materialised(whole.select("conv_id", short.alias("turns")))
    base = whole.where(F.col("conv_id") % GROUP == 0).select(
        F.col("conv_id").alias("head"), F.slice("turns", 1, HEADS - 1).alias("first")
    )
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS)).cast("int")
    both = whole.withColumn("head", F.col("conv_id") - F.col("conv_id") % GROUP).join(base, "head", "left")
    own_rest = F.filter("turns", lambda x, i: i >= h)
    first = F.filter(F.coalesce("first", F.slice("turns", 1, 0)), lambda x, i: i < h)
    return both.select("conv_id", F.concat(first, own_rest).alias("turns"))


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks and code points of each conversation as two packed columns."""
    for batch in batches:
        marks, points = [], []
        for turns in batch.column("turns").to_pylist():
            last, own = b"", []
            for turn in turns:
                last = hashlib.sha256(last + turn["digest"]).digest()[:MARK]
                own.append(last)
            marks.append(own)
            points.append([turn["points"] for turn in turns])
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(marks, pa.list_(pa.binary())), pa.array(points, pa.list_(pa.int64()))],
            ["conv_id", "marks", "points"],
        )


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each name's blocks in order; a task holds one block and one running hash."""
    name, running = None, None

    def out(name: bytes, running) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([name], pa.binary()), pa.array([running.hexdigest()], pa.string())], ["name", "ends_sha256"]
        )

    for batch in batches:
        for own, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if own != name:
                if name is not None:
                    yield out(name, running)
                name, running = own, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
    if name is not None:
        yield out(name, running)


def distinct(convs: DataFrame) -> DataFrame:
    """One row a distinct sequence: marks, points, members, least member, hash of the members' ids."""
    name = F.when(F.size("marks") > 0, F.element_at("marks", -1)).otherwise(F.lit(b""))
    named = convs.withColumn("name", name)
    what = named.groupBy("name").agg(
        F.first("marks").alias("marks"), F.first("points").alias("points"),
        F.count("*").alias("members"), F.min("conv_id").alias("least"),
    )
    # ids of a block lie in a range of 4096, so blocks are bounded and follow each other in order
    blocks = named.groupBy("name", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids")
    )
    ends = (
        blocks.repartition("name").sortWithinPartitions("name", "block")
        .mapInArrow(hashed, "name binary, ends_sha256 string")
    )
    return what.join(ends, "name").drop("name")


def columns(rows: pd.DataFrame) -> tuple[list, list, np.ndarray, np.ndarray, list]:
    rows = rows.sort_values("marks", key=lambda s: s.map(lambda m: tuple(bytes(x) for x in m)), kind="stable")
    marks = [[bytes(x) for x in m] for m in rows["marks"]]
    return marks, list(rows["points"]), rows["members"].to_numpy(), rows["least"].to_numpy(), list(rows["ends_sha256"])


def common(a: list[bytes], b: list[bytes]) -> int:
    """Depth to which two rows agree; equal marks mean equal prefixes, so halving finds it."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[mid - 1] == b[mid - 1] else (low, mid - 1)
    return low


def spines(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a part's first and last row, with their smallest members inside the part."""
    marks, _, _, least, _ = columns(rows)
    out = []
    for left, end in ((True, 0), (False, -1)):
        own = marks[end]
        depths = np.array([common(own, m) for m in marks])
        smallest = np.full(len(own) + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, depths, least)
        smallest = np.minimum.accumulate(smallest[::-1])[::-1]
        out += [(int(rows["part"].iloc[0]), left, d, own[d - 1] if d else b"", int(smallest[d])) for d in range(len(own) + 1)]
    return pd.DataFrame(out, columns=["part", "left", "depth", "mark", "least"])


def forest(marks: list, members: np.ndarray, least: np.ndarray) -> list[tuple[int, int, int, int, list[int]]]:
    """Compressed trie of sorted distinct rows: (depth, low, high, parent, children) of every node.

    Rows are leaves of the union-find; a row that is a prefix of later ones is the node they grow from.
    """
    n = len(marks)
    depth = [len(m) for m in marks]
    low, high = list(range(n)), list(range(n))
    children: list[list[int]] = [[] for _ in range(n)]
    top = list(range(n))  # node of each component's root
    link = list(range(n))

    def root(i: int) -> int:
        while link[i] != i:
            link[i] = link[link[i]]
            i = link[i]
        return i

    shared = [common(marks[i], marks[i + 1]) for i in range(n - 1)]
    for i in sorted(range(n - 1), key=lambda i: (-shared[i], i)):
        a, b = root(i), root(i + 1)
        one, two = top[a], top[b]
        if depth[one] == shared[i]:
            node = one
        else:
            node = len(depth)
            depth.append(shared[i])
            low.append(low[one])
            high.append(high[one])
            children.append([one])
        children[node].append(two)
        high[node] = high[two]
        link[b] = a
        top[a] = node
    parent = [-1] * len(depth)
    for node, below in enumerate(children):
        for child in below:
            parent[child] = node
    return list(zip(depth, low, high, parent, children, strict=True))


RESULT = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)


def nodes(rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """What a part knows of each of its nodes; of shared ones, its share."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    if not len(rows):
        return pd.DataFrame(columns=names)
    marks, points, members, least, sha = columns(rows)
    n, last = len(marks), len(marks) - 1
    left, right = ends["left"].to_numpy(bool), ~ends["left"].to_numpy(bool)
    #: Depth to which earlier and later parts share the first and the last row.
    before = int(ends.loc[left & ends["earlier"].to_numpy(bool), "depth"].max()) if (left & ends["earlier"]).any() else -1
    after = int(ends.loc[right & ends["later"].to_numpy(bool), "depth"].max()) if (right & ends["later"]).any() else -1
    known = {(bool(s), int(d)): int(v) for s, d, v in zip(ends["left"], ends["depth"], ends["least"], strict=True)}
    tree = forest(marks, members, least)
    total, smallest = [0] * len(tree), [0] * len(tree)
    leaves, saved = [0] * len(tree), [0] * len(tree)
    out = []

    def conv(low: int, high: int, d: int, inside: int) -> int:
        if low == 0 and d <= before:
            return known[True, d]
        return known[False, d] if high == last and d <= after else inside

    upward = sorted(range(len(tree)), key=lambda k: -tree[k][0])
    for k in upward:
        depth, low, high, parent, below = tree[k]
        ends_here = len(marks[low]) == depth
        total[k] = sum(total[c] for c in below) + (int(members[low]) if ends_here else 0)
        smallest[k] = min([smallest[c] for c in below] + ([int(least[low])] if ends_here else []))
        childless = not below and not (high == last and after >= depth)
        leaves[k] = sum(leaves[c] for c in below) + childless
        saved_here = sum(saved[c] for c in below)
        stop = tree[parent][0] if parent >= 0 else -1
        row_points = points[low]
        for d in range(depth, stop, -1):
            own = low != 0 or d > before
            saved_here += int(row_points[d - 1]) * (total[k] - own) if d else 0
            mine = conv(low, high, d, smallest[k])
            if d > stop + 1 or parent < 0:
                above = conv(low, high, d - 1, smallest[k]) if d else None
            else:
                above = None  # the parent's smallest member is known once the parent is reached
            first_below = d < depth or any(tree[c][1] == 0 for c in below)
            children = (len(below) if d == depth else 1) - (low == 0 and d + 1 <= before and first_below)
            ends_sha = sha[low] if d == depth and ends_here else None
            waits = k if d == stop + 1 and parent >= 0 else -1
            out.append([mine, d, above, total[k], children, leaves[k], saved_here, ends_sha, waits])
        saved[k] = saved_here
    for row in out:
        k = row.pop()
        if k >= 0:
            p = tree[k][3]
            row[2] = conv(tree[p][1], tree[p][2], tree[p][0], smallest[p])
    frame = pd.DataFrame(out, columns=names)
    frame["parent_conv_id"] = frame["parent_conv_id"].astype("Int64")
    return frame


def prefix_trie(turns: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """A row per node of the trie of rebuilt conversations (columns conv_id, turn, role, text).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Rows without conv_id belong to no conversation; null roles and texts are
    empty; repeated rows are turns of their own; an empty table has no node, not even the root. A
    conversation is one row of 16 bytes a turn, as a document is one row; its texts are never gathered.
    """
    marks = rebuilt(turns).mapInArrow(marked, "conv_id long, marks array<binary>, points array<long>")
    rows = materialised(distinct(materialised(marks)))
    parts = max(1, -(-rows.count() // part_rows))
    dealt = rows.repartitionByRange(parts, F.slice("marks", 1, DEALT_DEPTH)).withColumn("part", F.spark_partition_id())
    dealt = materialised(dealt)
    ends = dealt.groupBy("part").applyInPandas(spines, "part int, left boolean, depth int, mark binary, least long")
    ends = materialised(ends)
    shared = ends.groupBy("mark", "depth").agg(
        F.min("part").alias("lowest"), F.max("part").alias("highest"), F.min("least").alias("least")
    )
    known = ends.drop("least").join(shared, ["mark", "depth"]).select(
        "part", "left", "depth", (F.col("lowest") < F.col("part")).alias("earlier"),
        (F.col("highest") > F.col("part")).alias("later"), "least",
    )
    share = dealt.groupBy("part").cogroup(known.groupBy("part")).applyInPandas(nodes, RESULT)
    return share.groupBy("conv_id", "depth").agg(
        F.max("parent_conv_id").alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.coalesce(F.max("ends_sha256"), F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
