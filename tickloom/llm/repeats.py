"""What removing repeated windows has in common, whatever the unit: words or bytes.

A window is ``width`` consecutive units of one text. Its *anchor* is a place inside it that its own
content determines, so equal windows hold their anchors at equal offsets under equal keys. The
windows of a text that share an anchor form a run of starts; a run is one row. A key that occurs
once rules out all windows of its run; runs whose whole stretch of text is equal are repeated as a
whole; only the windows of the runs in between, at the ends of repeats, are compared one by one.

Fingerprints that stand for equality of text have 124 bits, of polynomials modulo a prime. A text is named by a hash of its id and
itself: rows that agree in both get the same cuts, and each still counts as a repeat of the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.text import SLICE_BYTES, BytePrints, Prints, mix, signed, slices
from tickloom.session import checkpoint_dir, removed, written


@dataclass
class Runs:
    """Runs of window starts ``low .. high``, counted from the start of text ``text``."""

    text: np.ndarray
    key: np.ndarray
    low: np.ndarray
    high: np.ndarray
    anchor: np.ndarray
    prints: tuple[np.ndarray, np.ndarray]


class Content:
    """Fingerprints of stretches of a sequence of units: two of 62 bits each, from other codes and bases.

    ``other`` is a second, independent code of each unit, needed where codes are fingerprints themselves.
    """

    def __init__(self, codes: np.ndarray, other: np.ndarray | None = None):
        self.spans = (Prints(codes, 0), Prints(mix(codes + np.uint64(1)) if other is None else other, 1))

    @classmethod
    def of_bytes(cls, data: np.ndarray) -> Content:
        """The same for a sequence of bytes."""
        content = cls.__new__(cls)
        content.spans = (BytePrints(data, 0), BytePrints(data, 1))
        return content

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | None = None):
        extra = (end - start).astype(np.uint64) * np.uint64(1 << 20)
        if salt is not None:
            extra = extra + salt.astype(np.uint64)
        return tuple(mix(s.of(start, end) + extra) for s in self.spans)


class Store:
    """Tables of one step, written once to the shared folder and deleted when the step's result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{checkpoint_dir(self.spark)}/table-{uuid.uuid4().hex}"
        written(df, path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        while self.paths:
            removed(self.spark, self.paths.pop())


def name_of(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def repeated_keys(runs: DataFrame, store: Store) -> DataFrame:
    """Keys that occur more than once."""
    return store.keep(runs.groupBy("key").count().where("count > 1").select("key"))


def settle(runs: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """Split runs (``key``, ``row``, ``low``, ``high``, ``r1``, ``r2``, ...) of repeated keys.

    ``runs`` are read from a written table, more than once. Returns runs repeated as a whole, and runs whose windows have to be compared: those that differ
    from all others of their key (``alone``), and one of each kind they may agree with in part.
    """
    kinds = store.keep(
        runs.groupBy("key", "r1", "r2").agg(F.count("*").alias("times"), F.min(F.struct("row", "low")).alias("one"))
    )
    keys = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.min("times").alias("fewest"))
    keys = store.keep(keys.where("kinds > 1 AND fewest = 1").select("key"))
    often = kinds.where("times > 1").select("key", "r1", "r2")
    whole = runs.join(often, ["key", "r1", "r2"], "left_semi")
    named = kinds.join(keys, "key").select("key", "r1", "r2", "times", "one.row", "one.low")
    compared = runs.join(store.keep(named), ["key", "r1", "r2", "row", "low"])
    # rows that agree in id and text share a name and a run: one of them is enough
    compared = compared.dropDuplicates(["key", "row", "low"])
    return whole.select("row", "low", "high"), compared.withColumn("alone", F.col("times") == 1)


def equal_windows(windows: DataFrame, store: Store) -> DataFrame:
    """Of windows ``w1``, ``w2`` at ``row``, ``at``, those that occur more than once and are alone."""
    windows = store.keep(windows)
    often = store.keep(windows.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2"))
    alone = windows.where("alone")
    return alone.join(often, ["w1", "w2"]).select("row", F.col("at").alias("low"), F.col("at").alias("high"))


def exploded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every start of every run, and the run's index."""
    size = np.maximum(high - low + 1, 0)
    run = np.repeat(np.arange(len(low)), size)
    ends = np.cumsum(size)
    return low[run] + np.arange(ends[-1] if len(ends) else 0) - (ends - size)[run], run


def collected(parts: DataFrame) -> DataFrame:
    """The parts of each text as one list: never more than the text's own starts."""
    return parts.groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("parts"))


def with_text(docs: DataFrame, id_col: str, text_col: str, rest: list[Column]) -> DataFrame:
    return docs.select(name_of(id_col, text_col).alias("row"), F.col(text_col).alias("_text"), *rest)


def merged(low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of the windows that start at ``low .. high``, as sorted, disjoint, apart spans."""
    order = np.argsort(low, kind="stable")
    start, end = low[order], high[order] + width
    far = np.maximum.accumulate(end)
    head = np.ones(len(start), bool)
    head[1:] = start[1:] > far[:-1]
    at = np.flatnonzero(head)
    return start[at], far[np.append(at[1:], len(start)) - 1]


RUN_SCHEMA = "key long, row long, low int, high int, anchor int, r1 long, r2 long, sure boolean"
RUN_NAMES = [c.split()[0] for c in RUN_SCHEMA.split(", ")]


def run_batch(names: pa.Array, runs: Runs, offset: int = 0) -> pa.RecordBatch:
    """Rows of runs. Of runs that agree within one text, as in periodic text, all are ``sure`` to be
    repeated, and one stands for them against other texts; sure runs that follow each other are one.
    """
    order = np.lexsort((runs.low, runs.prints[1], runs.prints[0], runs.key, runs.text))
    values = [v[order] for v in (runs.text, runs.key, *runs.prints)]
    new = np.ones(len(order), bool)
    new[1:] = np.any([v[1:] != v[:-1] for v in values], axis=0)
    group = np.cumsum(new) - 1
    twice = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
    one, many = np.sort(order[new]), order[twice]
    many = many[np.lexsort((runs.low[many], runs.text[many]))]
    text, low, high = runs.text[many], runs.low[many], runs.high[many]
    head = np.ones(len(many), bool)
    head[1:] = (text[1:] != text[:-1]) | (low[1:] > high[:-1] + 1)
    at = np.flatnonzero(head)
    text, low = text[at], low[at]
    high = high[np.append(at[1:], len(head)) - 1] if len(at) else high
    spread = mix(low.astype(np.uint64) + np.uint64(1) + (text.astype(np.uint64) << np.uint64(32)))
    none = np.zeros(len(at), np.uint64)

    def column(first: np.ndarray, second: np.ndarray, kind=None) -> pa.Array:
        both = np.concatenate([first, second])
        return pa.array(signed(both) if kind is None else both.astype(kind))

    return pa.RecordBatch.from_arrays(
        [
            column(runs.key[one], spread),
            names.take(pa.array(np.concatenate([runs.text[one], text]) + offset)),
            column(runs.low[one], low, np.int32),
            column(runs.high[one], high, np.int32),
            column(runs.anchor[one], low, np.int32),
            column(runs.prints[0][one], none),
            column(runs.prints[1][one], none),
            pa.array(np.arange(len(one) + len(at)) >= len(one)),
        ],
        RUN_NAMES,
    )


def candidates(found: DataFrame, store: Store) -> DataFrame:
    """Runs whose key occurs more than once, and sure runs; ``found`` is computed once, not once a pass."""
    once = Store(store.spark)
    found = once.keep(found)
    keys = repeated_keys(found.where("NOT sure").select("key"), once).withColumn("hit", F.lit(True))
    runs = store.keep(found.join(keys, "key", "left").where("hit OR sure").drop("hit"))
    once.clear()
    return runs


def find_runs(named: DataFrame, kernel, limit: int = SLICE_BYTES) -> DataFrame:
    """``kernel`` over the texts of ``named`` (``row``, ``_text``), about ``limit`` bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1), limit):
                yield run_batch(batch.column(0), kernel(texts), texts.low)

    return named.select("row", "_text").mapInArrow(run, RUN_SCHEMA)


def each_row(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row index, lows and highs of a column of ``array<struct<low,high>>``."""
    lists = batch.column(column)
    flat = lists.flatten()
    low = np.asarray(flat.field(0)).astype(np.int64)
    high = np.asarray(flat.field(1)).astype(np.int64)
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    ends = np.cumsum(sizes)
    for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
        yield i, low[end - size : end], high[end - size : end]
