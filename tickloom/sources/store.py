"""Stored planes: partitioned Parquet with a manifest table beside them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import day_of
from tickloom.sources.contracts import conform

# Fixed value: the largest finite half-precision float.
FLOAT16_MAX = 65504.0


def write_plane(
    df: DataFrame,
    path: str,
    plane: str,
    *,
    sampled_s: float | None = None,
    depth: int | None = None,
    mode: str = "overwrite",
) -> None:
    """Write a plane partitioned by symbol and day, and one manifest row beside it.

    Rows are placed by (symbol, day) and a hash of the stamp, so a busy day is written by many
    tasks and read back as several files.
    """
    staged = df if "day" in df.columns else df.withColumn("day", day_of("us"))
    slice_ = F.pmod(F.floor(F.col("us") / F.lit(3_600_000_000)), F.lit(24)).alias("_slice")
    placed = staged.select("*", slice_).repartition("symbol", "day", "_slice").drop("_slice")
    placed.write.mode(mode).partitionBy("symbol", "day").parquet(f"{path}/{plane}")
    facts = (
        df.sparkSession.read.parquet(f"{path}/{plane}")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("us").alias("first_us"),
            F.max("us").alias("last_us"),
            F.count_distinct("symbol").alias("symbols"),
        )
        .select(
            F.lit(plane).alias("plane"),
            "rows",
            "symbols",
            "first_us",
            "last_us",
            F.lit(depth).cast("int").alias("depth"),
            F.lit(sampled_s).cast("double").alias("sampled_s"),
        )
    )
    facts.coalesce(1).write.mode(mode).parquet(f"{path}/_manifests/{plane}")


def read_plane(
    spark: SparkSession,
    path: str,
    plane: str,
    schema: T.StructType | None = None,
    *,
    symbols: Sequence[str] | None = None,
    first_day: str | None = None,
    last_day: str | None = None,
) -> DataFrame:
    """A stored plane; symbol and day bounds prune folders before any file is opened."""
    df = spark.read.parquet(f"{path}/{plane}")
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(list(symbols)))
    if first_day is not None:
        df = df.filter(F.col("day") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        df = df.filter(F.col("day") <= F.lit(last_day).cast("date"))
    return df if schema is None else conform(df, schema, extras=("us", "day"))


@dataclass(frozen=True)
class StoredPlane:
    """One plane found on disk."""

    plane: str
    columns: tuple[str, ...]
    depth: int
    sampled: bool


def discover(spark: SparkSession, path: str) -> list[StoredPlane]:
    """Planes named by the manifests under ``path``; reads schemas and one-row manifests only."""
    manifests = spark.read.parquet(f"{path}/_manifests/*")
    found = []
    for row in manifests.select("plane", "sampled_s").orderBy("plane").toLocalIterator():
        columns = tuple(spark.read.parquet(f"{path}/{row['plane']}").columns)
        levels = {int(m[1]) for c in columns if (m := re.fullmatch(r"bid_price_(\d+)", c))}
        found.append(StoredPlane(row["plane"], columns, len(levels), row["sampled_s"] is not None))
    return found


def inventory(spark: SparkSession, path: str, plane: str) -> DataFrame:
    """Files and rows per symbol and day of a stored plane."""
    df = spark.read.parquet(f"{path}/{plane}")
    return df.groupBy("symbol", "day").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(F.input_file_name()).alias("files")
    )


def median_touch_size(book: DataFrame) -> DataFrame:
    """One row: the median touch size, both sides pooled, exact from value counts."""
    sizes = book.select(F.explode(F.array("bid_size_0", "ask_size_0")).alias("v"))
    counts = sizes.groupBy(F.round("v", 8).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.percentile("v", F.lit(0.5), F.col("n")).alias("touch_size"))


def to_stored(
    df: DataFrame, raw_sizes: Sequence[str], touch_size: DataFrame, keep: Sequence[str]
) -> DataFrame:
    """Raw sizes over the touch size, every input narrowed to single precision."""
    scaled = df.join(F.broadcast(touch_size))  # one row
    inputs = [c for c in df.columns if c not in keep]

    def stored(c: str) -> Column:
        value = F.col(c) / F.col("touch_size") if c in raw_sizes else F.col(c)
        return value.cast("float").alias(c)

    return scaled.select(*keep, *[stored(c) for c in inputs])


def finiteness(df: DataFrame, columns: Sequence[str], bound: float = FLOAT16_MAX) -> DataFrame:
    """Per column: rows that are infinite, and finite rows beyond the narrow type. One pass."""
    wide = df.agg(
        *[
            F.struct(
                F.count_if(F.abs(F.col(c)) == float("inf")).alias("infinite"),
                F.count_if((F.abs(F.col(c)) > bound) & (F.abs(F.col(c)) < float("inf"))).alias(
                    "overflow"
                ),
            ).alias(c)
            for c in columns
        ]
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("f")) for c in columns])
    )
    return wide.select(rows.alias("r")).select(
        "r.column", F.col("r.f.infinite").alias("infinite"), F.col("r.f.overflow").alias("overflow")
    )


def latest_bars(bars: DataFrame, load_order: str) -> DataFrame:
    """One bar per symbol and close: the last loaded of a repeated one."""
    w = Window.partitionBy("symbol", "us").orderBy(F.desc(load_order))
    return bars.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
