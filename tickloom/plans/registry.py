"""The list of named queries and the SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.plans.fixtures import Fixtures
from tickloom.plans.fixture_sql import VIEWS

DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Fixtures], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]
    longs: tuple[str, ...]
    digits: int


QUERIES: dict[str, Query] = {}


def query(
    name: str, sql: str | None = None, d: str = "", i: str = "", digits: int = DIGITS
) -> Callable:
    """Register a query; ``d`` and ``i`` name its floating and whole-number columns."""

    def add(run: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, run, sql, tuple(d.split()), tuple(i.split()), digits)
        return run

    return add


def rounded(value: Column, digits: int) -> Column:
    """``value`` to that many digits as SQL's engine does it: scaled in floating point, half away from
    zero, scaled back. Spark's own ``round`` goes by the shortest decimal instead, which falls on the
    other side where a value is within its last bit of a half. What cannot be scaled stays as it is."""
    scale = F.lit(10.0**digits)
    out = F.round(value * scale) / scale
    return F.when(F.abs(out) < F.lit(float("inf")), out).otherwise(value)


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round floats, widen integers: both engines then print the same values."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType | T.FloatType):
            c = rounded(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(field.dataType, T.ByteType | T.ShortType | T.IntegerType):
            c = c.cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)


def used_views(sql: str) -> list[str]:
    """Views a statement needs, dependencies first."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in found:
                visit(VIEWS[name])
                found.append(name)

    visit(sql)
    return found


def full_sql(q: Query) -> str:
    """The statement with its views in front and its floats rounded."""
    assert q.sql is not None
    views = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used_views(q.sql))
    fix = [f'round(CAST("{c}" AS DOUBLE), {q.digits}) + 0.0 AS "{c}"' for c in q.doubles]
    fix += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in q.longs]
    star = f"* REPLACE ({', '.join(fix)})" if fix else "*"
    head = f"WITH {views} " if views else ""
    return f"{head}SELECT {star} FROM ({q.sql.strip()}) AS result"


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(q.run(Fixtures(spark, sf_dir)), q.digits)

    run.__name__ = q.name
    return run
