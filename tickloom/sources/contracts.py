"""The planes' contracts: columns, types, units; and the structural check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 1


class ContractError(ValueError):
    """A frame lacks a column its plane promises, or carries it in another type."""


def _field(name: str, kind: T.DataType, unit: str = "") -> T.StructField:
    return T.StructField(name, kind, True, {"unit": unit, "version": VERSION})


_TS, _D, _L, _S = T.TimestampType(), T.DoubleType(), T.LongType(), T.StringType()

TRADES = T.StructType(
    [
        _field("ts", _TS, "utc"),
        _field("symbol", _S),
        _field("price", _D, "quote"),
        _field("quantity", _D, "base"),
        _field("is_buyer_maker", T.BooleanType()),
        _field("trade_id", _L),
        _field("source", _S),
    ]
)
PRINTS = T.StructType(
    [
        _field("ts", _TS, "utc"),
        _field("price", _D, "quote"),
        _field("size", _D, "base"),
        _field("aggressor", T.ByteType(), "+1 buyer crossed, -1 seller crossed"),
        _field("trade_id", _L),
        _field("rpi", T.BooleanType()),
        _field("source", _S),
    ]
)
BARS = T.StructType(
    [
        _field("ts", _TS, "utc close"),
        _field("open_time", _TS, "utc"),
        _field("symbol", _S),
        *[_field(c, _D, "quote") for c in ("open", "high", "low", "close")],
        _field("volume", _D, "base"),
        _field("source", _S),
    ]
)


def book_schema(depth: int) -> T.StructType:
    """The wide book contract for ``depth`` levels a side."""
    levels = [
        _field(f"{side}_{kind}_{i}", _D, "quote" if kind == "price" else "base")
        for i in range(depth)
        for side in ("bid", "ask")
        for kind in ("price", "size")
    ]
    head = [_field("ts", _TS, "utc"), _field("symbol", _S), _field("sequence_id", _L)]
    return T.StructType([*head, _field("source", _S), *levels])


_WIDTHS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int"} | {
    "float": "real",
    "double": "real",
}


def _family(kind: T.DataType) -> str:
    return _WIDTHS.get(kind.simpleString(), kind.simpleString())


def check_contract(df: DataFrame, schema: T.StructType, *, strict: bool = False) -> DataFrame:
    """``df`` unchanged, or an error before any job runs.

    Widths of integers and floats may differ; a time stamp without a zone may not pass for one.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in have]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    wrong = [
        f"{f.name}: {have[f.name].simpleString()}, expected {f.dataType.simpleString()}"
        for f in schema.fields
        if _family(have[f.name]) != _family(f.dataType)
    ]
    if wrong:
        raise ContractError("; ".join(wrong))
    extra = sorted(set(have) - {f.name for f in schema.fields})
    if strict and extra:
        raise ContractError(f"unexpected columns: {extra}")
    return df


def conform(df: DataFrame, schema: T.StructType, *, extras: Sequence[str] = ()) -> DataFrame:
    """Contract columns in contract order and type, then any named extras."""
    return check_contract(df, schema).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], *extras
    )
