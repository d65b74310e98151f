"""Small Column helpers: NULL-safe arithmetic and windows with a minimum count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

BP = 1e4
US = 1_000_000


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Division where a zero denominator means unknown."""
    return F.try_divide(col(top).cast("double"), col(bottom).cast("double"))


def ln(value: Column | str) -> Column:
    """Natural log; NULL where it is not defined."""
    v = col(value)
    return F.when(v > 0, F.log(v))


def bp_change(now: Column, before: Column) -> Column:
    return F.lit(BP) * ln(ratio(now, before))


def rolling(
    fn: Callable[[Column], Column], x: Column | str, w: WindowSpec, n: int, least: int | None = None
) -> Column:
    """``fn`` over the last ``n`` rows, NULL with fewer than ``least`` values (default ``n``)."""
    frame = w.rowsBetween(-(n - 1), 0)
    value = fn(col(x)).over(frame)
    need = n if least is None else least
    if need <= 1:
        return value
    return F.when(F.count(col(x)).over(frame) >= need, value)


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def quantile(q: float) -> Callable[[Column], Column]:
    return lambda x: F.percentile(x, F.lit(q))


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    """Bound a value; NULL stays NULL."""
    lo = low if isinstance(low, Column) else F.lit(low)
    hi = high if isinstance(high, Column) else F.lit(high)
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def day_of(us: Column | str) -> Column:
    """UTC day of a microsecond stamp, as a date."""
    return F.date_add(
        F.lit("1970-01-01").cast("date"), F.floor(col(us) / F.lit(86_400 * US)).cast("int")
    )


def utc_micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp; the session time zone must be UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def corr(x: Column | str, y: Column | str) -> Column:
    """Correlation of the pairs both sides have; NULL (not an error) when either side is flat."""
    a, b = col(x), col(y)
    both = a.isNotNull() & b.isNotNull()
    u, v = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(u, v), F.stddev_pop(u) * F.stddev_pop(v))
