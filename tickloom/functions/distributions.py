"""Normal and Student t probabilities as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the double-precision rational form of the normal tail.
TAIL_TOP = (
    3.52624965998911e-2,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
TAIL_BOTTOM = (
    8.83883476483184e-2,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
# Coefficients of the rational form of the normal quantile.
QUANTILE_A = (
    -3.969683028665376e1,
    2.209460984245205e2,
    -2.759285104469687e2,
    1.383577518672690e2,
    -3.066479806614716e1,
    2.506628277459239,
)
QUANTILE_B = (
    -5.447609879822406e1,
    1.615858368580409e2,
    -1.556989798598866e2,
    6.680131188771972e1,
    -1.328068155288572e1,
    1.0,
)
QUANTILE_C = (
    -7.784894002430293e-3,
    -3.223964580411365e-1,
    -2.400758277161838,
    -2.549732539343734,
    4.374664141464968,
    2.938163982698783,
)
QUANTILE_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0)


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(z: Column) -> Column:
    """``P(Z <= z)``, to about fifteen digits inside eight deviations."""
    x = F.abs(z)
    near = F.exp(-x * x / 2) * _poly(x, TAIL_TOP) / _poly(x, TAIL_BOTTOM)
    tail = F.when(x > 7.07, F.exp(-x * x / 2) / (x * math.sqrt(2 * math.pi))).otherwise(near)
    return F.when(z > 0, F.lit(1.0) - tail).otherwise(tail)


def normal_quantile(p: Column) -> Column:
    """The z with ``P(Z <= z) = p`` (relative error about 1e-9)."""
    low = 0.02425
    q = F.sqrt(F.log(F.when(p < low, p).otherwise(F.lit(1.0) - p)) * -2)
    outer = _poly(q, QUANTILE_C) / _poly(q, QUANTILE_D)
    r = p - 0.5
    inner = r * _poly(r * r, QUANTILE_A) / _poly(r * r, QUANTILE_B)
    return F.when(p < low, outer).when(p > 1 - low, -outer).otherwise(inner)


def t_upper_tail(t: Column, df: Column) -> Column:
    """``P(T >= t)`` for whole degrees of freedom, by the finite trigonometric series."""
    d = df.cast("long")
    theta = F.atan(F.abs(t) / F.sqrt(d))
    s, c2 = F.sin(theta), F.cos(theta) * F.cos(theta)
    even = F.pmod(d, F.lit(2)) == 0
    steps = F.when(even, F.floor(d / 2) - 1).otherwise(F.floor((d - 1) / 2) - 1).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(state: Column, k: Column) -> Column:
        share = F.when(even, (2 * k - 1) / (2 * k)).otherwise((2 * k) / (2 * k + 1))
        term = state["term"] * c2 * share
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    ks = F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    series = F.aggregate(ks, start, add)["total"]
    odd = F.when(d == 1, theta).otherwise(theta + s * F.cos(theta) * series) * (2 / math.pi)
    inside = F.when(even, s * series).otherwise(odd)
    return F.when(t >= 0, (F.lit(1.0) - inside) / 2).otherwise((F.lit(1.0) + inside) / 2)


def normal_cdf_sql(z: str) -> str:
    """The same expression as SQL text, for the side-by-side check."""

    def poly(cs: tuple[float, ...]) -> str:
        out = repr(cs[0])
        for c in cs[1:]:
            out = f"({out} * abs({z}) + {c!r})"
        return out

    tail = f"exp(-({z}) * ({z}) / 2) * {poly(TAIL_TOP)} / {poly(TAIL_BOTTOM)}"
    return f"(CASE WHEN ({z}) > 0 THEN 1 - {tail} ELSE {tail} END)"
