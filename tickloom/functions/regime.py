"""Hour-of-day profiles and trailing autocorrelation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import US, ln, ratio
from tickloom.operators.chunks import BARS, Layout, chunked, own


def hourly_returns(bars: DataFrame, layout: Layout = BARS) -> DataFrame:
    """Log return of each bar on the one before it."""
    cut = chunked(bars.select("symbol", "us", "close"), layout, rows_back=1)
    ret = ln(ratio("close", F.lag("close").over(layout.window())))
    return own(cut.select("symbol", "us", "_chunk", "_own", ret.alias("ret"))).filter(
        F.col("ret").isNotNull()
    )


def hour_profile(returns: DataFrame) -> DataFrame:
    """Root mean square return per hour of day (24 rows)."""
    hour = (F.floor(F.col("us") / F.lit(3600 * US)) % 24).alias("hour")
    return returns.groupBy(hour).agg(F.sqrt(F.avg(F.col("ret") * F.col("ret"))).alias("rms"))


def normalise_by_hour(returns: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Returns over their hour's profile; the profile has 24 rows, so it is broadcast."""
    fitted = hour_profile(returns) if profile is None else profile
    keyed = returns.withColumn("hour", F.floor(F.col("us") / F.lit(3600 * US)) % 24)
    return keyed.join(F.broadcast(fitted), "hour").withColumn("scaled", ratio("ret", "rms"))
