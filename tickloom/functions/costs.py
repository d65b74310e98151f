"""What a trade costs: walking the visible levels, taker costs, fee tiers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.columns import BP, ratio

# Fixed values: (tier, maker bp, taker bp, group) of the linear-perpetual schedule.
LINEAR_TIERS = (
    ("base", 2.0, 5.5, "all"),
    ("vip1", 1.8, 4.0, "all"),
    ("vip2", 1.6, 3.75, "all"),
    ("vip3", 1.4, 3.5, "all"),
    ("vip4", 1.2, 3.2, "all"),
    ("vip5", 1.0, 3.2, "all"),
    ("supreme_vip", 0.0, 3.0, "all"),
    ("pro1_g1", 1.0, 2.8, "g1"),
    ("pro1_altcoin", 0.0, 2.8, "altcoin"),
    ("pro2_g1", 0.5, 2.5, "g1"),
    ("pro2_altcoin", 0.0, 2.8, "altcoin"),
    ("pro3_g1", 0.25, 2.2, "g1"),
    ("pro3_altcoin", 0.0, 2.5, "altcoin"),
    ("pro4_g1", 0.1, 2.0, "g1"),
    ("pro4_altcoin", 0.0, 2.3, "altcoin"),
    ("pro5_g1", 0.0, 1.8, "g1"),
    ("pro5_altcoin", 0.0, 2.1, "altcoin"),
    ("pro6_g1", 0.0, 1.5, "g1"),
    ("pro6_altcoin", 0.0, 1.8, "altcoin"),
)
# Fixed value: the default taker fee per side, bp.
TAKER_BP = 5.0


def fee_table(spark: SparkSession, venue: str = "linear") -> DataFrame:
    """The schedule as a relation, in the venue's order (19 rows, safe to broadcast)."""
    rows = [(i, venue, *row) for i, row in enumerate(LINEAR_TIERS)]
    return spark.createDataFrame(
        rows, "rank int, venue string, tier string, maker_bp double, taker_bp double, grp string"
    )


def tiers_for(fees: DataFrame, group: str) -> DataFrame:
    """Rows that apply to an instrument of ``group``."""
    return fees.filter(F.col("grp").isin("all", group))


def fee_tier(fees: DataFrame, name: str) -> DataFrame:
    """The tier of that name; an unknown name fails the job rather than giving no row."""
    hit = F.max_by(F.struct("maker_bp", "taker_bp"), F.when(F.col("tier") == name, F.lit(1)))
    missing = F.raise_error(F.lit(f"no fee tier {name}"))
    found = fees.agg(F.count_if(F.col("tier") == name).alias("n"), hit.alias("r"))
    return found.select(
        F.when(F.col("n") > 0, F.lit(name)).otherwise(missing.cast("string")).alias("tier"),
        "r.maker_bp",
        "r.taker_bp",
    )


def best_maker_tier(fees: DataFrame, group: str) -> DataFrame:
    """The lowest maker fee, then the lowest taker fee, then the first listed (one row)."""
    return tiers_for(fees, group).agg(
        F.min_by(
            F.struct("tier", "maker_bp", "taker_bp"), F.struct("maker_bp", "taker_bp", "rank")
        ).alias("r")
    ).select("r.*")


def breakeven_maker(net: Column, turnover: Column, maker_bp: Column) -> Column:
    """The maker fee at which the net would have been zero."""
    return maker_bp + ratio(net, turnover) * BP


@dataclass(frozen=True)
class TakerCosts:
    """Fee and slippage a side, and the share of the quoted spread a round trip pays."""

    fee_bp: float = TAKER_BP
    slippage_bp: float = 0.5
    half_spread_multiplier: float = 1.0

    def round_trip(self, spread_bp: Column | str) -> Column:
        spread = F.col(spread_bp) if isinstance(spread_bp, str) else spread_bp
        return F.lit(2 * self.fee_bp + 2 * self.slippage_bp) + spread * self.half_spread_multiplier

    def entry(self, spread_bp: Column | str) -> Column:
        spread = F.col(spread_bp) if isinstance(spread_bp, str) else spread_bp
        return F.lit(self.fee_bp + self.slippage_bp) + spread * (0.5 * self.half_spread_multiplier)


def walk(prices: Sequence[Column], sizes: Sequence[Column], size: float) -> dict[str, Column]:
    """Walk the visible levels for ``size``: average price, shortfall, levels reached.

    What the levels cannot fill is priced at the deepest one.
    """
    left: Column = F.lit(float(size))
    paid: Column = F.lit(0.0)
    visible: Column = F.lit(0.0)
    reached: Column = F.lit(0)
    for price, held in zip(prices, sizes, strict=True):
        take = F.least(left, held.cast("double"))
        reached = reached + F.when((left > 0) & (held > 0), 1).otherwise(0)
        paid = paid + take * price
        visible = visible + held
        left = left - take
    beyond = F.greatest(left, F.lit(0.0))
    return {
        "vwap": (paid + beyond * prices[-1]) / F.lit(float(size)),
        "beyond": beyond,
        "visible": visible,
        "levels": reached,
        "exceeds": beyond > 0,
    }


def walk_side(side: str, size: float, depth: int) -> dict[str, Column]:
    """Walk one side of a wide book row."""
    return walk(
        [F.col(f"{side}_price_{i}") for i in range(depth)],
        [F.col(f"{side}_size_{i}") for i in range(depth)],
        size,
    )


def with_walks(book: DataFrame, size: float, depth: int, keep: Sequence[str] = ()) -> DataFrame:
    """Book keys, mid and both sides' walks (``buy_*`` takes the asks)."""
    buy, sell = walk_side("ask", size, depth), walk_side("bid", size, depth)
    mid = (F.col("bid_price_0") + F.col("ask_price_0")) / 2
    return book.select(
        "symbol",
        "us",
        "seq",
        *keep,
        mid.alias("mid"),
        *[c.alias(f"buy_{n}") for n, c in buy.items()],
        *[c.alias(f"sell_{n}") for n, c in sell.items()],
    )


def walk_cost_bp(mid: Column, buy_vwap: Column, sell_vwap: Column, crossed: Column) -> Column:
    """Same-snapshot round trip, bp of mid; a crossed book has none."""
    return F.when(~crossed, (buy_vwap - sell_vwap) / mid * BP)


def breakeven_share(move: Column, cost: Column) -> Column:
    """Share of moves larger than the cost; an aggregate."""
    return F.avg(F.when(F.abs(move) > cost, 1.0).otherwise(0.0))
