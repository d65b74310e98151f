"""Book features (touch, rolling, depth)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickloom.functions.book import build_features, depth_features
from tickloom.plans.fixtures import Fixtures
from tickloom.plans.registry import query

BASE = """
WITH t AS (
  SELECT *, (bid_price_0 + ask_price_0) / 2 AS mid,
    (bid_size_0 - ask_size_0) / (bid_size_0 + ask_size_0) AS imb,
    bid_size_0 + ask_size_0 AS total,
    (bid_price_0 * ask_size_0 + ask_price_0 * bid_size_0) / (bid_size_0 + ask_size_0) AS micro
  FROM fx_book),
b AS (SELECT *, 1e4 * (ask_price_0 - bid_price_0) / mid AS spread FROM t),
c AS (SELECT *,
    CASE WHEN bid_price_0 > lag(bid_price_0) OVER w THEN bid_size_0
         WHEN bid_price_0 = lag(bid_price_0) OVER w THEN bid_size_0 - lag(bid_size_0) OVER w
         WHEN bid_price_0 < lag(bid_price_0) OVER w THEN -lag(bid_size_0) OVER w END
    - CASE WHEN ask_price_0 < lag(ask_price_0) OVER w THEN ask_size_0
         WHEN ask_price_0 = lag(ask_price_0) OVER w THEN ask_size_0 - lag(ask_size_0) OVER w
         WHEN ask_price_0 > lag(ask_price_0) OVER w THEN -lag(ask_size_0) OVER w END AS ofi,
    1e4 * ln(mid / lag(mid) OVER w) AS step,
    CASE WHEN bid_price_0 = lag(bid_price_0) OVER w AND ask_price_0 = lag(ask_price_0) OVER w
         THEN 0 ELSE 1 END AS moved,
    row_number() OVER w AS rn
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY us, seq)),
e AS (SELECT *, max(CASE WHEN moved = 1 THEN rn END) OVER w AS moved_at
  FROM c WINDOW w AS (PARTITION BY symbol ORDER BY us, seq))
"""


def roll(fn: str, n: int, least: int | None = None) -> str:
    frame = f"(PARTITION BY symbol ORDER BY us, seq ROWS {n - 1} PRECEDING)"
    inner = fn[fn.index("(") + 1 : -1].split(",")[0]
    return f"CASE WHEN count({inner}) OVER {frame} >= {least or n} THEN {fn} OVER {frame} END"


W = "OVER (PARTITION BY symbol ORDER BY us, seq)"
SQL = {
    "f1_spread_bp": "spread",
    "f2_queue_imbalance": "imb",
    "f3_microprice_dev_bp": "1e4 * (micro - mid) / mid",
    "f4_log_depth_ratio": "ln(bid_size_0 / ask_size_0)",
    "f5_log_total_depth": "ln(total)",
    "f7_ofi_1": "ofi",
    "f8_ofi_20": roll("sum(ofi)", 20),
    "f9_ofi_20_norm": f"({roll('sum(ofi)', 20)}) / ({roll('avg(total)', 50)})",
    "f10_mid_return_1_bp": "step",
    "f10_mid_return_20_bp": f"1e4 * ln(mid / lag(mid, 20) {W})",
    "f11_realized_vol_50_bp": roll("stddev_samp(step)", 50),
    "f12_spread_bp_ratio_50": f"spread / ({roll('avg(spread)', 50)})",
    "f13_quote_intensity_20": roll("avg(moved)", 20, 1),
    "f14_imbalance_slope_10": f"imb - lag(imb, 10) {W}",
    "f15_touch_persistence_20": "least(20, rn - moved_at)",
    "f16_mid_reversal_10": f"-(1e4 * ln(mid / lag(mid, 5) {W})) "
    f"* (1e4 * ln(lag(mid, 5) {W} / lag(mid, 10) {W}))",
    "f17_spread_pressure_20": f"spread / ({roll('median(spread)', 20, 5)})",
    "f18_size_shock_10": f"((bid_size_0 - ask_size_0) - lag(bid_size_0 - ask_size_0) {W}) "
    f"/ ({roll('avg(total)', 10, 3)})",
    "f19_micro_drift_5": f"1e4 * ln(micro / lag(micro, 5) {W})",
    "f20_realised_vol_20": roll("stddev_samp(step)", 20, 5),
}


def _register(name: str, expression: str) -> None:
    feature = name.split("_", 1)[1]

    @query(name, f"{BASE} SELECT symbol, us, seq, {expression} AS {feature} FROM e", d=feature)
    def run(fx: Fixtures) -> DataFrame:
        return build_features(fx.book, [feature], spine=fx.spine)


for _name, _sql in SQL.items():
    _register(_name, _sql)


def _levels(template: str) -> str:
    return " + ".join(template.replace("#", str(i)) for i in range(5))


@query(
    "f21_depth_set",
    f"""
    WITH t AS (SELECT *, (bid_price_0 + ask_price_0) / 2 AS mid FROM fx_book),
    s AS (SELECT symbol, us, seq, bid_size_0 AS b0, ask_size_0 AS a0,
      {_levels("bid_size_#")} AS bt, {_levels("ask_size_#")} AS ak,
      {_levels("bid_size_# / ((mid - bid_price_#) / mid * 1e4)")} AS bw,
      {_levels("ask_size_# / ((ask_price_# - mid) / mid * 1e4)")} AS aw,
      {_levels("bid_size_# * (mid - bid_price_#) / mid * 1e4")} AS bp,
      {_levels("ask_size_# * (ask_price_# - mid) / mid * 1e4")} AS ap,
      (mid - bid_price_4) / mid * 1e4 AS bf, (ask_price_4 - mid) / mid * 1e4 AS af FROM t)
    SELECT symbol, us, seq, (bt - ak) / (bt + ak) AS depth_imbalance,
      (bw - aw) / (bw + aw) AS weighted_depth_imbalance, b0 / bt AS bid_concentration,
      a0 / ak AS ask_concentration, b0 / bt - a0 / ak AS concentration_imbalance,
      bf / bt AS bid_slope_bp, af / ak AS ask_slope_bp, af / ak - bf / bt AS slope_imbalance,
      bp / bt AS bid_impact_bp, ap / ak AS ask_impact_bp,
      ap / ak - bp / bt AS impact_imbalance_bp, ln(bt + ak) AS log_visible_depth,
      (bf + af) / 2 AS book_span_bp FROM s""",
    d="depth_imbalance weighted_depth_imbalance bid_concentration ask_concentration "
    "concentration_imbalance bid_slope_bp ask_slope_bp slope_imbalance bid_impact_bp "
    "ask_impact_bp impact_imbalance_bp log_visible_depth book_span_bp",
)
def depth_set(fx: Fixtures) -> DataFrame:
    return depth_features(fx.book)
