"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from tickloom.plans import catalog
from tickloom.plans.flagship import flagship
from tickloom.plans.registry import QUERIES, runner
from tickloom.session import local_session

HEADLINE = (
    "s19_touch_from_prints g2_filled_grid g11_bars_from_prints g13_book_from_deltas "
    "j1_asof_tolerance j3_forward_bucket f9_ofi_20_norm f21_depth_set t2_rolling_trade_stats "
    "t16_generated_expansion t17_exponential_mean t22_rolling_normaliser l10_triple_barrier "
    "l11_walked_taker_label "
    "x1_thinned_trades x5_hold_table x16_print_fills q9_time_gaps e1_cluster_significance "
    "e7_pbo_splits e25_marginals r4_rank_pairs r15_carry_replay v2_purged_folds b3_kill_switch"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalog.load()
    spark = local_session(cores=cpus, shuffle=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors outside the clock
    times: dict[str, float] = {}

    def timed(name: str, build) -> None:
        started = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)

    timed("flagship", lambda: flagship(spark, sf_dir))
    for name in HEADLINE:
        if name in QUERIES:
            timed(name, lambda n=name: runner(QUERIES[n])(spark, sf_dir))
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
