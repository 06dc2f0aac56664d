"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import time

from quantloom.catalog import load
from quantloom.session import local_session

HEADLINES = (
    "table_daily", "J1_adjusted_bars", "table_fundamentals", "T1_bias", "T4_rsi", "T29_dmi", "A36_idio_vol",
    "R3_momentum", "R4_liquidity", "R6_quality", "W14_financial_events", "S9_versioned_read", "S20_merge_disclosures",
    "X1_mad_winsorize", "X5_neutralized", "X9_monthly_statistics", "X19_mean_correlation", "M7_combined_scores",
    "M13_frozen_ols", "B1_quintile_portfolios", "B13_top_n_backtest", "U6_merged_ranges", "flagship_momentum",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus)
    registry = load()
    registry["table_calendar"].run(spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
