"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from sparktick.queries import QUERIES
from sparktick.session import build_session

# Bars, labels, execution, signals, encodings, excitation, audit, premise checks and the whole experiment.
HEADLINE = [
    "b1_vwap_bars", "b1_vwap_bars_ties", "l6_day_metrics", "e3_return_surface", "k7_performance", "g1_big_move_signals",
    "g2_random_timing", "n2_shifted_zscore", "n3_intensity_rates", "h6_intensities", "h9_log_likelihood", "h16_fit_review",
    "c4_audit_intensities", "a9_event_auc_trade_label", "a15_autocorrelation", "k10_strategy_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    QUERIES["b1_vwap_bars"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
