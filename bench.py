"""Time the headline queries: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

from tapeworks import catalog
from tapeworks.session import build_session

HEADLINE = ("dollar_bars", "split_bars", "split_bars_scaled", "conflate_ticks", "vpin_zscore", "vpin_time_decay", "radar_alerts", "sweep", "large_print",
            "ofi_pulse", "liquidity_bank", "parse_trades", "markout", "friction_filter", "macro_regime", "leader_shock", "triple_barrier", "purged_kfold",
            "book_validity", "book_at", "max_safe_qty", "position_ledger", "shadow_position", "heartbeat_score", "rtt_p99", "cusum", "stream_radar")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    catalog.load()
    spark = build_session("bench", f"local[{cpus}]", cpus, {"spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    catalog.QUERIES["throughput"](spark, sf).count()  # start the JVM's and Python's workers
    seconds = {}
    for q in names:
        start = time.time()
        catalog.QUERIES[q](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[q] = round(time.time() - start, 3)
        print(f"{q} {seconds[q]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
