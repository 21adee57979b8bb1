"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

import catalog
from marketrisk.session import build_session

HEADLINE = [
    "daily_rv",
    "daily_rv_by_symbol",
    "range_estimators",
    "return_stats",
    "vol_rolling",
    "vol_decayed",
    "quotes_daily",
    "path_intraday",
    "path_daily",
    "liquidity_daily",
    "volume_profile",
    "crash_boom_labels",
    "cv_folds",
    "macro_signals",
    "calendar_features",
    "regime_states",
    "technical_trend",
    "utility_grid",
    "ranking_scores",
    "evaluation_summary",
    "missing_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS"))
    all_queries = catalog.queries()
    # one small query first, so that session start-up is not charged to the first headline query
    all_queries["cv_folds"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        all_queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
