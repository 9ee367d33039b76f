"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidecast.plans import catalog  # noqa: E402
from tidecast.session import build_session  # noqa: E402

HEADLINE = (
    "first_touch_daily",
    "first_touch_events",
    "requests_by_region_country",
    "weekday_avg_by_month",
    "top5_per_day",
    "pivot_top5",
    "segment_series",
    "weekly_resample",
    "rolling_30_mean",
    "seasonal_year_doy",
    "periodogram",
    "ols_forecast_365",
    "forecast_180",
    "cv_forecast",
    "cv_metrics_by_horizon",
    "grid_search",
    "random_search",
    "export_segments",
    "reconcile_daily",
    "reconcile_monthly",
    "model_reconcile_monthly",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "tidecast-bench")
    catalog.QUERIES["row_count"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/"))
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
