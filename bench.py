"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from touchcredit.jobs import SESSION  # noqa: E402
from touchcredit.registry.queries import QUERIES  # noqa: E402

HEADLINES = [
    "clean_all_rules",
    "list_attribution",
    "click_attribution",
    "touch_matrix",
    "window_attribution_lob",
    "latest_touch",
    "latest_touch_events",
    "new_to_company",
    "new_to_lob",
    "flash_metrics",
    "research_metrics",
    "combined_metrics",
    "promo_metrics",
    "regional_metrics",
    "revenue_breakdown",
    "new_customer_list",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("touchcredit-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config(map=SESSION)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINES:
        runs = []
        for attempt in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:  # the first run also pays for code generation
                runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name,
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
