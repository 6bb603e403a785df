"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once unmeasured and REPEATS times measured; the median of the
seconds counts.  Rows, shuffle and spill of the last run come from Spark's event log.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import tempfile
import time
from collections import defaultdict

from pyspark.sql import SparkSession

from tickweave.plans.queries import QUERIES

HEADLINE = [
    "flagship_label_counts", "i1_i11_factors", "i7_i8_rolling_factors", "j2_j4_labels", "j7_j8_fill_labels", "g1_per_second", "g9_gap_segments", "g4_g15_day_summary", "h1_h5_field_quality",
    "e1_splice", "e10_daily_aggregate", "f4_latest_ticks", "c5_trading_day", "c11_session_trim", "d2_d4_daily_schedule", "k7_metrics", "k11_k15_strategy_gate",
]
REPEATS = 3


def task_figures(log_dir: str) -> dict[str, dict[str, int]]:
    """Rows read, MB shuffled and MB spilled of each job group in the event logs of a folder."""
    group_of: dict[int, str] = {}
    found: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for path in glob.glob(f"{log_dir}/*"):
        with open(path) as log:
            for line in log:
                event = json.loads(line)
                if event["Event"] == "SparkListenerJobStart":
                    group = event["Properties"].get("spark.jobGroup.id")
                    for stage in event["Stage IDs"]:
                        group_of[stage] = group
                elif event["Event"] == "SparkListenerTaskEnd" and (group := group_of.get(event["Stage ID"])) and (m := event.get("Task Metrics")):
                    found[group]["rows_read"] += m["Input Metrics"]["Records Read"]
                    found[group]["shuffle_bytes"] += m["Shuffle Write Metrics"]["Shuffle Bytes Written"]
                    found[group]["spill_bytes"] += m["Disk Bytes Spilled"]
    return {k: dict(v) for k, v in found.items()}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    logs = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"file://{logs}")
        .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        seconds = []
        for run in range(REPEATS + 1):
            spark.sparkContext.setJobGroup(name if run == REPEATS else "other", name)
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            seconds.append(time.time() - began)
        took[name] = round(statistics.median(seconds[1:]), 3)
    spark.stop()
    figures = task_figures(logs)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
        "repeats": REPEATS, "tasks": {n: figures.get(n, {}) for n in HEADLINE},
    }))


if __name__ == "__main__":
    main()
