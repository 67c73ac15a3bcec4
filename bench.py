"""Wall time of the headline queries; prints one JSON line.

Each query is run from its source tables: tables kept for interactive use are
dropped before every query, so no time is hidden in an earlier one.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from checks.catalog import QUERIES, forget  # noqa: E402

HEADLINE = [
    "activity_dedup_signature",
    "sport_family_daily_rollup",
    "running_load_7d_28d_acwr",
    "literature_score_daily",
    "rolling_sum_percentile",
    "bone_stress_scores",
    "recovery_risk_scores",
    "bone_periods",
    "alert_tiers",
    "embedding_anomaly",
    "embedding_knn",
    "explained_days",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="paceframe-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small run loads classes and starts the Python workers.
    QUERIES["literature_score_daily"].spark(spark, sf_dir).limit(1).count()
    times: dict[str, float] = {}
    for name in names:
        forget()
        start = time.perf_counter()
        QUERIES[name].spark(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    forget()
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total wall time", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
