"""Wall time of the headline queries. Prints one JSON line.

Each query runs once, in catalog order, its full result going to a sink that discards it. The session start and
one small scan are outside the clock; everything else, code generation included, is inside.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from newsflow.plans.catalog import registry

HEADLINE = (
    "trend_forecast",
    "burst_detection",
    "trending_topics",
    "predictions_union",
    "predictions_page",
    "articles_latest_score",
    "articles_page",
    "bias_records_page",
    "keyword_score",
    "model_score",
    "unwrap_payload",
    "accepted_raw",
    "validate_required",
    "tag_messages",
    "normalize_trending",
    "dedup_first",
    "upsert_latest",
    "insert_if_absent",
    "constraint_report",
    "articles_by_source",
    "velocity_series",
    "keyword_salience",
    "trend_forecast_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("newsflow-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    chosen = os.environ.get("BENCH_QUERIES")
    catalog = registry()
    seconds = {}
    for name in chosen.split(",") if chosen else HEADLINE:
        start = time.perf_counter()
        catalog[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, one run each",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
