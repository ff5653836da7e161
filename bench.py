"""Time the headline jobs; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS the local cores. Tables that
several jobs share are built once, under their own names, before the jobs that read them.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from checks import queries as Q

JOBS = [
    ("load_products", Q.products), ("load_contracts", Q.contracts),
    ("build_profiles", Q.profile_tables), ("build_search_tables", lambda spark, d: Q.search_tables(spark, d).index),
    ("session_weights", Q.session_weights), ("query_log", Q.query_log),
    ("understand_queries", Q.understood), ("search_baseline", Q.ranked_baseline),
    ("search_personalised", Q.first_personal), ("feed_all_customers", Q.first_feed),
]
QUERIES = [
    "customer_token_weights", "term_dictionary", "corpus_search", "search_facets", "session_signals",
    "eval_cases", "contains_search", "phrase_matches", "read_quoted", "incremental_index",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}
    for name, job in JOBS:
        start = time.time()
        job(spark, folder)
        timings[name] = round(time.time() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    for name in QUERIES:
        start = time.time()
        Q.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    rows = Q.products(spark, folder).count() + Q.contracts(spark, folder).count()
    rebuild = sum(timings[n] for n in ("load_products", "load_contracts", "build_profiles", "build_search_tables"))
    asked = Q.query_log(spark, folder).count()
    search = timings["understand_queries"] + timings["search_personalised"]
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": folder.rsplit("sf", 1)[-1],
                "rebuild_rows_per_second": round(rows / rebuild, 1),
                "rebuild_rows_per_second_and_core": round(rows / rebuild / int(cores), 1),
                "searches_per_second": round(asked / search, 1),
                "core_milliseconds_per_search": round(1000 * int(cores) * search / asked, 1),
                "feed_customers_per_second": round(asked / timings["feed_all_customers"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
