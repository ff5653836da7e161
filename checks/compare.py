"""Compare the registered queries with their SQL: python -m checks.compare [folder] [name …]."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.queries import QUERIES, SQL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in records), key=repr)


def local_session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]").appName("checks")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def main(folder: str, wanted: list[str]) -> int:
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    database = duckdb.connect()
    database.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    bad = 0
    for name in wanted or list(QUERIES):
        start = time.time()
        try:
            frame = QUERIES[name](spark, folder)
            ours = rows(frame.columns, frame.collect())
            took = time.time() - start
            if name not in SQL:
                print(f"{name}: {len(ours)} rows, {took:.1f}s, no SQL", flush=True)
                continue
            start = time.time()
            result = database.execute(SQL[name])
            columns = [c[0] for c in result.description]
            theirs = rows(columns, result.fetchall())
            same = sorted(columns) == sorted(frame.columns) and ours == theirs
            verdict = "ok" if same else "DIFFERS"
            print(f"{name}: {verdict}, {len(ours)}/{len(theirs)} rows, {took:.1f}s, sql {time.time() - start:.1f}s", flush=True)
            if not same:
                bad += 1
                left, right = set(map(repr, ours)), set(map(repr, theirs))
                print("  columns", sorted(frame.columns), sorted(columns))
                print("  only ours  ", sorted(left - right)[:3], len(left - right))
                print("  only theirs", sorted(right - left)[:3], len(right - left))
        except Exception as error:
            bad += 1
            print(f"{name}: FAILED {type(error).__name__}: {str(error)[:1500]}", flush=True)
    return bad


if __name__ == "__main__":
    target = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(1 if main(target, sys.argv[2:]) else 0)
