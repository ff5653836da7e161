"""Top-k, ranks, pages and rank comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64
#: Rows of a join key that one task multiplies.
JOIN_ROWS = 1000


def top_k(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int,
    rank: str = "rank",
    spread_by: str | None = None,
) -> DataFrame:
    """Exact first ``k`` rows per key, numbered from 1 in ``rank``.

    Spark limits each group inside the map tasks when ``k`` is below
    ``spark.sql.optimizer.windowGroupLimitThreshold``. Above it, a first pass ranks within
    (key, salt of ``spread_by``), so that a key holding a large share of the rows is cut by
    many tasks and at most ``SALTS * k`` of its rows reach the final one.
    """
    if not keys:
        df = df.orderBy(*order).limit(k)
        return df.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
    threshold = int(
        df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    )
    if k > threshold and spread_by:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)))
        inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_place", F.row_number().over(inner))
            .filter(F.col("_place") <= k)
            .drop("_salt", "_place")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def spread_out(df: DataFrame, by: str) -> DataFrame:
    """Rows dealt to as many tasks as a shuffle has, however few bytes they are.

    For rows that are about to multiply: their number of bytes says nothing about the work.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, by)


def spread_join(big: DataFrame, small: DataFrame, key: str, spread_by: str, tasks: int | None = None) -> DataFrame:
    """Inner join in which rows of ``big`` with one key are spread over many join keys.

    For a ``small`` side whose every row multiplies with many of ``big``: a key is split into one part for each
    ``JOIN_ROWS`` rows that ``big`` has of it, and rows of ``small`` are repeated once per part. Keys of few rows,
    nearly all, are not repeated. With ``tasks`` the rows are joined in that many tasks, in parts a quarter as large that
    are left as ``_salt``: groups by key, part and more columns then need no shuffle after the join.
    """
    rows = JOIN_ROWS // 4 if tasks else JOIN_ROWS
    parts = big.groupBy(key).agg(F.ceil(F.count("*") / rows).cast("int").alias("_parts"))
    salted = big.join(parts, key).withColumn("_salt", F.pmod(F.xxhash64(spread_by), "_parts").cast("int")).drop("_parts")
    repeated = small.join(parts, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    if tasks:
        return salted.repartition(tasks, key, "_salt").join(repeated, [key, "_salt"])
    return salted.join(repeated, [key, "_salt"]).drop("_salt")


def search_pool(limit: int, offset: int = 0) -> int:
    """Candidates scored per query."""
    return max(1500, offset + limit + 200, 6 * (offset + limit))


def feed_pool(limit: int, offset: int = 0) -> int:
    """Candidates gathered per customer and source for a feed."""
    return max(180, offset + limit + 60, 4 * (offset + limit))


def rank_results(scored: DataFrame, key: str | list[str] = "query_id") -> DataFrame:
    """Positive scores ranked per key: score, then title, then id.

    The groups are pools already cut by ``search_pool`` or ``feed_pool``.
    """
    window = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(F.desc("score"), "title_raw", "ste_id")
    return scored.filter("score > 0").withColumn("rank", F.row_number().over(window))


def page(ranked: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return ranked.filter(F.col("rank").between(offset + 1, offset + limit))


def rank_shift(before: DataFrame, after: DataFrame, key: str = "query_id", owner: str = "query_id") -> DataFrame:
    """Where each result of ``after`` stood in ``before``; null if it is new.

    ``key`` may be one that several owners of ``after`` share in ``before``.
    """
    old = before.select(key, "ste_id", F.col("rank").alias("before"))
    return (
        after.select(*{owner: 0, key: 0}, "ste_id", F.col("rank").alias("after"))
        .join(old, [key, "ste_id"], "left")
        .withColumn("delta", F.col("before") - F.col("after"))
    )
