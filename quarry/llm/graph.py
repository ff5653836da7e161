"""Connected components of a table of links, as Spark joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import materialize


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root): every linked node with the smallest node it reaches. ``links`` has a, b (long).

    Alternates large-star and small-star steps until the links are stars around their roots. Minima
    are combined before the shuffle, and nodes with many links are joined back, which Spark splits
    where one of them is hot. Each step is written to the shared folder, so no lineage grows and a
    lost executor costs one step. Null ends and loops are dropped; an empty table gives none.
    """
    links = materialize(links.select("a", "b").filter("a <> b").distinct(), "links")
    before = None
    while (now := _state(links)) != before:
        before = now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        down = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        small = down.join(least, "a")
        small = small.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        links = materialize(small.unionByName(least.select("a", F.col("least").alias("b"))).distinct(), "links")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
