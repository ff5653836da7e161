"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.text import WORD
from quarry.session import materialize

#: Rows that one task pairs up, and partial results that one step of the reduction tree joins.
BUCKET_ROWS, FAN_IN = 20_000, 64
_NEARLY = 1e-9


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target): the weighted shares, none above ``most`` times its source.

    Sources are ordered by code point, null last, and take the weights in turn. Filling stops at the
    level that uses up the total: sources that fill up early are those with the least room per weight.
    One row per source goes through one task, never rows of documents.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights))
    ranked = sums.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("room"))
    order = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    filled = ranked.withColumns({
        "step": F.row_number().over(order),
        "full": F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "all": F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * float(share),
    }).withColumn("level", (F.col("all") - F.col("full")) / F.col("open"))
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stops = F.when(F.col("level") * F.col("weight") <= F.col("room"), F.struct("step", "level"))
    level = F.min(stops).over(whole)["level"]
    return filled.select(
        "source", "source_size",
        F.when(F.col("source_size") == 0, F.lit(0.0))
        .otherwise(F.least("room", F.coalesce(level * F.col("weight"), F.col("room")))).alias("target"),
    )


def _pair_up(sizes: np.ndarray, parts: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Pivotal rounding of the fractions of one source, largest documents first.

    Two fractional documents exchange words until one of them is taken whole or not at all; the
    direction is drawn so that each document's expected fraction stays as it was, and the sum of
    words stays exactly the same. At most one fraction is left.
    """
    out, draws, held = parts.copy(), random.random(len(parts)), -1
    for j in range(len(parts)):
        if held < 0:
            held = j
            continue
        i = held
        p, q, s, t = out[i], out[j], sizes[i], sizes[j]
        up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
        move = up if draws[j] * (up + down) < down else -down
        p, q = p + move / s, q - move / t
        p, q = (round(x) if min(x, 1 - x) < _NEARLY else x for x in (p, q))
        out[i], out[j] = p, q
        held = i if 0 < p < 1 else j if 0 < q < 1 else -1
    return out


def _round_group(seed: int, level: int):
    def rounded(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "deal"], ascending=[False, True], kind="stable")
        part = frame["part"].to_numpy(copy=True)
        sizes = frame["size"].to_numpy(np.float64)
        codes = frame["group"].to_numpy()
        bucket = int(frame["bucket"].iloc[0])
        for code in np.unique(codes):
            rows = np.flatnonzero((codes == code) & (part > 0) & (part < 1))
            if len(rows) > 1:
                random = np.random.default_rng([seed, level, bucket, int(code) & 0x7FFFFFFFFFFFFFFF])
                part[rows] = _pair_up(sizes[rows], part[rows], random)
        return frame.assign(part=part)

    return rounded


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0,
) -> DataFrame:
    """Copies of every document, so that each source's words meet its target.

    Takes (doc_id, text, source); returns doc_id, key, size, source_size, target, copies, taken, where
    ``key`` is a hash of doc_id and text. A
    document's expected copies are target / source_size. The whole part is given to all; the
    fractions are rounded by pairs inside buckets of about ``BUCKET_ROWS`` rows dealt by id and text, each
    bucket leaves at most one fraction per source, and a reduction tree joins ``FAN_IN`` buckets at a
    time until one is left, which goes to the nearer end. A source's words differ from its target by
    at most half of that one document. No random state depends on time or partitioning.

    Null or empty texts, null ids and null sources are rows as any other (size 0: nothing taken). Equal rows are
    rounded separately; so are different texts under one id. An empty table gives an empty result. Other columns are not read.
    """
    typed = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("key"),
    )
    # Equal rows are counted, and numbered where they are dealt out again, so that many of them share no bucket.
    folded = typed.groupBy(*typed.columns).agg(F.count("*").alias("n"))
    numbered = folded.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
    sized = materialize(numbered.withColumn("deal", F.xxhash64("key", "number", F.lit(seed))).drop("number"), "mix-sizes")
    targets = source_targets(sized, weights, share, most)
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.col("wanted") + _NEARLY)
    part = F.greatest(F.lit(0.0), F.col("wanted") - whole)
    rows = (
        sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("doc_id", "key", "size", "deal", "source_size", "target", wanted.alias("wanted"),
                F.xxhash64(F.col("d.source"), F.lit(1)).alias("group"))
        .withColumn("whole", whole.cast("long"))
        .withColumn("part", F.when((F.col("size") == 0) | (part < _NEARLY), 0.0).otherwise(part))
        .drop("wanted")
    )
    buckets = max(1, math.ceil(sized.count() / BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.col("deal"), F.lit(buckets)))
    level, done = 0, []
    while True:
        rounded = rows.groupBy("bucket").applyInPandas(_round_group(seed, level), rows.schema)
        if buckets == 1:
            done.append(rounded)
            break
        rounded = materialize(rounded, "mix-level")
        left = (F.col("part") > 0) & (F.col("part") < 1)
        done.append(rounded.filter(~left))
        buckets, level = math.ceil(buckets / FAN_IN), level + 1
        rows = rounded.filter(left).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("whole") + F.round("part").cast("long")
    return out.select("doc_id", "key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``docs`` with each row as often as ``mix`` says; rows of equal id and text take their copies together.

    Of rows that differ in other columns only, that of the smallest hash stands for all. All columns are kept.
    """
    copies = mixed.groupBy("key").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.struct("*").alias("row"))
    once = rows.groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).join(copies, "key")
    return once.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
