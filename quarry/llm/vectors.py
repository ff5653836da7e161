"""Blocks of vectors, and the search of a stated query set against all of them."""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """(vec_id, v): double vectors without null or non-finite components, all of the commonest length."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select("vec_id", v.alias("v")).filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull() & ~bad)
    if nonzero:
        kept = kept.filter(F.exists("v", lambda x: x != 0))
    length = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return kept.filter(F.size("v") == (length["n"] if length else 0)).filter(F.size("v") > 0)


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return {name: found[name] for name in found.files}


def blocks(vectors: DataFrame, rows: int, name: str, build: Callable[[np.ndarray, np.ndarray], bytes]) -> tuple[DataFrame, int]:
    """(``name``, data): the vectors dealt by id into blocks of about ``rows``, each packed by ``build``."""
    count = max(1, math.ceil(vectors.count() / rows))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        data = build(frame["vec_id"].to_numpy(np.int64), np.stack(frame["v"].to_numpy()))
        return pd.DataFrame({name: [int(frame[name].iloc[0])], "data": [data]})

    dealt = vectors.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(count)))
    return dealt.groupBy(name).applyInPandas(packed, f"{name} long, data binary"), count


def search(
    vectors: DataFrame, is_query: Column, k: int, rows: tuple[int, int], score_type: str,
    build: Callable[[np.ndarray, np.ndarray], bytes],
    build_queries: Callable[[np.ndarray, np.ndarray], bytes],
    best: Callable[[dict, dict, int], Iterator[tuple[int, np.ndarray, np.ndarray]]],
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k best rows, ties to smaller ids.

    Every group of queries meets every block of vectors once, by an equality join on the block; each
    meeting returns at most k rows for a query, and a ranking by query keeps the best.
    ``best(queries, block, k)`` gives (query id, ids, scores) for each query of a group.
    """
    vectors = materialize(vectors, "vectors")
    index, count = blocks(vectors, rows[1], "block", build)
    groups, _ = blocks(vectors.filter(is_query), rows[0], "query_group", build_queries)
    index = materialize(index, "vector-blocks")
    asked = groups.withColumnRenamed("data", "asked").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>")))

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for asked, data in zip(frame["asked"], frame["data"], strict=True):
                found = list(best(unpack(asked), unpack(data), k))
                yield pd.DataFrame({
                    "query_id": np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]).astype(np.int64),
                    "vec_id": np.concatenate([i for _, i, _ in found]), "score": np.concatenate([s for _, _, s in found]),
                })

    # Packed rows are far larger than Spark judges them by their compressed files, so neither side is ever sent to the driver.
    pairs = asked.join(index.hint("merge"), "block").select("asked", "data")
    met = pairs.mapInPandas(meet, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, best first."""
    if len(ids) > k:
        worst = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= worst)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -scores[near]))][:k]
