"""Approximate nearest neighbours by permutations of pivots."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import vectors as V

#: Pivots, nearest pivots kept of each vector, different vectors (about) that the pivots are chosen from.
PIVOTS, KEPT, SAMPLE = 128, 64, 2048
#: Share of a block, and rows of it at least, that are compared exactly after the ranking by footrule.
SHARE, LEAST = 0.15, 200
#: Recall that decides how far beyond this the ranking is followed, as mean over the checked queries and as
#: reached by SURE of them; queries of a group that are checked against a whole block.
MEAN, REACHED, SURE, CHECKED = 0.95, 0.9, 0.9, 48
#: Queries of a group, vectors of a block.
ROWS = (512, 8192)


def lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors of length one, by a further component, whose inner products with any query are in the order of the given ones'."""
    scaled = vectors / longest
    return np.column_stack([scaled, np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))])


def choose_pivots(vectors: DataFrame, count: int = PIVOTS) -> tuple[np.ndarray, float]:
    """Up to ``count`` lengthened vectors, each the farthest from those before, and the greatest length of all vectors."""
    longest = vectors.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)))).first()[0]
    # Copies have equal hashes and count once.
    hashed = vectors.withColumn("h", F.xxhash64("v"))
    different = hashed.select("h").distinct().count()
    if not different:
        return np.zeros((0, 0)), 1.0
    parts = 1 << 20
    taken = hashed.filter(F.pmod(F.xxhash64("h"), F.lit(parts)) < math.ceil(parts * min(1, SAMPLE / different)))
    rows = sorted((r["h"], r["v"]) for r in taken.groupBy("h").agg(F.min("v").alias("v")).collect())
    sample = lengthened(np.array([v for _, v in rows], np.float64), longest)
    chosen, closest = [0], sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(np.argmin(closest)))
        closest = np.maximum(closest, sample @ sample[chosen[-1]])
    return sample[chosen], longest


def permutations(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Each vector's KEPT nearest pivots, nearest first; equally near ones in the pivots' order."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :KEPT].astype(np.int16)


def _needed(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be among the k best of any query: of equal vectors, those of small ids.

    A query leaves out the rows of its own id, so k rows of each id count, and 2 k rows of all ids.
    """
    if len(ids) <= k:
        return np.arange(len(ids))
    # Adding zero makes -0.0 and 0.0 one.
    keys = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel()
    _, group = np.unique(keys, return_inverse=True)
    order = np.lexsort((ids, group))
    for columns, most in (((group, ids), k), ((group,), 2 * k)):
        new = np.zeros(len(order), bool)
        new[:1] = True
        for column in columns:
            new[1:] |= column[order][1:] != column[order][:-1]
        starts = np.flatnonzero(new)
        order = order[np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order)))) < most]
    return np.sort(order)


def _build(pivots: np.ndarray, longest: float, k: int, ids: np.ndarray, vectors: np.ndarray) -> bytes:
    """A block with the inverted file of each pivot: KEPT less its place with each row, 0 where it is not kept.

    A pivot is kept by KEPT / PIVOTS of all rows, half of them, so a byte per row is its shortest form.
    """
    needed = _needed(ids, vectors, k)
    ids, vectors = ids[needed], vectors[needed]
    order = permutations(lengthened(vectors, longest), pivots)
    files = np.zeros((len(pivots), len(ids)), np.uint8)
    np.put_along_axis(files, order.T.astype(np.int64), np.arange(order.shape[1], 0, -1, dtype=np.uint8)[:, None], axis=0)
    return V.pack(
        ids=ids, vectors=vectors.astype(np.float32) if (vectors.astype(np.float32) == vectors).all() else vectors, files=files,
    )


def _build_queries(pivots: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> bytes:
    # A query has no further component: its length changes no order.
    return V.pack(ids=ids, vectors=vectors, order=permutations(vectors, pivots[:, :-1]))


def _footrule(files: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The greater, the smaller each row's footrule distance from a query's permutation.

    Of the kept pivots, a missing one counts as place KEPT: the distance is a constant less twice this
    sum over the pivots that both keep of KEPT less the later place.
    """
    shared, least = np.zeros(files.shape[1], np.uint16), np.empty(files.shape[1], np.uint8)
    for place, pivot in enumerate(order):
        shared += np.minimum(files[pivot], np.uint8(len(order) - place), out=least)
    return shared.astype(np.int64)


def _depth(queries: dict, ids: np.ndarray, vectors: np.ndarray, files: np.ndarray, k: int) -> int:
    """Rows of the ranking to compare: as many as give the checked queries their recall within this block."""
    least = max(LEAST, math.ceil(SHARE * len(ids)))
    if least >= len(ids):
        return len(ids)
    places = []
    for i in np.unique(np.linspace(0, len(queries["ids"]) - 1, CHECKED).astype(int)):
        others = np.flatnonzero(ids != queries["ids"][i])
        best = others[V.top(ids[others], vectors[others] @ queries["vectors"][i], k)]
        ranked = V.top(ids, _footrule(files, queries["order"][i]), len(ids))
        place = np.empty(len(ids), np.int64)
        place[ranked] = np.arange(1, len(ids) + 1)
        places.append(np.sort(place[best]))
    found = np.array(places)
    if not found.size:
        return least
    each = np.sort(found[:, math.ceil(REACHED * found.shape[1]) - 1])
    mean = np.sort(found, axis=None)
    return max(least, int(each[math.ceil(SURE * len(each)) - 1]), int(mean[math.ceil(MEAN * len(mean)) - 1]))


def _best(queries: dict, block: dict, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    ids, vectors, files = block["ids"], block["vectors"].astype(np.float64), block["files"]
    most = _depth(queries, ids, vectors, files, k)
    for query, vector, order in zip(queries["ids"], queries["vectors"], queries["order"], strict=True):
        near = V.top(ids, _footrule(files, order), most) if len(ids) > most else np.arange(len(ids))
        near = near[ids[near] != query]
        scores = vectors[near] @ vector
        chosen = V.top(ids[near], scores, k)
        yield query, ids[near][chosen], scores[chosen]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each query.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id. Every vector is
    posted in the inverted files of its nearest pivots; a query ranks each block by footrule distance
    over them and compares the nearest rows of it exactly. How many is found for each group of queries
    and block: some queries of the group are compared with the whole block, and the ranking is followed
    to where their best rows of the block are found with a recall of 0.95 in the mean, and of 0.9 by
    nine of ten. Best rows of a block include its share of the best of all, so recall over all is no lower.
    Null ids, and vectors null, zero, with null or non-finite components, or not of the commonest
    length take no part; rows with the query's own id are no candidates; other repeated rows and
    equal vectors are separate candidates. An empty table gives none.
    """
    usable = V.usable(vectors, nonzero=True)
    pivots, longest = choose_pivots(usable)
    build, ask = functools.partial(_build, pivots, longest, k), functools.partial(_build_queries, pivots)
    return V.search(usable, is_query, k, ROWS, "double", build, ask, _best)
