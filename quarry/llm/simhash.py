"""SimHash near-duplicates found at the anchors of a covering code."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.graph import components
from quarry.llm.text import LOWER, utf8
from quarry.session import materialize

#: Words of a shingle, bits in which linked fingerprints may differ, seed of XXH64.
SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Fixed values of the binary Golay code: length, covering radius, generator polynomial.
LENGTH, RADIUS, GENERATOR = 23, 3, 0xC75
#: Shingles counted at a time.
_BLOCK = 1 << 16
#: Fingerprints that one task takes to their anchors.
DEALT = 20_000


def fingerprint(text: bytes) -> int:
    """64 bits, each set if more than half of the shingles' hashes have it set; 0 without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    line, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes).tolist(), ends[SHINGLE - 1 :].tolist() or [len(line)]
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(ends)
    for at in range(0, n, _BLOCK):
        block = [digest(line[a:b], SEED) for a, b in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK])]
        bits = np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        raw = data.tobytes()
        found = [fingerprint(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        bits = np.array(found, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "bits": bits})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, bits) of each row of ``docs`` (doc_id, text); the 64 bits as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, bits long")


@functools.cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome the error patterns of weight up to RADIUS + 2, as (start, pattern, cost, syndrome of each bit).

    A word minus one of its patterns is a code word, its cost the bits by which the distance to that
    code word exceeds the covering radius. The code is perfect: one pattern of each costs nothing.
    """
    def remainder(word: int) -> int:
        for bit in range(LENGTH - 1, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    single = np.array([remainder(1 << bit) for bit in range(LENGTH)], np.int64)
    patterns, syndromes, weights = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    last = [np.full(1, -1, np.int64)]
    for weight in range(1, RADIUS + 3):
        p, s, l = patterns[-1], syndromes[-1], last[-1]
        grown = [(p[l < bit] | 1 << bit, s[l < bit] ^ single[bit], np.full((l < bit).sum(), bit)) for bit in range(LENGTH)]
        patterns.append(np.concatenate([g[0] for g in grown]))
        syndromes.append(np.concatenate([g[1] for g in grown]))
        last.append(np.concatenate([g[2] for g in grown]))
        weights.append(np.full(len(patterns[-1]), weight))
    pattern, syndrome, weight = map(np.concatenate, (patterns, syndromes, weights))
    order = np.lexsort((weight, syndrome))
    starts = np.searchsorted(syndrome[order], np.arange(2049))
    return starts, pattern[order], np.maximum(0, weight[order] - RADIUS), single


def anchors(bits: np.ndarray, budget: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, anchor, cost): the anchors that each fingerprint goes to.

    Anchors are pairs of Golay code words, over bits 0-22 and 23-45. Take fingerprints x, y that
    differ in at most 3 bits, and a word z with one bit between x and z, two between z and y. Each half
    of z lies within the covering radius 3 of one code word; so x meets that anchor with at most 1
    bit above the radius, y with at most 2. Every word goes to all anchors within the radius plus 2.
    """
    starts, pattern, cost, single = _golay()
    halves = []
    for shift in (0, LENGTH):
        word = (bits >> np.uint64(shift)).astype(np.int64) & ((1 << LENGTH) - 1)
        syndrome = np.zeros(len(word), np.int64)
        for bit in range(LENGTH):
            syndrome ^= (word >> bit & 1) * single[bit]
        first, many = starts[syndrome], starts[syndrome + 1] - starts[syndrome]
        rows = np.repeat(np.arange(len(word)), many)
        inner = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
        entry = first[rows] + inner
        halves.append((rows, word[rows] ^ pattern[entry], cost[entry], many))
    (rows, low, low_cost, _), (_, high, high_cost, many) = halves
    begin = np.cumsum(many) - many
    times = many[rows]
    left = np.repeat(np.arange(len(rows)), times)
    right = begin[rows[left]] + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
    total = low_cost[left] + high_cost[right]
    keep = total <= budget
    left, right = left[keep], right[keep]
    return rows[left], low[left] | high[right] << LENGTH, total[keep]


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = batch.column("bits").to_numpy()
        for at in range(0, len(bits), 2048):
            part = bits[at : at + 2048]
            index, anchor, cost = anchors(part.view(np.uint64))
            yield pa.RecordBatch.from_pydict({"anchor": anchor, "bits": part[index], "near": cost <= 1})


def _apart(x: np.ndarray, y: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def _forest(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked within one anchor's fingerprints, found from seed to seed."""
    left, right, rest = [], [], bits
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue:
            seed = queue.pop()
            close = _apart(rest, seed) <= DISTANCE
            if close.any():
                found = rest[close]
                left.append(np.full(len(found), seed))
                right.append(found)
                queue.extend(found)
                rest = rest[~close]
    return (np.concatenate(left), np.concatenate(right)) if left else (bits[:0], bits[:0])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each anchor; rows come sorted by anchor.

    Rows of one anchor are compared at growing offsets, all anchors together. An anchor with more
    than four links per row holds copies; its links are thinned to a spanning forest, so that a
    group of m copies gives m - 1 links and not all pairs.
    """
    carried: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def linked(anchor, bits, near):
        edges = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        sizes = np.diff(np.append(edges, len(anchor)))
        group = np.repeat(np.arange(len(edges)), sizes)
        end = np.repeat(edges + sizes, sizes)
        found, dense = np.zeros(len(edges), np.int64), np.zeros(len(edges), bool)
        rows, step = np.flatnonzero(end - np.arange(len(anchor)) > 1), 1
        left, right, where = [], [], []
        while len(rows):
            other = rows + step
            close = (near[rows] | near[other]) & (_apart(bits[rows], bits[other]) <= DISTANCE)
            a, b = rows[close], other[close]
            np.add.at(found, group[a], 1)
            left.append(bits[a]), right.append(bits[b]), where.append(group[a])
            step += 1
            dense |= found > 4 * sizes
            rows = rows[(rows + step < end[rows]) & ~dense[group[rows]]]
        if left:
            a, b, g = map(np.concatenate, (left, right, where))
            yield a[~dense[g]], b[~dense[g]]
        for g in np.flatnonzero(dense):
            yield _forest(bits[edges[g] : edges[g] + sizes[g]])

    def emitted(last: bool):
        anchor, bits, near = (np.concatenate(x) for x in zip(*carried, strict=True))
        cut = len(anchor) if last else int(np.searchsorted(anchor, anchor[-1]))
        carried[:] = [(anchor[cut:], bits[cut:], near[cut:])]
        for a, b in linked(anchor[:cut], bits[:cut], near[:cut]) if cut else ():
            a, b = a.view(np.int64), b.view(np.int64)
            yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    held = 0
    for batch in batches:
        if batch.num_rows:
            carried.append((batch.column("anchor").to_numpy(), batch.column("bits").to_numpy().view(np.uint64), batch.column("near").to_numpy(zero_copy_only=False)))
            held += batch.num_rows
            if held > 1 << 19:
                yield from emitted(False)
                held = len(carried[0][0])
    if carried:
        yield from emitted(True)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that join all fingerprints differing in 3 bits or fewer; ``distinct`` has bits, without repeats."""
    # Each row becomes dozens, so rows are dealt by their number, not by their few bytes.
    dealt = distinct.select("bits").repartition(max(1, math.ceil(distinct.count() / DEALT)))
    spread = dealt.mapInArrow(_replicate, "anchor long, bits long, near boolean")
    at_anchor = spread.repartition("anchor").sortWithinPartitions("anchor")
    return at_anchor.mapInArrow(_compare, "a long, b long").distinct()


def hex_digits(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    ``docs`` has doc_id (an integer) and text. Equal fingerprints, as of copies and of all texts
    without words (null, empty, blank: fingerprint zero), meet once as one row before anything is
    replicated. Rows with a null id keep their fingerprint and count for links, and take the
    component's id, or null where no row has one. Repeated rows stay. Other columns are not read.
    """
    found = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(found.groupBy("bits").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = materialize(components(fingerprint_links(distinct)).withColumnRenamed("node", "bits"), "fingerprint-roots")
    first = (
        roots.join(distinct, "bits").groupBy("root").agg(F.min("first").alias("least"))
        .join(roots, "root").select("bits", "least")
    )
    ids = materialize(
        distinct.join(first, "bits", "left").select("bits", F.coalesce("least", "first").alias("component_id")), "component-ids"
    )
    return found.join(ids, "bits").select("doc_id", hex_digits(F.col("bits")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that come first by doc_id in their component; one of each id.

    Rows without an id cannot be told apart and stay.
    """
    first = near_duplicates(docs).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.filter("doc_id IS NULL").unionByName(docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
