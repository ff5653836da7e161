"""Benchmark decontamination: documents scanned for word windows that a benchmark item holds too."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.llm.text import LOWER, pieces, powers, range_hash, span_hashes, utf8
from quarry.session import materialize

#: Words of a window; different windows that one broadcast set holds (of about 50 bytes each).
WINDOW, SLICE = 10, 500_000
_WORD_BASE, _WINDOW_BASE = 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F
_LOWER = np.frombuffer(LOWER, np.uint8)
#: Fixed value: the ASCII bytes of words, after lower-casing; all other bytes of words are above 127.
_INSIDE = np.array([b > 127 or chr(b).isdigit() or "a" <= chr(b) <= "z" for b in range(256)])


@dataclass(frozen=True)
class Words:
    """Words of several rows: lower-cased bytes, where words begin and end, and the first word of each row."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        low = _LOWER[data]
        inside = np.zeros(len(low) + 1, bool)
        inside[:-1] = _INSIDE[low]
        before = np.append(False, inside[:-1])
        before[offsets] = False
        after = np.append(inside[1:], False)
        after[offsets[1:] - 1] = False  # a row of no bytes ends where the row before it does
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return cls(low, start, end, np.searchsorted(start, offsets))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(self.data, self.start, self.end, _WORD_BASE)

    def digest(self, first: int, count: int) -> bytes:
        """SHA-256 of ``count`` words, joined by single spaces."""
        spans = zip(self.start[first : first + count].tolist(), self.end[first : first + count].tolist(), strict=True)
        return hashlib.sha256(b" ".join(self.data[a:b].tobytes() for a, b in spans)).digest()


class WindowHashes:
    """Hashes of the windows of the same words at any length."""

    def __init__(self, words: Words):
        hashes = words.hashes()
        self.prefix = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(_WINDOW_BASE, len(hashes)), out=self.prefix[1:])
        self.rest = np.repeat(words.rows[1:], np.diff(words.rows)) - np.arange(len(hashes))

    def at(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each window that lies in one row."""
        first = np.flatnonzero(self.rest >= length)
        return first, range_hash(self.prefix, first, first + length, _WINDOW_BASE)


def _item_windows(window: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for first, last in pieces(offsets):
                words = Words.of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                hashes, counts = WindowHashes(words), np.diff(words.rows)
                for length in np.unique(np.minimum(counts, window)):
                    if not length:
                        continue
                    at, value = hashes.at(int(length))
                    of = np.searchsorted(words.rows, at, side="right") - 1
                    mine = np.minimum(counts[of], window) == length  # shorter items only, but for the full length
                    at, value, of = at[mine], value[mine], of[mine]
                    for x in range(0, len(at), 10_000):
                        y = x + 10_000
                        yield pa.RecordBatch.from_pydict({
                            "item_id": batch.column("item_id").take(pa.array(of[x:y] + first)),
                            "hash": value[x:y].view(np.int64), "length": np.full(len(at[x:y]), length, np.int32),
                            "digest": pa.array([words.digest(i, int(length)) for i in at[x:y].tolist()], pa.binary()),
                        })

    return made


@dataclass(frozen=True)
class Windows:
    """Windows of a benchmark: listed(item_id, digest) and distinct(hash, length, digest), both without repeats."""

    listed: DataFrame
    distinct: DataFrame


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> Windows:
    """All windows of ``items`` (item_id, text); an item of fewer words, but not none, is one window."""
    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", "text").mapInArrow(
        _item_windows(window), f"item_id {kind}, hash long, length int, digest binary"
    )
    rows = materialize(rows.distinct(), "benchmark-windows")
    return Windows(rows.select("item_id", "digest"), materialize(rows.select("hash", "length", "digest").distinct(), "windows"))


class HashSet:
    """Sorted window hashes with the digests of their windows, behind a table of the hashes' first bits."""

    def __init__(self, hashes: np.ndarray, digests: np.ndarray, lengths: list[int]):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.digests, self.lengths = hashes[order], digests[order], lengths
        self.bits = min(24, max(10, 4 + len(hashes).bit_length()))
        self.first = np.zeros(1 << self.bits, bool)
        self.first[self.hashes >> np.uint64(64 - self.bits)] = True

    def hits(self, words: Words, hashes: WindowHashes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(first word, number of words, digest) of the windows in the set, each compared by its digest."""
        at, length, digest = [], [], []
        for n in self.lengths:
            first, value = hashes.at(n)
            maybe = np.flatnonzero(self.first[value >> np.uint64(64 - self.bits)])
            low, high = (np.searchsorted(self.hashes, value[maybe], side=s) for s in ("left", "right"))
            for k in np.flatnonzero(high > low).tolist():
                i = int(first[maybe[k]])
                mine = words.digest(i, n)
                if mine in {d.tobytes() for d in self.digests[low[k] : high[k]]}:
                    at.append(i), length.append(n), digest.append(mine)
        return np.array(at, np.int64), np.array(length, np.int64), digest


def hash_sets(windows: DataFrame, most: int = SLICE) -> Iterator[HashSet]:
    """The windows in sets of about ``most``, dealt by their hash: what is broadcast never grows with the benchmark."""
    slices = max(1, math.ceil(windows.count() / most))
    for k in range(slices):
        rows = windows.filter(F.pmod(F.xxhash64("hash"), F.lit(slices)) == k).toArrow()
        digests = np.frombuffer(b"".join(rows.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
        lengths = sorted(set(rows.column("length").to_pylist()))
        yield HashSet(rows.column("hash").to_numpy().astype(np.int64).view(np.uint64), digests, lengths)


def _scan(shared):
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: HashSet = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            n_words, spans = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            digests = [[] for _ in range(batch.num_rows)]
            for a, b in pieces(offsets):
                words = Words.of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n_words[a:b] = np.diff(words.rows)
                at, length, found = windows.hits(words, WindowHashes(words))
                of = np.searchsorted(words.rows, at, side="right") - 1
                for row in np.unique(of).tolist():
                    mine = np.flatnonzero(of == row)
                    start, end = _merged(at[mine], at[mine] + length[mine])
                    begin = int(words.rows[row])
                    spans[a + row] = [{"start": x - begin, "end": y - begin} for x, y in zip(start.tolist(), end.tolist(), strict=True)]
                    digests[a + row] = sorted({found[k] for k in mine.tolist()})
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "key": batch.column("key"), "n_words": n_words,
                "spans": pa.array(spans, pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32()}))),
                "windows": pa.array(digests, pa.list_(pa.binary())),
            })

    return scanned


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > reach[:-1])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def scan(docs: DataFrame, windows: DataFrame, most: int = SLICE) -> DataFrame:
    """(doc_id, key, n_words, spans, windows) of each row of ``docs``, written once.

    ``spans`` are word numbers (start, end) under windows, merged for each set of windows; ``windows`` are
    digests; ``key`` is a hash of the text. Each set of windows costs one more pass over the texts, whose
    hits alone are joined to the first pass.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    schema = f"doc_id {kind}, key long, n_words long, spans array<struct<start:int,end:int>>, windows array<binary>"
    passes = []
    for chosen in hash_sets(windows, most):
        shared = docs.sparkSession.sparkContext.broadcast(chosen)
        found = rows.mapInArrow(_scan(shared), schema)
        if passes:
            found = found.filter(F.size("windows") > 0).dropDuplicates(["doc_id", "key"])
        passes.append(materialize(found, "scanned"))
        shared.unpersist()
    if len(passes) == 1:
        return passes[0]
    more = reduce(DataFrame.unionByName, passes[1:]).groupBy("doc_id", "key").agg(
        F.flatten(F.collect_list("spans")).alias("more_spans"), F.flatten(F.collect_list("windows")).alias("more_windows")
    )
    a, b = passes[0].alias("a"), more.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")), "left")
    both = {c: F.when(F.col(f"more_{c}").isNull(), F.col(c)).otherwise(F.concat(c, f"more_{c}")).alias(c) for c in ("spans", "windows")}
    return materialize(joined.select("a.doc_id", "a.key", "n_words", both["spans"], F.array_sort(both["windows"]).alias("windows")), "scanned")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of ``docs`` (doc_id, text).

    ``benchmark`` has item_id and text. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing
    A-Z; a document word inside any occurrence of an item's window is hit. Windows meet by a 64-bit hash
    and are compared by SHA-256 of their words. Documents with the same windows share the work of listing
    their items. Null and empty texts have no words; rows of one id are told apart, equal rows repeat; an
    item under several rows counts once; items without id mark words, but are not counted or listed. Empty
    tables give no rows, or no hits. Other columns are not read.
    """
    windows = benchmark_windows(benchmark, window)
    found = scan(docs, windows.distinct)
    found = found.withColumn("contaminated", F.size("windows") > 0)
    numbered = F.sha2(F.array_join(F.transform("windows", lambda w: F.hex(w)), ""), 256)
    hit = found.filter("contaminated").select(
        "doc_id", "n_words", numbered.alias("set"), "windows",
        F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1))))).cast("long").alias("n_hit"),
    )
    sets = hit.select("set", "windows").dropDuplicates(["set"]).select("set", F.explode("windows").alias("digest"))
    pairs = sets.join(windows.listed.filter("item_id IS NOT NULL"), "digest").select("set", F.col("item_id").cast("string").alias("item")).distinct()
    items = pairs.groupBy("set").agg(F.array_sort(F.collect_list("item")).alias("items"))
    items = items.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    none = {"n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)}
    listed = hit.drop("windows").join(items, "set", "left").select(
        "doc_id", "n_words", "n_hit", *[F.coalesce(c, none[c]).alias(c) for c in none], F.lit(True).alias("contaminated")
    )
    clean = found.filter("NOT contaminated").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), *[none[c].alias(c) for c in none], "contaminated"
    )
    return clean.unionByName(listed)


@F.pandas_udf(StringType())
def _without(text: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, cuts in zip(text, spans, strict=True):
        raw = t.encode()
        data = np.frombuffer(raw, np.uint8)
        words = Words.of(data, np.array([0, len(data)]))
        start, end = _merged(*(np.array([c[k] for c in cuts]) for k in ("start", "end")))
        a, b = words.start[start].tolist(), words.end[end - 1].tolist()
        out.append(b"".join(raw[x:y] for x, y in zip([0, *b], [*a, len(raw)], strict=True)).decode())
    return pd.Series(out, dtype=object)


def decontaminate(docs: DataFrame, benchmark: DataFrame, spans: bool = False, window: int = WINDOW) -> DataFrame:
    """``docs`` without its contaminated rows, or with ``spans`` all rows without the marked words.

    A span goes from its first word's first byte to its last word's last; what stands around it stays.
    Rows are as in ``report``; all columns of ``docs`` are kept, whatever their names.
    """
    found = scan(docs, benchmark_windows(benchmark, window).distinct).filter(F.size("windows") > 0)
    found = found.dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias("id"), "key", "spans").alias("f")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key")).alias("d")
    same = F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.key") == F.col("f.key"))
    clean = rows.join(found, same, "left_anti").select("row.*")
    if not spans:
        return clean
    cut = rows.join(found, same).select("row", _without("row.text", "f.spans").alias("cut"))
    return clean.unionByName(cut.select(*[F.col("cut").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]))
