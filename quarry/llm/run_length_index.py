"""Long repeated passages, found by run-length Burrows-Wheeler indexes of texts that share an anchor."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.text import PIECE, powers, prefix_hash, range_hash, utf8
from quarry.session import materialize

#: Bytes of a passage that must not start twice; bytes of an anchor.
LENGTH, ANCHOR = 400, 32
#: Text bytes meant for one index, and different segments of one anchor that are kept
#: together (of about 600 bytes each), window hashes of split anchors that one task compares.
INDEX_BYTES, TOGETHER, SHARD_WINDOWS = 1_500_000, 2_000, 2_000_000
#: Join keys of one passage.
SALTS = 8
#: Bases of the anchors' and the texts' polynomial hashes.
_ANCHOR_BASE, _TEXT_BASE = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
_PLACE = np.uint64((1 << 21) - 1)


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from the minima of blocks read forwards and backwards."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, hash, start, windows): runs of windows of LENGTH bytes that have the same anchor.

    A window's anchor is its string of ANCHOR bytes with the least hash, the leftmost of equal ones. It
    depends on the window's bytes alone, so equal windows have equal anchors at the same place in them.
    """
    hashed = prefix_hash(data, _ANCHOR_BASE)
    at = np.arange(len(data) - ANCHOR + 1)
    value = range_hash(hashed, at, at + ANCHOR, _ANCHOR_BASE)
    place = (_least(value & ~_PLACE | at.astype(np.uint64), LENGTH - ANCHOR + 1) & _PLACE).astype(np.int64)
    start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    windows = np.diff(np.append(start, len(place)))
    content = range_hash(prefix_hash(data, _TEXT_BASE), start, start + windows + LENGTH - 1, _TEXT_BASE)
    return value[place[start]], content, start, windows


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        keys = batch.column("key").to_numpy()
        held: list[tuple] = []
        size = 0
        for key, a, b in zip(keys, offsets[:-1], offsets[1:], strict=True):
            for first in range(a, max(a, b - LENGTH + 1), PIECE):
                anchor, content, start, windows = segments(data[first : min(b, first + PIECE + LENGTH - 1)])
                held.append((anchor, content, np.full(len(start), key), start + (first - a), windows))
                size += len(start)
            if size > 100_000:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)


def _batch(held: list[tuple]) -> pa.RecordBatch:
    anchor, content, key, start, windows = map(np.concatenate, zip(*held, strict=True))
    return pa.RecordBatch.from_pydict({
        "anchor": anchor.view(np.int64), "content": content.view(np.int64), "key": key,
        "start": start.astype(np.int64), "windows": windows.astype(np.int32),
    })


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of several texts, with the suffixes at its run ends.

    Suffixes end with their text. Ranks of 7 bytes are refined to three times the length per sort, until
    no rank changes or the longest text is passed. Kept are the runs' first and last suffixes and, for
    those, the length of what they share with the suffix before or after, if it is LENGTH or more.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        n = self.n = len(data)
        self.rest = np.repeat(self.starts[1:], sizes) - np.arange(n)
        order = self._order(data, int(sizes.max()))
        before = data[order - 1].astype(np.int16)
        before[np.isin(order, self.starts[:-1])] = -1  # nothing stands before a text: never a run
        change = (before[1:] != before[:-1]) | (before[1:] == -1)
        head, tail = np.append(True, change), np.append(change, True)
        self.runs = int(head.sum())
        hashed = prefix_hash(data, _TEXT_BASE)
        rows = np.flatnonzero(head[1:]) + 1
        self.heads = (order[rows], self._shared(hashed, order[rows], order[rows - 1]))
        rows = np.flatnonzero(tail[:-1])
        self.tails = (order[rows], self._shared(hashed, order[rows], order[rows + 1]))
        self.first, self.last = order[0], order[-1]

    def _order(self, data: np.ndarray, longest: int) -> np.ndarray:
        n = len(data)
        key, padded = np.zeros(n, np.uint64), np.append(data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64))
        # Seven bytes in a base of 257, which 64 bits hold; a text's end counts as 0.
        for k in range(7):
            key = key * np.uint64(257) + np.where(self.rest > k, padded[k : k + n], 0)
        length, at = 7, np.arange(n)
        bits = int(n).bit_length() + 1
        times = 3 if 3 * bits <= 63 else 2
        while True:
            order = np.argsort(key)
            sorted_key = key[order]
            ranks = np.empty(n, np.int64)
            ranks[order] = np.cumsum(np.append(True, sorted_key[1:] != sorted_key[:-1]))
            if int(ranks[order[-1]]) == n:
                return order
            if length >= longest:
                return np.argsort(ranks << bits | at)  # what is equal to its end stands in the order of the text
            key = ranks.copy()
            for k in range(1, times):
                ahead = self.rest > k * length
                key = (key << bits) | np.where(ahead, ranks[np.minimum(at + k * length, n - 1)], 0)
            length *= times

    def _shared(self, hashed: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b share, where they are LENGTH or more; else 0."""
        back = powers(pow(_TEXT_BASE, -1, 1 << 64), len(hashed))

        def equal(x, y, length):
            return (hashed[x + length] - hashed[x]) * back[x] == (hashed[y + length] - hashed[y]) * back[y]

        out, most = np.zeros(len(a), np.int64), np.minimum(self.rest[a], self.rest[b])
        some = np.flatnonzero(most >= LENGTH)
        some = some[equal(a[some], b[some], LENGTH)]
        low, high, x, y = np.full(len(some), LENGTH), most[some], a[some], b[some]
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = equal(x, y, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        out[some] = low
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match with another one, if LENGTH or more.

        Read along the text: within a run, the length shared with the neighbouring suffix is one less
        than at the position before, so the samples at run ends give all others.
        """
        out = np.zeros(self.n, np.int64)
        for (sampled, shared), alone in ((self.heads, self.first), (self.tails, self.last)):
            known = np.zeros(self.n, bool)
            value = np.zeros(self.n, np.int64)
            known[sampled], value[sampled] = True, shared
            known[alone] = True
            latest = np.maximum.accumulate(np.where(known, np.arange(self.n), 0))
            out = np.maximum(out, value[latest] - (np.arange(self.n) - latest))
        return out


def _runs(key: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Spans (key, start, end) of bytes under windows, given in the order of key and start."""
    new = np.append(True, (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1 if len(key) else first
    return pd.DataFrame({"key": key[first], "start": start[first], "end": start[last] + LENGTH})


def _listed(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number in the row) of each window."""
    of = np.repeat(np.arange(len(windows)), windows)
    return of, np.arange(len(of)) - (np.cumsum(windows) - windows)[of]


def _again(values: np.ndarray, of: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the windows in each row whose value occurs more than once; rows without are left out."""
    order = np.argsort(values)
    same = values[order][1:] == values[order][:-1]
    hits = np.sort(order[np.append(same, False) | np.append(False, same)]) if len(values) else order
    row, first = np.unique(of[hits], return_index=True)
    last = np.append(first[1:], len(hits)) - 1 if len(row) else first
    return row, offset[hits[first]], offset[hits[last]]


def _repeated(texts: list[bytes], key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, start) of the windows that occur again in an index of the texts, by key and start."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = RunLengthIndex(texts)
    of, offset = _listed(np.diff(index.starts) - LENGTH + 1)
    hit = index.matching_statistics()[index.starts[:-1][of] + offset] >= LENGTH
    return key[of[hit]], (start[of] + offset)[hit]


def _marked(shards: int):
    def marked(frame: pd.DataFrame) -> pd.DataFrame:
        """Spans of repeated windows in the bucket's segments. Of split anchors also a hash of each different
        window, packed in a row for each of ``shards`` shards of hashes."""
        frame = frame.sort_values(["anchor", "key", "start"], kind="stable")
        texts, (windows, key, start) = list(frame["bytes"]), (frame[c].to_numpy() for c in ("windows", "key", "start"))
        data = np.frombuffer(b"".join(texts), np.uint8)
        begins = np.cumsum([0, *map(len, texts)])[:-1]
        of, offset = _listed(windows)
        in_text, place, owner = begins[of] + offset, start[of] + offset, key[of]
        values = range_hash(prefix_hash(data, _TEXT_BASE), in_text, in_text + LENGTH, _TEXT_BASE)
        # Only stretches that begin and end with a window of which the hash occurs again go to the index.
        row, low, high = _again(values, of, offset)
        spans = _runs(*_repeated([texts[r][x : y + LENGTH] for r, x, y in zip(row.tolist(), low.tolist(), high.tolist(), strict=True)], key[row], start[row] + low))
        # Spans have the shard -1, so that no integer column holds a null, which pandas would round.
        spans = spans.assign(shard=-1, windows=b"", keys=b"", places=b"")
        split = np.flatnonzero(frame["split"].to_numpy(bool)[of])
        if len(split):
            value, first = np.unique(values[split], return_index=True)
            shard = (value % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            mine = [order[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            packed = pd.DataFrame({
                "key": 0, "start": 0, "end": 0, "shard": np.arange(shards), "windows": [value[m].tobytes() for m in mine],
                "keys": [owner[split[first[m]]].tobytes() for m in mine], "places": [place[split[first[m]]].tobytes() for m in mine],
            })
            spans = pd.concat([spans, packed], ignore_index=True)
        return spans

    return marked


def _across(frame: pd.DataFrame) -> pd.DataFrame:
    """Spans of the windows that several buckets of split anchors hold."""
    value, key, place = (np.concatenate([np.frombuffer(x, t) for x in frame[c]]) for c, t in (("windows", np.uint64), ("keys", np.int64), ("places", np.int64)))
    _, inverse, counts = np.unique(value, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    again = again[np.lexsort((place[again], key[again]))]
    return _runs(key[again], place[again])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each segment of a row's text."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        raw = data.tobytes()
        lists = batch.column("open")
        counts = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
        inner = lists.flatten()
        of = np.repeat(np.arange(len(counts)), counts)
        start, windows = inner.field("start").to_numpy(), inner.field("windows").to_numpy()
        a = offsets[of] + start
        rows = {name: inner.field(name) for name in ("anchor", "split", "bucket", "start", "windows")}
        cut = [raw[x:y] for x, y in zip(a.tolist(), (a + windows + LENGTH - 1).tolist(), strict=True)]
        rows |= {"key": batch.column("key").to_numpy()[of], "bytes": pa.array(cut, pa.binary())}
        yield pa.RecordBatch.from_pydict(rows)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, spans): for rows that hold repeated passages, the spans (start, end) of bytes, which may overlap.

    ``docs`` has doc_id and text; ``key`` is ``row_key()``. Only what can be repeated is indexed: segments
    with equal bytes are marked by their hashes; others go to an index if their anchor has several
    different ones. An index holds whole anchors; an anchor with more than TOGETHER different segments is
    dealt over several, whose different windows are then compared by their hashes across all.
    """
    found = materialize(
        docs.select(row_key().alias("key"), "text").mapInArrow(_segments, "anchor long, content long, key long, start long, windows int"), "segments"
    )
    contents = found.groupBy("anchor", "content").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "start", "windows")).alias("first")
    )
    contents = materialize(contents, "segment-contents")
    several = contents.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1")
    # One passage may stand in most rows, so its segments are spread over SALTS join keys.
    copies = contents.filter("n > 1").select("anchor", "content", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("key", "start"), F.lit(SALTS)).cast("int"))
    spans = salted.join(copies, ["anchor", "content", "salt"], "left_semi").select(
        "key", "start", (F.col("start") + F.col("windows") + LENGTH - 1).alias("end")
    )
    opened = contents.join(several, "anchor").select("anchor", "m", "content", "first.*")
    split = F.col("m") > TOGETHER
    size, windows = opened.agg(
        F.coalesce(F.sum(F.col("windows") + LENGTH - 1), F.lit(0)), F.coalesce(F.sum(F.when(split, F.col("windows"))), F.lit(0))
    ).first()
    buckets, shards = max(1, math.ceil(size / INDEX_BYTES)), max(1, math.ceil(windows / SHARD_WINDOWS))
    dealt = F.when(split, F.xxhash64("anchor", "content")).otherwise(F.xxhash64("anchor"))
    by_row = opened.groupBy("key").agg(F.collect_list(F.struct(
        "anchor", split.alias("split"), F.pmod(dealt, F.lit(buckets)).alias("bucket"), "start", "windows",
    )).alias("open"))
    # Equal rows are one row here: each segment goes to its index once, however many copies its text has.
    texts = docs.select(row_key().alias("key"), "text").join(by_row, "key").dropDuplicates(["key"])
    cut = texts.mapInArrow(_cut, "anchor long, split boolean, bucket long, start long, windows int, key long, bytes binary")
    marked = materialize(
        cut.groupBy("bucket").applyInPandas(
            _marked(shards), "key long, start long, end long, shard long, windows binary, keys binary, places binary"
        ), "marked",
    )
    across = marked.filter("shard >= 0").groupBy("shard").applyInPandas(_across, "key long, start long, end long")
    spans = spans.unionByName(marked.filter("shard < 0").select("key", "start", "end")).unionByName(across)
    return spans.distinct().groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that the spans cover."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > reach[:-1])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        raw = data.tobytes()
        rows = batch.column("spans").to_pylist() if batch.column("spans").null_count < batch.num_rows else [None] * batch.num_rows
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for a, b, spans in zip(offsets[:-1].tolist(), offsets[1:].tolist(), rows, strict=True):
            text, removed, count = raw[a:b], 0, 0
            if spans:
                starts, ends = merged(*(np.array([s[c] for s in spans]) for c in ("start", "end")))
                cuts = zip([0, *ends.tolist()], [*starts.tolist(), len(text)], strict=True)
                text, removed, count = b"".join(text[x:y] for x, y in cuts), int((ends - starts).sum()), len(starts)
            for name, value in (("n_bytes", b - a), ("n_removed", removed), ("n_spans", count), ("kept_sha256", hashlib.sha256(text).hexdigest()), ("kept", text)):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array(v, pa.binary() if k == "kept" else None) for k, v in out.items()})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) of each row of ``docs``.

    Removed are all bytes covered by a string of LENGTH bytes that also starts anywhere else, in any row
    or the same one. Null texts are empty; texts shorter than LENGTH are kept; equal rows lose all such
    bytes and repeat; null ids stay; other columns are not read. The kept bytes need not be valid UTF-8.
    """
    spans = repeated_spans(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", row_key().alias("key")).join(spans, "key", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_removed, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
