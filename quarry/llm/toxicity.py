"""Toxicity by compression distance: windows of a text under a toxic and an ordinary zstandard dictionary."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.text import LOWER, fold, mixed, utf8

#: The bounded sample of labelled rows that the classifier is fitted on: rows of each label, characters of a row
#: at most, stretches that they are taken from if the row is longer.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_PARTS = 3_000, 16_384, 16
#: Bytes of a window and of a step; every window is followed by so many zero bytes, which always compress,
#: so that no window is stored uncompressed and each matched byte counts.
WINDOW, STEP, PADDING = 48, 32, b"\0" * 32
#: Bytes of the strings that decide what goes into a dictionary, of their contexts, of a dictionary at most.
STRING, CONTEXT, DICTIONARY = 6, 6, 2048
#: A string belongs to a label if it has been met in so many contexts, at so many times the other label's
#: rate, and at so large a part of the most frequent such string's rate.
CONTEXTS, RATIO, PART = 15, 15.0, 0.05


def normal(text: bytes) -> bytes:
    return b" " + text.translate(LOWER) + b" "


def _strings(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = len(data) - STRING + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(STRING if n > 0 else 0):
        out = out << np.uint64(8) | data[k : k + n]
    return out


def _contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Strings, and in how many different contexts each was met; copies of a text add none."""
    found = []
    for text in texts:
        x = _strings(text)
        if len(x) > 2 * CONTEXT:
            core = x[CONTEXT:-CONTEXT]
            around = mixed(core * np.uint64(3) ^ mixed(x[: len(core)]) ^ x[2 * CONTEXT :] * np.uint64(7))
            found.append(np.stack([core, around]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    both = np.concatenate(found, axis=1)
    both = both[:, np.lexsort((both[1], both[0]))]
    both = both[:, np.append(True, (both[:, 1:] != both[:, :-1]).any(axis=0))]
    return np.unique(both[0], return_counts=True)


def train_dictionary(own: list[bytes], other: list[bytes]) -> bytes:
    """Dictionary content for one label: segments covering the strings that are its own.

    Segments are runs of such strings; one after another, the run with the largest rate of strings not
    covered yet is taken. The most useful ones come last, nearest to the data.
    """
    keys, counts = _contexts(own)
    others, other_counts = _contexts(other)
    if not len(keys):
        return PADDING
    rate, other_rate = (max(1, sum(map(len, x))) for x in (own, other))
    against = np.zeros(len(keys), np.int64)
    if len(others):
        at = np.minimum(np.searchsorted(others, keys), len(others) - 1)
        against = np.where(others[at] == keys, other_counts[at], 0)
    typical = (counts >= CONTEXTS) & (counts / rate > RATIO * (against + 1) / other_rate)
    keys, weight = keys[typical], (counts / rate - (against + 1) / other_rate)[typical]
    if not len(keys):
        return PADDING
    keys, weight = keys[weight >= PART * weight.max()], weight[weight >= PART * weight.max()]
    known, runs = dict(zip(keys.tolist(), weight.tolist(), strict=True)), Counter()
    for text in own:
        x = _strings(text)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (keys[at] == x).astype(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            strong = np.flatnonzero(weight[at[a:b]] >= weight[at[a:b]].max() / 3)
            runs[text[a + strong[0] : a + strong[-1] + STRING]] += 1
    covered: set[int] = set()

    def gain(run: bytes) -> float:
        return sum(known.get(x, 0.0) for x in set(_strings(run).tolist()) - covered)

    heap = [(-gain(run), run) for run, times in runs.items() if times >= 5]
    heapq.heapify(heap)
    chosen, size = [], 0
    while heap and size < DICTIONARY:
        _, run = heapq.heappop(heap)
        now = -gain(run)
        if now < 0 and heap and now > heap[0][0]:
            heapq.heappush(heap, (now, run))
        elif now < 0:
            chosen.append(run)
            size += len(run)
            covered.update(_strings(run).tolist())
    # A byte that texts don't hold keeps matches from running over into the next segment.
    return b"\x01".join([b"", *chosen[::-1], PADDING[:8]])


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        compression_params=zstandard.ZstdCompressionParameters(
            window_log=12, chain_log=10, hash_log=12, search_log=3, min_match=STRING, target_length=16,
            strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        ),
    )


def distances(text: bytes, toxic, ordinary) -> np.ndarray:
    """For each window, by how many bytes it is shorter under the toxic dictionary than under the ordinary one."""
    text = normal(text)
    by_toxic, by_ordinary = toxic.compress, ordinary.compress
    out = []
    for at in range(0, max(1, len(text) - (WINDOW - STEP)), STEP):
        window = text[at : at + WINDOW] + PADDING
        out.append(len(by_ordinary(window)) - len(by_toxic(window)))
    return np.array(out)


def features(found: np.ndarray) -> list[float]:
    """The largest distance, the sum of those above 1, and that sum by window (in logarithms, times ten)."""
    above = float(np.maximum(found - 1, 0).sum())
    return [float(max(0, found.max())), np.log1p(above), 10 * np.log1p(above / len(found))]


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]  # of the features, then the constant


def _calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (y - p) - 1e-2 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _fit(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["toxic", "deal"], kind="stable")
    texts = [t.encode() for t in frame["text"]]
    labels = frame["toxic"].to_numpy(np.float64)
    own = [normal(t) for t, y in zip(texts, labels, strict=True) if y]
    other = [normal(t) for t, y in zip(texts, labels, strict=True) if not y]
    toxic, ordinary = train_dictionary(own, other), train_dictionary(other, own)
    by_toxic, by_ordinary = compressor(toxic), compressor(ordinary)
    x = np.array([features(distances(t, by_toxic, by_ordinary)) for t in texts])
    weights = _calibrated(x, labels)
    # Rows of either label are drawn up to the same bound; the constant is set back to the labels' own shares.
    shares = frame.groupby("toxic")["share"].first()
    if len(shares) == 2:
        weights[-1] += np.log(shares[1] / shares[0]) - np.log(labels.sum() / (1 - labels).sum())
    return pd.DataFrame({"toxic": [toxic], "ordinary": [ordinary], "weights": [weights.tolist()]})


def _spread_out(text: str) -> Column:
    """A text, or of a longer one SAMPLE_CHARS characters from stretches at even distances."""
    size = SAMPLE_CHARS // SAMPLE_PARTS
    gap = (F.length(text) - size) / (SAMPLE_PARTS - 1)
    places = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_PARTS - 1)), lambda k: F.substr(F.col(text), F.floor(k * gap).cast("int") + 1, F.lit(size)))
    return F.when(F.length(text) <= SAMPLE_CHARS, F.col(text)).otherwise(F.array_join(places, " "))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits dictionaries and thresholds on texts of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1).

    The sample is bounded: of each label the ``SAMPLE_ROWS`` ids with the smallest hashes, of several texts
    under one id that of the smallest hash, of a text longer than ``SAMPLE_CHARS`` as many characters in
    ``SAMPLE_PARTS`` stretches spread over all of it. Missing texts give nothing. The sample's ids are
    broadcast, so no text is shuffled but the sample's. Without rows, nothing is toxic.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select(
        "doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("deal")
    )
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [known.filter(F.col("toxic") == y).orderBy("deal").limit(SAMPLE_ROWS) for y in (0, 1)]
    sample = parts[0].unionByName(parts[1]).withColumn(
        "share", F.when(F.col("toxic") == 1, float(totals.get(1, 0))).otherwise(float(totals.get(0, 0)))
    )
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(sample), "doc_id")
    drawn = texts.select("doc_id", "toxic", "share", "deal", F.xxhash64("text").alias("by_text"), _spread_out("text").alias("text"))
    rows = drawn.groupBy("doc_id", "toxic", "share", "deal").agg(F.min_by("text", "by_text").alias("text")).withColumn("fit", F.col("toxic") >= 0)
    found = rows.groupBy("fit").applyInPandas(_fit, "toxic binary, ordinary binary, weights array<double>").first()
    if found is None:
        return Model(PADDING, PADDING, (0.0, 0.0, 0.0, -10.0))
    return Model(bytes(found["toxic"]), bytes(found["ordinary"]), tuple(found["weights"]))


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: crc32 of the id modulo 5 is not 0."""
    return labels.filter(fold(F.col("doc_id")) != 0)


def _scores(batch: pa.RecordBatch, model: Model, toxic, ordinary) -> np.ndarray:
    data, offsets = utf8(batch.column("text"))
    raw = data.tobytes()
    x = [features(distances(raw[a:b], toxic, ordinary)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    z = np.array(x).reshape(-1, 3) @ np.array(model.weights[:3]) + model.weights[3]
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _score(model: Model):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, ordinary = compressor(model.toxic), compressor(model.ordinary)
        for batch in batches:
            out = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            yield pa.RecordBatch.from_pydict(out | {"score": _scores(batch, model, toxic, ordinary)})

    return scored


def ordinary(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below 0.5."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_toxic, by_ordinary = compressor(model.toxic), compressor(model.ordinary)
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch, model, by_toxic, by_ordinary) < 0.5))

    return docs.mapInArrow(kept, docs.schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text).

    Whole texts are cut into overlapping windows. Null and empty texts are one blank window: their score
    is the calibrated constant. A null id is not held out. Repeated rows repeat; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    scored = rows.mapInArrow(_score(model), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
