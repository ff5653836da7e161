"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.text import mixed, pieces, utf8, word_hashes
from quarry.session import materialize, scratch_folder

#: Hashes that stand for the beginning and the end of a text.
BEGIN, END = np.uint64(0xB0), np.uint64(0xE0)
#: Bigrams that a task gathers before it passes them on; tokens and words that one shard is meant for.
GATHERED, SHARD_TOKENS, SHARD_WORDS = 1_000_000, 1_500_000, 1_000_000
#: Classes of words whose counts tell which contexts are frequent; text bytes scored at a time.
CLASSES, SCORED = 1 << 16, 1 << 21


def shared_path(spark) -> str:
    """The folder of ``spark.checkpoint.dir`` as a mounted path, which memory mapping needs."""
    place = urlparse(scratch_folder(spark))
    if place.scheme not in ("", "file"):
        raise ValueError("the model is memory-mapped: spark.checkpoint.dir must be a mounted folder (file:)")
    return place.path


def bigrams(tokens: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, token, row offsets) of each text's words and its end; the first context is BEGIN."""
    sizes = np.diff(rows)
    ends = np.cumsum(sizes + 1)
    word = np.full(int(ends[-1]) if len(ends) else 0, END, np.uint64)
    inner = np.ones(len(word), bool)
    inner[ends - 1] = False
    word[inner] = tokens[rows[0] : rows[-1]]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    offsets = np.concatenate([[0], ends])
    context[offsets[:-1]] = BEGIN
    return context, word, offsets


def pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(context * np.uint64(0x9FB21C651E98DF25) + word)


def _shard(context: np.ndarray, key: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """A context's bigrams lie in one shard, those of a frequent class of contexts in all."""
    spread = np.where(hot[(context % np.uint64(CLASSES)).astype(np.int64)], key, mixed(context))
    return (spread % np.uint64(shards)).astype(np.int64)


def _token_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for first, last in pieces(offsets, most):
            part = offsets[first : last + 1]
            tokens, rows = word_hashes(data[part[0] : part[-1]], part - part[0])
            yield batch, first, last, *bigrams(tokens, rows)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CLASSES, np.int64)
    for _, _, _, _, word, _ in _token_runs(batches, SCORED):
        counts += np.bincount((word % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"class": seen, "n": counts[seen]})


def _grouped(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Positions of the first row of each key, in a sorting order, and that order."""
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, np.int64)
    return order, starts


def _count(hot: np.ndarray, shards: int):
    """Bigram counts of a task, one packed row for each shard: contexts, successors of each, words, counts."""

    def packed(context: np.ndarray, word: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = pair(context, word)
        order, starts = _grouped(key)
        counts = np.diff(np.append(starts, len(key)))
        first = order[starts]
        # A count of more than a byte is passed on in parts, which the shard adds up.
        parts = (counts + 254) // 255
        rest = (counts - 255 * (parts - 1)).astype(np.uint8)
        first = np.repeat(first, parts)
        small = np.full(len(first), 255, np.uint8)
        small[np.cumsum(parts) - 1] = rest
        context, word, shard = context[first], word[first], _shard(context[first], key[first], hot, shards)
        order = np.argsort(context, kind="stable")
        order = order[np.argsort(shard[order], kind="stable")]
        context, word, small, shard = context[order], word[order], small[order], shard[order]
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        for s in range(shards):
            a, b = cuts[s], cuts[s + 1]
            if b > a:
                heads = np.flatnonzero(np.append(True, context[a + 1 : b] != context[a : b - 1]))
                sizes = np.diff(np.append(heads, b - a)).astype(np.uint32)
                yield pa.RecordBatch.from_pydict({
                    "shard": np.array([s]), "contexts": [context[a:b][heads].tobytes()], "sizes": [sizes.tobytes()],
                    "words": [word[a:b].tobytes()], "counts": [small[a:b].tobytes()],
                })

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, _, _, context, word, _ in _token_runs(batches, SCORED):
            held.append((context, word))
            size += len(word)
            if size >= GATHERED:
                yield from packed(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield from packed(*map(np.concatenate, zip(*held, strict=True)))

    return counted


def _save(path: str, array: np.ndarray) -> None:
    """A file that is whole or absent, however often a task is repeated."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as handle:
        np.save(handle, array)
    os.replace(part, path)


def _build_shard(folder: str):
    """Writes a shard's bigram hashes and counts; returns sums for contexts (kind 0), words (1) and counts of counts (2)."""

    def built(frame: pd.DataFrame) -> pd.DataFrame:
        unpack = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in frame[name]])
        context = np.repeat(unpack("contexts", np.uint64), unpack("sizes", np.uint32))
        word = unpack("words", np.uint64)
        key = pair(context, word)
        order, starts = _grouped(key)
        counts = np.add.reduceat(unpack("counts", np.uint8)[order].astype(np.int64), starts)
        first = order[starts]
        key, context, word = key[first], context[first], word[first]
        shard = int(frame["shard"].iloc[0])
        large = np.flatnonzero(counts >= 255)
        _save(f"{folder}/key-{shard}.npy", key)
        _save(f"{folder}/count-{shard}.npy", np.minimum(counts, 255).astype(np.uint8))
        _save(f"{folder}/large-{shard}.npy", np.stack([large, counts[large]]))
        order, starts = _grouped(context)
        sorted_counts = counts[order]
        sums = lambda x: np.add.reduceat(x.astype(np.int64), starts)
        by_context = pd.DataFrame({
            "kind": 0, "h": context[order][starts].view(np.int64), "x0": sums(sorted_counts),
            "x1": sums(sorted_counts == 1), "x2": sums(sorted_counts == 2), "x3": sums(sorted_counts >= 3),
        })
        words, contexts = np.unique(word, return_counts=True)
        by_word = pd.DataFrame({"kind": 1, "h": words.view(np.int64), "x0": contexts, "x1": 0, "x2": 0, "x3": 0})
        of = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        whole = pd.DataFrame({"kind": [2], "h": [shard], **{f"x{i}": [n] for i, n in enumerate(of)}})
        return pd.concat([by_context, by_word, whole], ignore_index=True)

    return built


_WORD_COLUMNS = ("total", "followed", "n1", "n2", "n3")


def _build_words(folder: str):
    """Writes a shard of words, sorted by hash; returns counts of words by number of contexts (1, 2, 3, 4, more)."""

    def built(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(u=frame["h"].to_numpy(np.int64).view(np.uint64)).sort_values("u")
        shard = int(frame["shard"].iloc[0])
        _save(f"{folder}/word-{shard}.npy", frame["u"].to_numpy())
        for name in _WORD_COLUMNS:
            _save(f"{folder}/{name}-{shard}.npy", frame[name].to_numpy(np.int64))
        followed = frame["followed"].to_numpy()
        followed = followed[frame["u"].to_numpy() != BEGIN]
        counts = [int((followed == k).sum()) for k in (1, 2, 3, 4)] + [int((followed > 4).sum())]
        return pd.DataFrame({**{f"m{k + 1}": [n] for k, n in enumerate(counts)}, "all": [int(followed.sum())], "shard": [shard]})

    return built


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken from counts of 1, 2 and more; halves of the counts where a number is missing."""
    if min(n1, n2, n3, n4) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(d if 0 < d < k else k / 2 for k, d in enumerate(found, 1))


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the numbers that hold for the whole model.

    ``absent`` are the shards of key and word that no row fell into; all others must have their files.
    """

    folder: str
    shards: int
    word_shards: int
    hot: np.ndarray
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    distinct_pairs: int
    spared: float
    vocabulary: int
    tokens: int
    texts: int
    absent: dict[str, frozenset[int]]


def train(texts: DataFrame) -> Model:
    """Counts the bigrams of ``texts`` (text) and writes the model to the shared folder.

    Frequent contexts, known from counts of ``CLASSES`` word classes, are spread over all shards, so no
    shard depends on one word. The driver sees those counts and a few sums, whatever the input.
    """
    spark = texts.sparkSession
    texts = texts.select("text")
    folder = f"{shared_path(spark)}/kneser-ney-{uuid.uuid4().hex}"
    os.makedirs(folder)
    classes = texts.mapInArrow(_classes, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    count = texts.count()
    tokens = int(np.sum(classes["n"].to_numpy())) if len(classes) else 0
    shards = max(1, math.ceil(tokens / SHARD_TOKENS))
    hot = np.zeros(CLASSES, bool)
    if len(classes):
        hot[classes["class"].to_numpy()[classes["n"].to_numpy() > tokens / (8 * shards)]] = shards > 1
    hot[int(BEGIN) % CLASSES] = shards > 1
    shared_hot = hot
    pairs = texts.mapInArrow(_count(shared_hot, shards), "shard long, contexts binary, sizes binary, words binary, counts binary")
    sums = materialize(
        pairs.groupBy("shard").applyInPandas(_build_shard(folder), "kind int, h long, x0 long, x1 long, x2 long, x3 long"), "kneser-ney-sums"
    )
    of = sums.filter("kind = 2").agg(*[F.coalesce(F.sum(f"x{i}"), F.lit(0)) for i in range(4)]).first()
    words = sums.filter("kind < 2").groupBy("h").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("x0")).otherwise(0)).alias("total"),
        F.sum(F.when(F.col("kind") == 1, F.col("x0")).otherwise(0)).alias("followed"),
        *[F.sum(f"x{i}").alias(f"n{i}") for i in (1, 2, 3)],
    )
    word_shards = max(1, math.ceil(tokens / 10 / SHARD_WORDS))
    words = words.withColumn("shard", F.pmod(F.shiftrightunsigned("h", 8), F.lit(word_shards)))
    schema = "m1 long, m2 long, m3 long, m4 long, m5 long, `all` long, shard long"
    held = materialize(words.groupBy("shard").applyInPandas(_build_words(folder), schema), "kneser-ney-words")
    m1, m2, m3, m4, m5, distinct = held.drop("shard").agg(*[F.coalesce(F.sum(f"`{c}`"), F.lit(0)) for c in held.columns[:-1]]).first()
    by_word = discounts(m1, m2, m3, m4)
    more = by_word[0] * m1 + by_word[1] * m2 + by_word[2] * (m3 + m4 + m5)
    return Model(
        folder, shards, word_shards, hot, discounts(*of), by_word, distinct,
        more / distinct if distinct else 1.0, m1 + m2 + m3 + m4 + m5, tokens, count,
        {"key": _absent(sums.filter("kind = 2").select("h"), shards), "word": _absent(held.select("shard"), word_shards)},
    )


def _absent(present: DataFrame, shards: int) -> frozenset[int]:
    """Numbers below ``shards`` that are not listed; only a model of few tokens has such."""
    if present.count() == shards:
        return frozenset()
    return frozenset(range(shards)) - {row[0] for row in present.collect()}


class _Reader:
    """Look-ups in the memory-mapped arrays."""

    def __init__(self, model: Model):
        self.model, self.open = model, {}

    def array(self, name: str, shard: int) -> np.ndarray | None:
        if (name, shard) not in self.open:
            # A file that should be there and is not ends the task: scores without it would be wrong.
            empty = shard in self.model.absent["word" if name in ("word", *_WORD_COLUMNS) else "key"]
            self.open[name, shard] = None if empty else np.load(f"{self.model.folder}/{name}-{shard}.npy", mmap_mode="r")
        return self.open[name, shard]

    def _places(self, name: str, keys: np.ndarray, shard: np.ndarray, shards: int):
        """For each shard: the positions among the sorted keys found there, and their places in its array."""
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in range(shards):
            mine = order[cuts[s] : cuts[s + 1]]
            array = self.array(name, s)
            if len(mine) and array is not None:
                at = np.searchsorted(array, keys[mine])
                at[at == len(array)] = 0
                found = array[at] == keys[mine]
                yield s, mine[found], at[found]

    def words(self, hashes: np.ndarray) -> dict[str, np.ndarray]:
        out = {name: np.zeros(len(hashes), np.int64) for name in _WORD_COLUMNS}
        shard = ((hashes >> np.uint64(8)) % np.uint64(self.model.word_shards)).astype(np.int64)
        # Spark takes the shifted hash as a signed number, which it is, since the upper bits are zero.
        for s, mine, at in self._places("word", hashes, shard, self.model.word_shards):
            for name, values in out.items():
                values[mine] = self.array(name, s)[at]
        return out

    def pairs(self, context: np.ndarray, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), np.int64)
        shard = _shard(context, key, self.model.hot, self.model.shards)
        for s, mine, at in self._places("key", key, shard, self.model.shards):
            counts = self.array("count", s)[at].astype(np.int64)
            big = np.flatnonzero(counts == 255)
            if len(big):
                places, values = np.asarray(self.array("large", s))
                counts[big] = values[np.searchsorted(places, at[big])]
            out[mine] = counts
        return out


def token_scores(reader: _Reader, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability by the model, training count) of each token after its context."""
    model = reader.model
    seen, place = np.unique(np.concatenate([word, context]), return_inverse=True)
    table = reader.words(seen)
    of_word, of_context = place[: len(word)], place[len(word) :]
    taken = np.array((0.0, *model.word_discounts))
    followed = table["followed"]
    plain = np.maximum(followed - taken[np.minimum(followed, 3)], 0) / max(1, model.distinct_pairs) + model.spared / (model.vocabulary + 1)
    counts = np.where(seen == END, model.texts, np.where(seen == BEGIN, 0, table["total"]))
    taken = np.array((0.0, *model.pair_discounts))
    total = table["total"]
    back = np.where(total > 0, (taken[1] * table["n1"] + taken[2] * table["n2"] + taken[3] * table["n3"]) / np.maximum(total, 1), 1.0)
    key = pair(context, word)
    keys, first, again = np.unique(key, return_index=True, return_inverse=True)
    found = reader.pairs(context[first], keys)[again]
    after = np.maximum(found - taken[np.minimum(found, 3)], 0) / np.maximum(total[of_context], 1)
    return after + back[of_context] * plain[of_word], counts[of_word]


def _score(model: Model):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(model)
        for batch, first, last, context, word, offsets in _token_runs(batches, SCORED):
            chance, count = token_scores(reader, context, word)
            base = (count + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1))
            total = lambda x: np.add.reduceat(x, offsets[:-1])
            n = np.diff(offsets)
            score = total(np.log10(chance))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").slice(first, last - first), "held_out": batch.column("held_out").slice(first, last - first),
                "n_tokens": n, "n_known": total((count > 0).astype(np.int64)), "train_tokens": np.full(len(n), model.tokens),
                "base_score": total(np.log10(base)), "score": score, "perplexity": 10.0 ** (-score / n),
            })

    return scored


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row.

    ``docs`` has doc_id, held_out and text. Words are lower-cased in A-Z; the end of a text is a token.
    Null and empty texts consist of their end. Unknown words share the probability spared for one
    unknown word. A model of no text gives every token the probability 1 / (0 + 1). Repeated rows
    repeat; null ids stay; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(
        _score(model),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double",
    )
