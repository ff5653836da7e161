"""Language identification by multilingual mixture inference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.text import fold, pieces, utf8

#: Bytes of an n-gram, hashed classes of n-grams, languages at most, added count of each class.
GRAM, CLASSES, MOST_LANGUAGES, ADDED = 3, 1 << 16, 256, 0.5
#: Rounds of expectation-maximisation per language set; weight of the penalty for each language.
ROUNDS, PENALTY = 8, 4.0

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[*range(65), *range(91, 97), *range(123, 128)]] = 32  # what is no letter separates


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, class) of every n-gram of bytes; each row is framed by separators."""
    sizes = np.diff(offsets) + 2
    at = np.concatenate([[0], np.cumsum(sizes)])
    framed = np.full(int(at[-1]) + GRAM, 32, np.uint32)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.ones(int(at[-1]), bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    framed[: len(inner)][inner] = _PLAIN[data]
    code = framed[: len(inner)].copy()
    for k in range(1, GRAM):
        code |= framed[k : k + len(inner)] << np.uint32(8 * k)
    hashed = (code * np.uint32(2654435761)) >> np.uint32(32 - int(np.log2(CLASSES)))
    inside = np.arange(len(inner)) < (at[1:] - (GRAM - 1))[rows]
    blank = code == np.uint32(int.from_bytes(b" " * GRAM, "little"))
    keep = inside & ~blank
    return rows[keep], hashed[keep].astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-gram classes by language: one array per language and task."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        names = np.array(batch.column("lang").to_pylist(), dtype=object)
        for first, last in pieces(offsets):
            part = offsets[first : last + 1]
            rows, classes = grams(data[part[0] : part[-1]], part - part[0])
            langs, code = np.unique(names[first:last].astype(str), return_inverse=True)
            table = np.bincount(code[rows] * CLASSES + classes, minlength=len(langs) * CLASSES).reshape(-1, CLASSES)
            for name, row in zip(langs, table, strict=True):
                counts[name] = counts.get(name, 0) + row
    for name, row in counts.items():
        seen = np.flatnonzero(row)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(seen), pa.string()), "gram": seen.astype(np.int32), "n": row[seen]})


def train(labelled: DataFrame, most: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log P(n-gram class | language), from (text, lang) with lang not null.

    The table has a fixed bound: ``CLASSES`` numbers for each of the ``most`` languages with the most rows, ties by
    name; rarer values of lang are not learned and never predicted.
    """
    labelled = labelled.select(F.col("lang").cast("string").alias("lang"), "text").filter(F.col("lang").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    names = sorted(r["lang"] for r in counts.collect())
    counted = (
        labelled.filter(F.col("lang").isin(names))
        .mapInArrow(_count, "lang string, gram int, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    table = np.full((CLASSES, max(1, len(names))), ADDED)
    if names:
        found = counted.toArrow()
        place = {name: i for i, name in enumerate(names)}
        columns = np.array([place[x] for x in found["lang"].to_pylist()], dtype=np.int64)
        table[found["gram"].to_numpy(), columns] += found["n"].to_numpy()
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


def infer(log_p: np.ndarray, counts: np.ndarray, classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (rows x languages) of each row's n-grams, and the penalised log-likelihood.

    A row's n-grams are drawn from a mixture of languages. Starting from the likeliest single
    language, the language with the steepest likelihood is offered to the set, the proportions are
    refitted by expectation-maximisation, and it stays if the log-likelihood grows by more than the
    penalty ``PENALTY * log(n) / 2``. The likelihood is concave in the proportions, so the slope also
    bounds the gain: rows that cannot gain enough are finished without a fit.
    """
    rows, langs = len(starts), log_p.shape[1]
    own = log_p[classes]
    single = np.add.reduceat(own * counts[:, None], starts, axis=0).astype(np.float64)
    total = np.add.reduceat(counts, starts).astype(np.float64)
    best = single.argmax(axis=1)
    share = np.zeros((rows, langs))
    share[np.arange(rows), best] = 1.0
    value = single[np.arange(rows), best]
    if langs == 1:
        return share, value
    chance = np.exp(own)
    lengths = np.diff(np.append(starts, len(classes)))
    price = PENALTY * np.log(np.maximum(total, 2)) / 2
    open_rows = np.arange(rows)
    for _ in range(langs - 1):
        # Entries of the rows still open, with their rows renumbered.
        picked = np.zeros(rows, bool)
        picked[open_rows] = True
        mine = np.repeat(picked, lengths)
        p, c = chance[mine], counts[mine].astype(np.float64)
        size = lengths[open_rows]
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        of = np.repeat(np.arange(len(open_rows)), size)

        def fitted(mixture, p=p, c=c, at=at, of=of):
            density = np.einsum("ij,ij->i", p, mixture[of])
            return density, np.add.reduceat(p * (c / density)[:, None], at, axis=0)

        now = share[open_rows]
        _, slope = fitted(now)
        slope = slope / total[open_rows][:, None]
        slope[now > 0] = 0
        offered = slope.argmax(axis=1)
        gain = total[open_rows] * (slope[np.arange(len(open_rows)), offered] - 1)
        worth = gain > price[open_rows]
        if not worth.any():
            break
        open_rows, now, offered = open_rows[worth], now[worth], offered[worth]
        mine = np.repeat(worth, size)
        p, c, size = p[mine], c[mine], size[worth]
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        of = np.repeat(np.arange(len(open_rows)), size)
        trial = now * 0.7
        trial[np.arange(len(open_rows)), offered] = 0.3
        for _ in range(ROUNDS):
            _, weight = fitted(trial, p, c, at, of)
            trial = trial * weight / total[open_rows][:, None]
        density, _ = fitted(trial, p, c, at, of)
        reached = np.add.reduceat(c * np.log(density), at)
        better = reached - value[open_rows] > price[open_rows]
        share[open_rows[better]] = trial[better]
        value[open_rows[better]] = reached[better]
        open_rows = open_rows[better]
        if not len(open_rows):
            break
    return share, value


def _predict(names: list[str], shared):
    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            legible = np.array(batch.column("legible").to_numpy(zero_copy_only=False), dtype=bool)
            for first, last in pieces(offsets):
                part = offsets[first : last + 1]
                rows, classes = grams(data[part[0] : part[-1]], part - part[0])
                keyed, counts = np.unique(rows * CLASSES + classes, return_counts=True)
                rows, classes = keyed // CLASSES, keyed % CLASSES
                seen, starts = np.unique(rows, return_index=True)
                share = np.zeros((last - first, max(1, len(names))))
                if len(seen) and names:
                    share[seen] = infer(log_p, counts, classes, starts)[0]
                best = share.argmax(axis=1)
                score = share[np.arange(last - first), best]
                known = legible[first:last] & (score > 0)
                out = {
                    "doc_id": batch.column("doc_id").slice(first, last - first),
                    "held_out": batch.column("held_out").slice(first, last - first),
                    "lang_pred": pa.array([names[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()),
                    "score": np.where(known, np.clip(score, 0, 1), 0.0),
                    "languages": pa.array(["+".join(names[i] for i in np.argsort(-s, kind="stable") if s[i] > 0) if k else "" for s, k in zip(share, known, strict=True)], pa.string()),
                }
                yield pa.RecordBatch.from_pydict(out)

    return predicted


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score (its proportion), languages (the chosen set, largest first).

    ``docs`` has doc_id and text. Whole texts are read. Null texts and texts without a letter give
    ``und`` with score 0, as does a model without languages; equal proportions go to the first name.
    Rows are treated one by one, so repeated rows repeat; a null id is kept (not held out).
    """
    names, log_p = model
    shared = docs.sparkSession.sparkContext.broadcast(log_p)
    rows = docs.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text",
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("legible"),
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(names, shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages string")
