"""Maximal periodic runs of words, from Lyndon roots extended by suffix-tree LCE queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.text import WORD, mixed, pieces, powers, range_hash, span_hashes, utf8, words

#: Fewest words of a run, and words of the pieces that any run holds twice: a run of period q has
#: max(12 - q, q) words or more that equal the word q further on.
SHORTEST, REPEATED = 12, 6
_WORD_BASE, _PIECE_BASE = 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3


def suffix_tree(symbols: list[int], alphabet: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Ukkonen's suffix tree of ``symbols``, whose last one is unique; symbols are below ``alphabet``.

    Returns the children as {node * alphabet + first symbol: node}, and where each node's edge begins and
    ends in the symbols. Node 0 is the root; leaves end at the last symbol.
    """
    n = len(symbols)
    child: dict[int, int] = {}
    begin, end, link = [0], [0], [0]
    node, edge, length, open_suffixes = 0, 0, 0, 0
    for i in range(n):
        symbol = symbols[i]
        open_suffixes += 1
        waiting = -1
        while open_suffixes:
            if not length:
                edge = i
            slot = node * alphabet + symbols[edge]
            below = child.get(slot, -1)
            if below < 0:
                child[slot] = len(begin)
                begin.append(i)
                end.append(n)
                link.append(0)
                if waiting > 0:
                    link[waiting] = node
                waiting = node if node else -1
            else:
                span = (end[below] if end[below] < i + 1 else i + 1) - begin[below]
                if length >= span:
                    edge, length, node = edge + span, length - span, below
                    continue
                if symbols[begin[below] + length] == symbol:
                    length += 1
                    if waiting > 0:
                        link[waiting] = node
                    break
                split = len(begin)
                begin.append(begin[below])
                end.append(begin[below] + length)
                link.append(0)
                child[slot] = split
                child[split * alphabet + symbol] = split + 1
                begin.append(i)
                end.append(n)
                link.append(0)
                begin[below] += length
                child[split * alphabet + symbols[begin[below]]] = below
                if waiting > 0:
                    link[waiting] = split
                waiting = split
            open_suffixes -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - open_suffixes + 1
    return child, begin, end


class Longest:
    """Longest common extensions of suffixes: an Euler tour of their suffix tree, and minima of its depths."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        n = self.n = len(symbols)
        child, begin, end = suffix_tree([*symbols.tolist(), 0], alphabet)
        slots = np.fromiter(child, np.int64, len(child))
        order = np.argsort(slots)
        self.children = np.fromiter(child.values(), np.int64, len(child))[order].tolist()
        self.first = np.searchsorted(slots[order], np.arange(len(begin) + 1) * alphabet).tolist()
        self.length = (np.array(end) - np.array(begin)).tolist()
        tour, at, leaves = self._tour()
        self.place = at
        self.rank = np.empty(n + 1, np.int64)
        self.rank[leaves] = np.arange(n + 1)
        self.minima = [np.array(tour, np.int32)]
        while 2 << (len(self.minima) - 1) <= len(tour):
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def _tour(self) -> tuple[list[int], np.ndarray, list[int]]:
        """Depths of the tour, where it meets each suffix's leaf, and the suffixes in order."""
        n, children, first, length = self.n, self.children, self.first, self.length
        tour, at, leaves, path = [0], np.zeros(n + 1, np.int64), [], [(0, first[0], first[1])]
        while path:
            depth, k, last = path.pop()
            if k == last:
                if path:
                    tour.append(path[-1][0])
                continue
            path.append((depth, k + 1, last))
            node = children[k]
            below = depth + length[node]
            if first[node] == first[node + 1]:
                suffix = n + 1 - below
                at[suffix] = len(tour)
                leaves.append(suffix)
                tour.append(below)
                tour.append(depth)
            else:
                tour.append(below)
                path.append((below, first[node], first[node + 1]))
        return tour, at, leaves

    def reversed_rank(self) -> np.ndarray:
        """Ranks of the suffixes when greater symbols come first, but a prefix still before what it begins."""
        n, children, first, length = self.n, self.children, self.first, self.length
        rank, found, todo = np.empty(n + 1, np.int64), 0, [(0, 0)]
        while todo:
            node, depth = todo.pop()
            a, b = first[node], first[node + 1]
            if a == b:
                rank[n + 1 - depth] = found
                found += 1
                continue
            # The last one pushed is met first: an edge of the end sign alone is the first child.
            ends = a if depth + length[children[a]] <= n + 1 and first[children[a]] == first[children[a] + 1] and length[children[a]] == 1 else -1
            for k in range(a, b):
                if k != ends:
                    todo.append((children[k], depth + length[children[k]]))
            if ends >= 0:
                todo.append((children[ends], depth + 1))
        return rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at a and b share, for arrays of different places."""
        x, y = self.place[a], self.place[b]
        low, high = np.minimum(x, y), np.maximum(x, y) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            rows = np.flatnonzero(level == k)
            table = self.minima[k]
            out[rows] = np.minimum(table[low[rows]], table[high[rows] - (1 << k)])
        return out


def lyndon_ends(rank: list[int]) -> np.ndarray:
    """For each place the end of the longest Lyndon word there: the next smaller suffix."""
    n = len(rank) - 1
    out, open_places = np.full(n, n, np.int64), []
    for i in range(n):
        r = rank[i]
        while open_places and rank[open_places[-1]] > r:
            out[open_places.pop()] = i
        open_places.append(i)
    return out


def runs(symbols: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs of SHORTEST or more symbols, by start and period.

    Every run holds a longest Lyndon word of one of the two orders of the symbols as a root, so each of
    these words, extended to both sides as far as its period holds, gives all runs.
    """
    n = len(symbols)
    alphabet = int(symbols.max()) + 2
    forward, backward = Longest(symbols + 1, alphabet), Longest(symbols[::-1] + 1, alphabet)
    ends = [lyndon_ends(r.tolist()) for r in (forward.rank, forward.reversed_rank())]
    start = np.tile(np.arange(n), 2)
    end = np.concatenate(ends)
    period = end - start
    right, left = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
    inner = np.flatnonzero(end < n)
    right[inner] = forward.common(start[inner], end[inner])
    inner = np.flatnonzero(start > 0)
    left[inner] = backward.common(n - start[inner], n - end[inner])
    start, length = start - left, left + period + right
    found = np.flatnonzero(length >= np.maximum(SHORTEST, 2 * period))
    return np.unique(np.stack([start[found], length[found], period[found]], axis=1)[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def stretches(hashes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, first word, end) of stretches covered by pieces of REPEATED words that their row holds twice.

    All of a run is covered, so a run is found within one stretch, and it is maximal there if it is maximal.
    """
    counts = np.diff(rows)
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.flatnonzero(np.repeat(rows[1:], counts) - np.arange(len(hashes)) >= REPEATED)
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_PIECE_BASE, len(hashes)), out=prefix[1:])
    value = range_hash(prefix, first, first + REPEATED, _PIECE_BASE) ^ mixed(row[first].astype(np.uint64) + np.uint64(1))
    order = np.argsort(value)
    same = value[order][1:] == value[order][:-1]
    twice = np.sort(first[order[np.append(same, False) | np.append(False, same)]])
    if not len(twice):
        return
    new = np.append(True, (twice[1:] > twice[:-1] + REPEATED) | (row[twice[1:]] != row[twice[:-1]]))
    begin = twice[new]
    end = twice[np.append(np.flatnonzero(new)[1:] - 1, len(twice) - 1)] + REPEATED
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        if b - a >= SHORTEST:
            yield int(row[a]), a, b


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        listed: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        collapsed: list[str] = []
        for a, b in pieces(offsets):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            start, end, rows = words(part, at)
            by_row: dict[int, list[np.ndarray]] = {}
            for row, x, y in stretches(span_hashes(part, start, end, _WORD_BASE), rows):
                names: dict[bytes, int] = {}
                spelt = [part[i:j].tobytes() for i, j in zip(start[x:y].tolist(), end[x:y].tolist(), strict=True)]
                symbols = np.array([names.setdefault(w, len(names)) for w in spelt])
                some = runs(symbols)
                if len(some):
                    by_row.setdefault(row, []).append(some + [x - int(rows[row]), 0, 0])
            for row in range(b - a):
                text = part[at[row] : at[row + 1]].tobytes().split()
                if row in by_row:
                    found = np.concatenate(by_row[row])
                    change = np.zeros(len(text) + 1, np.int64)
                    np.add.at(change, found[:, 0] + found[:, 2], 1)
                    np.add.at(change, found[:, 0] + found[:, 1], -1)
                    keep = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
                    text = [text[k] for k in keep]
                    listed[a + row] = [{"start": s, "length": n, "period": p} for s, n, p in found.tolist()]
                collapsed.append(b" ".join(text).decode())
        kind = pa.list_(pa.struct({"start": pa.int64(), "length": pa.int64(), "period": pa.int64()}))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "runs": pa.array(listed, kind), "collapsed": pa.array(collapsed, pa.string())})


def collapse(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) of each row of ``docs`` (doc_id, text).

    ``runs`` lists the start, length and period, in words, of every run by start and period: a longest stretch
    of SHORTEST words or more in which words at the distance of its smallest period are equal, and which holds
    that period twice. ``collapsed`` has the words that no run contains after its first period, joined by single spaces.
    Words are compared by their bytes; hashes only choose the stretches that can hold runs, and equal hashes
    of different words add work alone. Null and empty texts have no words and collapse to nothing; equal
    rows and null ids are rows as any other; an empty table gives an empty result; other columns are not
    read. A text's stretches are handled one by one, in memory of about 50 numbers a word.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _found, f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    )


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which about every tenth text repeats its words periodically from some word on.

    With h the crc32 of the id as text and g = h / 10, texts of h % 10 = 0 repeat p = 1 + (n - a) / (3 + g % 8)
    words from word a = g % n on. Rows without id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    listed = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("words"))
    n = F.size("words")
    a = F.when(n > 0, F.pmod("g", n)).cast("int")
    p = (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    placed = listed.withColumn("a", a).withColumn("p", p)
    place = F.sequence(F.lit(0), n - 1)
    again = F.transform(place, lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return placed.select("doc_id", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and hashes of all runs and of the collapsed text."""
    found = collapse(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    top = found.withColumn("top", longest)
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.col2")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.col3")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.col3")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
