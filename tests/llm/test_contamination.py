"""Benchmark decontamination against plain loops, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from quarry.llm import contamination

SCHEMA = "doc_id long, text string, spans string, windows string, key int, row string, id string, cut string"
LONG = "Mixed Case words, here: und Größe №7 " * 400


def documents(spark, texts, ids=None):
    rows = [(ids[i] if ids else i, t, "s", "w", 1, "r", "i", "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def expected(texts, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])] - {None}
        listed = ",".join(sorted(map(str, found)))
        out.append((len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def items():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdeéß9") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))) for i in range(40)]
    same = rows[7][1]
    return rows + [(100, same), (9, same), (None, "only words of an item without an id are these ten or more"), (101, None), (102, " .. "), (103, "Solo")]


@pytest.fixture(scope="module")
def texts(items):
    rng = random.Random(22)
    out = [None, "", " \n ", "!", "solo", "SOLO; solo", LONG, "long " * 30_000]
    for _ in range(60):
        parts = [rng.choice(items)[1] or "x" for _ in range(rng.randint(1, 4))]
        cut = [" ".join(p.split()[rng.randint(0, 5) : rng.randint(8, 30)]) for p in parts]
        out.append(" -- ".join(cut).upper() if rng.random() < 0.3 else ",".join(cut))
    return out + [items[7][1], items[7][1], "x " + items[-4][1]]


@pytest.mark.parametrize("most", [contamination.SLICE, 50])
def test_report_is_what_plain_loops_find(spark, texts, items, monkeypatch, most):
    monkeypatch.setattr(contamination.scan, "__defaults__", (most,))
    ids = [*range(len(texts) - 3), None, None, 3]  # equal rows without an id, and one id with two texts
    docs, bench = documents(spark, texts, ids), spark.createDataFrame(items, "item_id long, text string")
    found = contamination.report(docs, bench)
    mine = sorted(map(repr, found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()))
    want = found.sparkSession.createDataFrame([(i, *x) for i, x in zip(ids, expected(texts, items))], found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").schema)
    assert mine == sorted(map(repr, want.collect()))
    assert sum(r[1] > 0 for r in expected(texts, items)) > 20


def test_equal_hashes_are_told_apart_by_their_words(spark, texts, items, monkeypatch):
    import numpy as np

    windows = contamination.benchmark_windows(spark.createDataFrame(items, "item_id long, text string")).distinct
    [chosen] = contamination.hash_sets(windows)
    words_ = contamination.Words.of(*(lambda b: (np.frombuffer(b, np.uint8), np.array([0, len(b)])))(texts[20].encode()))
    hashes = contamination.WindowHashes(words_)
    real = chosen.hits(words_, hashes)[2]
    one = contamination.HashSet(np.zeros(len(chosen.hashes), np.uint64), chosen.digests, chosen.lengths)
    monkeypatch.setattr(hashes, "at", lambda n, at=hashes.at: (at(n)[0], np.zeros(len(at(n)[0]), np.uint64)))
    assert sorted(one.hits(words_, hashes)[2]) == sorted(real)


def test_documents_and_spans_go(spark, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    leak = next(t for _, t in items if len(t.split()) > 20)
    clean = "nothing of the kind stands in this text, it has words of its own"
    docs = documents(spark, [clean, f"Before: {leak} / after", re.sub("[a-z]", lambda m: m[0].upper(), leak), None], [1, None, 3, 4])
    left = contamination.decontaminate(docs, bench)
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(1, clean), (4, None)] and left.columns == docs.columns
    cut = contamination.decontaminate(docs, bench, spans=True)
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: clean, None: "Before:  / after", 3: "", 4: None}
    assert cut.columns == docs.columns and cut.filter("windows = 'w' AND row = 'r'").count() == 4


def test_empty_tables(spark, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, ["solo", "b"])
    assert contamination.report(docs.limit(0), bench).count() == 0
    assert contamination.report(docs, bench.limit(0)).filter("NOT contaminated AND n_words = 1").count() == 2
    assert contamination.decontaminate(docs, bench.limit(0)).count() == 2
