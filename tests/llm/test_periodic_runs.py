"""Periodic runs against plain loops over all periods, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quarry.llm import periodic_runs

SCHEMA = "doc_id long, text string, runs string, words string, a int, p int, top string"


def searched(words):
    """All (start, length, period), by start and period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_short_words_over_few_letters(seed):
    rng = random.Random(seed)
    for _ in range(300):
        n, letters = rng.randint(12, 70), rng.choice([1, 2, 2, 3])
        word = [rng.randrange(letters) for _ in range(n)]
        if rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 12)
            word[a:] = [word[a + (i - a) % p] for i in range(a, n)]
        assert [tuple(r) for r in periodic_runs.runs(np.array(word)).tolist()] == searched(word)


def test_common_extensions():
    rng = random.Random(5)
    word = np.array([rng.randrange(2) for _ in range(200)] * 2)
    index = periodic_runs.Longest(word + 1, 3)
    a, b = np.triu_indices(400, 1)
    shared = index.common(a, b)
    for x, y, k in zip(a[::37].tolist(), b[::37].tolist(), shared[::37].tolist()):
        assert (word[x : x + k] == word[y : y + k]).all() and (y + k == 400 or word[x + k] != word[y + k])
    order = sorted(range(400), key=lambda i: word[i:].tolist())
    assert np.argsort(index.rank[:400]).tolist() == order
    turned = sorted(range(400), key=lambda i: (1 - word[i:]).tolist())
    assert np.argsort(index.reversed_rank()[:400]).tolist() == turned


def expected(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    found = searched(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return len(found), *top, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(41)
    vocabulary = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(200)]
    out = [None, "", " \t\n ", "one", "a b " * 6, "a b " * 5, "A a " * 30, "x" * 50_000, "\x00 \x1f " * 9, "w " * 3000]
    for _ in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 250))]
        for _ in range(rng.randint(0, 3)):
            a, p = rng.randrange(len(words)), rng.randint(1, 40)
            b = min(len(words), a + rng.randint(5, 120))
            words[a:b] = [words[a + (i - a) % p] for i in range(a, b)]
        out.append(rng.choice([" ", "\n", "  \v"]).join(words))
    return out + out[-3:]


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t, "r", "w", 1, 2, "t") for i, t in enumerate(texts)], SCHEMA)


def test_report_is_what_plain_loops_find(spark, texts):
    ids = [*range(len(texts) - 3), None, None, 5]
    found = periodic_runs.report(documents(spark, texts, ids)).collect()
    want = [(i, *expected(t)) for i, t in zip(ids, texts)]
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, want))
    assert sum(w[1] > 0 for w in want) > 40
    assert periodic_runs.report(documents(spark, texts).limit(0)).count() == 0


def test_planted_texts(spark, texts):
    ids = [*range(len(texts) - 1), None]
    found = periodic_runs.planted(documents(spark, texts, ids)).collect()
    want = []
    for i, text in zip(ids, texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[j] if j < a else words[a + (j - a) % p] for j in range(n))
        want.append((i, text))
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, want))


def test_collapsed_text_keeps_one_period(spark):
    row = periodic_runs.collapse(documents(spark, ["say  it " + "again and " * 7 + "stop"])).first()
    assert row["collapsed"] == "say it again and stop" and [tuple(r) for r in row["runs"]] == [(2, 14, 2)]
