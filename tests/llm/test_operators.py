"""Each operator against a brute-force version, and on nulls, empty tables, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import (
    cover_tree, graph, kneser_ney, language, line_dedup, mixing, permutation_index, run_length_index, sampling, simhash, similar, text, toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, bits string, line string, size string"
LOWER = text.LOWER


def corpus(spark, texts, ids=None, langs=None, sources=None):
    rows = [
        (ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", None if t is None else len(t), 0.5, "k", "b", "l", "z")
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, words, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(words))


ODD = [None, "", " \n ", "x", "Wörter über Straßen", "a b", "same words here", "same words here", "☃ " * 300, "long " * 20_000]


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(120)]


def test_words_split_rows(spark):
    import pyarrow as pa

    column = pa.array(["Ab c", None, "", "\tD\x0bé  f\n", "g"])
    data, offsets = text.utf8(column.slice(0, 5))
    starts, ends, rows = text.words(data, offsets)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(starts, ends)] == ["Ab", "c", "D", "é", "f", "g"]
    assert np.diff(rows).tolist() == [2, 0, 0, 3, 1]
    hashes, _ = text.word_hashes(data, offsets)
    again, _ = text.word_hashes(*text.utf8(pa.array(["x AB", "C"])))
    assert hashes[0] == again[1] and hashes[1] == again[2] and len(set(hashes.tolist())) == 6


def test_language(spark):
    rng = random.Random(1)
    letters = {"aa": "abcd", "bb": "wxyz"}
    make = lambda name, n: " ".join("".join(rng.choice(letters[name]) for _ in range(5)) for _ in range(n))
    train = corpus(spark, [make(n, 60) for n in ("aa", "bb") * 10], langs=["aa", "bb"] * 10)
    model = language.train(train)
    docs = corpus(spark, [make("aa", 40), make("bb", 40), make("aa", 60) + " " + make("bb", 20), *ODD], ids=[*range(12), None])
    found = language.identify(docs, model).collect()
    assert [r["lang_pred"] for r in found[:2]] == ["aa", "bb"] and found[0]["languages"] == "aa"
    assert found[2]["languages"] == "aa+bb" and 0.6 < found[2]["score"] < 0.9
    assert [r["lang_pred"] for r in found[3:6]] == ["und"] * 3 and found[3]["score"] == 0
    assert len(found) == 13 and found[-1]["held_out"] is False
    nothing = language.train(train.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_line_dedup(spark, vocabulary):
    rng = random.Random(2)
    lines = [prose(rng, rng.randint(1, 25), vocabulary) for _ in range(60)]
    texts = []
    for _ in range(40):
        some = []
        for line in rng.sample(lines, rng.randint(1, 6)):
            words = line.split()
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            some.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
        texts.append("\n".join(some))
    texts += ODD
    docs = corpus(spark, texts)
    want, seen = {}, []
    for i, t in enumerate(texts):
        want[i] = []
        for n, line in enumerate((t or "").split("\n")):
            words = set(line.lower().split())
            if words and any(9 * len(words & s) >= 4 * (len(words) + len(s)) for s in seen):
                want[i].append(n)
            if words:
                seen.append(words)
    found = {r["doc_id"]: r for r in line_dedup.report(docs).collect()}
    assert {i: r["removed"] for i, r in found.items()} == {i: ",".join(map(str, x)) for i, x in want.items()}
    cleaned = {r["doc_id"]: r for r in line_dedup.dedup(docs).collect()}
    assert line_dedup.dedup(docs).columns == docs.columns
    for i, t in enumerate(texts):
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i])
        assert cleaned[i]["text"] == kept and (kept is None or cleaned[i]["n_chars"] == len(kept))
    assert line_dedup.report(docs.limit(0)).count() == 0


def test_line_dedup_tells_rows_of_one_id_apart(spark):
    # Three numbered lines a row: unique ones, and ones that stand elsewhere.
    rows = [
        (None, "one two three\nred green blue\nalpha beta gamma"),
        (None, "four five six\nseven eight nine\nalpha beta gamma"),
        (None, "ten eleven twelve\nred green blue\nunique line here"),
        (7, "north south\nred green blue\neast west"),
        (7, "north south\nup down\nleft right"),
        (8, "said twice under one id"), (8, "said twice under one id"),
        (None, "a whole text again\n\nits other line"), (None, "a whole text again\n\nits other line"), (None, None), (None, None),
    ]
    docs = corpus(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    found = line_dedup.dedup(docs).collect()
    assert len(found) == len(rows)
    kept = Counter(line for r in found for line in (r["text"] or "").split("\n") if line)
    assert kept == {line: 1 for _, t in rows for line in (t or "").split("\n") if line} | {"said twice under one id": 2}
    report = line_dedup.report(docs).collect()
    assert sum(r["n_removed"] for r in report) == 6 and len(report) == len(rows)


@pytest.fixture(scope="module")
def lattices():
    with open(sampling.MODEL, "rb") as handle:
        return sampling.Lattices(sampling.Vocabulary(handle.read()))


def test_segmentations_follow_their_distribution(lattices):
    vocabulary, chunk = lattices.vocabulary, " oxen"
    lattices.begin([[chunk]])
    spelt, found = chunk.replace(" ", "▁"), {}

    def spell(i, ids, p):
        if i == len(spelt):
            found[ids] = p
        for j in range(i + 1, len(spelt) + 1):
            if spelt[i:j] in vocabulary.pieces:
                piece, q = vocabulary.pieces[spelt[i:j]]
                spell(j, (*ids, piece), p * q)

    spell(0, (), 1.0)
    total = sum(found.values())
    start, first, weights, runs = np.array([lattices.known[chunk]]), Counter(), Counter(), 3000
    for seed in range(runs):
        drawn = sampling.segmentations(start, lattices, 3, np.random.default_rng(seed))
        keys = [tuple(x[0].tolist()) for x in drawn]
        assert len(set(keys)) == 3 and [x[2] for x in drawn] == sorted((x[2] for x in drawn), reverse=True)
        first[keys[0]] += 1
        for key, (_, log_prob, _, inclusion) in zip(keys, drawn):
            assert log_prob == pytest.approx(math.log(found[key] / total), abs=1e-6)
            weights[key] += 1 / inclusion / runs
    for key in sorted(found, key=found.get)[-2:]:
        assert first[key] / runs == pytest.approx(found[key] / total, abs=0.03)
        assert weights[key] == pytest.approx(1, abs=0.2)


def test_encoding_round_trip(spark):
    texts = [*ODD, "  two  spaces ", "▁ literal \x00 \U0001f600\n\nend"]
    docs = corpus(spark, texts, ids=[*range(11), None])
    encoded = sampling.encode(docs).cache()
    rows = encoded.collect()
    assert all(r["decoded_ok"] for r in rows) and {r["rank"] for r in rows if r["doc_id"] in (0, 1)} == {1}
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(tuple(r["ids"]))
        assert 0 < r["inclusion"] <= 1
    assert all(len(set(x)) == len(x) for x in by_doc.values())
    decoded = {(r["doc_id"], r["rank"]): r["text"] for r in sampling.decode(encoded).collect()}
    assert all(decoded[i, 1] == (t or "") for i, t in zip([*range(11), None], texts))
    assert sampling.encode(docs.limit(0)).count() == 0


def test_kneser_ney(spark, vocabulary):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 60), vocabulary[:30]) for _ in range(80)] + ["unseen Words here", *ODD[:8]]
    docs = corpus(spark, texts).withColumn("held_out", F.col("doc_id") >= 70)
    model = kneser_ney.train(docs.filter("NOT held_out"))
    found = {r["doc_id"]: r for r in kneser_ney.score(docs, model).collect()}
    tokens = [[*(t or "").encode().translate(LOWER).split(), b"</s>"] for t in texts]
    count, pairs = Counter(), Counter()
    for t in tokens[:70]:
        count.update(t)
        pairs.update(zip([b"<s>", *t], t))
    followed, total, by = Counter(w for _, w in pairs), Counter(), {}
    for (a, _), n in pairs.items():
        total[a] += n
        by.setdefault(a, [0, 0, 0])[min(n, 3) - 1] += 1
    d2 = kneser_ney.discounts(*[Counter(pairs.values())[k] for k in (1, 2, 3, 4)])
    d1 = kneser_ney.discounts(*[Counter(followed.values())[k] for k in (1, 2, 3, 4)])
    spared = sum(d1[min(n, 3) - 1] for n in followed.values()) / len(pairs)

    def p(a, w):
        plain = (followed[w] - d1[min(followed[w], 3) - 1] if followed[w] else 0) / len(pairs) + spared / (len(count) + 1)
        if a not in total:
            return plain
        n = pairs[a, w]
        return (n - d2[min(n, 3) - 1] if n else 0) / total[a] + sum(x * y for x, y in zip(d2, by[a])) / total[a] * plain

    n = sum(count.values())
    assert sum(p(b"<s>", w) for w in [*count, b"?"]) == pytest.approx(1)
    for i, t in enumerate(tokens):
        assert found[i]["score"] == pytest.approx(sum(math.log10(p(a, w)) for a, w in zip([b"<s>", *t], t)))
        assert found[i]["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (len(count) + 1))) for w in t))
        assert (found[i]["n_tokens"], found[i]["n_known"], found[i]["train_tokens"]) == (len(t), sum(count[w] > 0 for w in t), n)
    empty = kneser_ney.train(docs.limit(0))
    assert kneser_ney.score(docs.filter("doc_id = 0"), empty).first()["score"] == 0
    assert kneser_ney.score(docs.limit(0), model).count() == 0


def test_kneser_ney_shards_agree(spark, vocabulary, monkeypatch):
    rng = random.Random(4)
    docs = corpus(spark, [prose(rng, 50, vocabulary) + " the the the" for _ in range(60)]).withColumn("held_out", F.lit(False))
    one = kneser_ney.score(docs, kneser_ney.train(docs)).orderBy("doc_id").collect()
    monkeypatch.setattr(kneser_ney, "SHARD_TOKENS", 300)
    monkeypatch.setattr(kneser_ney, "SHARD_WORDS", 30)
    many = kneser_ney.score(docs, kneser_ney.train(docs)).orderBy("doc_id").collect()
    assert [r["score"] for r in one] == pytest.approx([r["score"] for r in many])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, data string, block int")


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 8)).astype(np.float32)
    base[100:140] = base[0]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    return rows + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] * 8), (304, [1.0]), (None, [1.0] * 8)]


def test_cover_tree_is_exact(spark, points, monkeypatch):
    monkeypatch.setattr(cover_tree, "ROWS", (20, 70))
    found = cover_tree.top_k(vectors(spark, points), F.col("vec_id") % 10 == 0, 10).collect()
    whole = {i: np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for i, v in points if i is not None and (i < 300 or i == 301)}
    for q in (i for i in whole if i % 10 == 0):
        best = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q)[:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [(i, -s) for s, i in best] == [(i, s) for _, i, s in mine]
    assert cover_tree.top_k(vectors(spark, points[:0]), F.col("vec_id") % 10 == 0).count() == 0
    assert cover_tree.top_k(vectors(spark, points[:5]), F.col("vec_id") % 10 == 0).count() == 4


def test_permutation_index(spark, points):
    found = permutation_index.nearest(vectors(spark, points), F.col("vec_id") % 10 == 0, 20).collect()
    exact = {i: np.array(v, np.float64) for i, v in points if i is not None and i < 300}
    hits = 0
    for q in range(0, 300, 10):
        best = {i for _, i in sorted((-(exact[q] @ x), i) for i, x in exact.items() if i != q)[:20]}
        mine = [r for r in found if r["query_id"] == q]
        assert len(mine) == 20 and all(r["score"] == pytest.approx(exact[q] @ exact[r["vec_id"]], rel=1e-12) for r in mine)
        hits += len(best & {r["vec_id"] for r in mine})
    assert hits / 600 > 0.9
    assert permutation_index.nearest(vectors(spark, points[:0]), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("shape", ["lengths", "cluster", "copies", "few"])
def test_permutation_index_keeps_its_recall(spark, shape):
    rng = np.random.default_rng(8)
    found = rng.normal(size=({"few": 500}.get(shape, 2000), 64))
    found /= np.linalg.norm(found, axis=1, keepdims=True)
    if shape == "lengths":
        found *= np.exp(rng.normal(size=(2000, 1)) / 2)
    elif shape == "cluster":
        found[::3] = found[0] + rng.normal(size=(667, 64)) * 0.08
    elif shape == "copies":
        found[::3] = found[0]
    found = found.astype(np.float32).astype(np.float64)
    rows = permutation_index.nearest(vectors(spark, [(i, v.tolist()) for i, v in enumerate(found)]), F.col("vec_id") % 20 == 7, 20).collect()
    mine, hits, asked = {}, 0, range(7, len(found), 20)
    for r in rows:
        mine.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in asked:
        scores = np.round(found @ found[q], 9)
        scores[q] = -np.inf
        hits += len(mine[q] & set(np.argsort(-scores, kind="stable")[:20].tolist()))
    assert hits / (20 * len(asked)) >= 0.9


def test_permutation_index_needs_few_copies():
    ids = np.repeat([4, 1, 3, 2], [9, 2, 1, 5])
    kept = permutation_index._needed(ids, np.tile([[0.5, -0.0]], (17, 1)), 2)
    assert sorted(ids[kept].tolist()) == [1, 1, 2, 2]
    kept = permutation_index._needed(ids, np.repeat([[0.5, 1.0], [2.0, 1.0]], [9, 8], axis=0), 2)
    assert sorted(ids[kept].tolist()) == [1, 1, 2, 2, 4, 4]


def test_simhash(spark, vocabulary):
    rng = random.Random(7)
    texts = []
    for _ in range(25):
        words = prose(rng, 150, vocabulary).split()
        for _ in range(6):
            copy = list(words)
            copy[rng.randrange(150)] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += ODD
    docs = corpus(spark, texts, ids=[i * 3 % 1000 for i in range(len(texts))])
    rows = simhash.near_duplicates(docs).collect()
    bits = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    root = {i: i for i in bits}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in itertools.combinations(bits, 2):
        if (bits[a] ^ bits[b]).bit_count() <= 3:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: find(i) for i in bits}
    assert len(set(map(find, bits))) < len(bits) - 20
    kept = simhash.first_of_each(docs)
    assert {r["doc_id"] for r in kept.collect()} == {find(i) for i in bits} and kept.columns == docs.columns
    nulls = corpus(spark, ["a", "a", None], ids=[None, None, None])
    assert simhash.near_duplicates(nulls).count() == 3 and simhash.first_of_each(nulls).count() == 3
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_of_five_word_similarity(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(30):
        words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(150)]
        for changes in (0, 1, 2, 3, 5):
            copy = list(words)
            for place in rng.sample(range(0, 150, 8), changes):
                copy[place] = "other" + str(rng.random())
            texts.append(" ".join(copy))
    texts += ODD
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else {()} for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
    kept = similar.first_of_each(corpus(spark, texts))
    assert {r["doc_id"] for r in kept.collect()} == set(root)
    assert len(set(root)) < 80 and kept.columns == corpus(spark, texts).columns


def test_near_copies_are_proposed_by_fingerprints_too(spark):
    """Copies within 3 bits are proposed by their fingerprints, and joined if they are similar."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    changed, spaced = [*words[:-1], "other"], "  ".join(words) + "\n"
    texts = [" ".join(words), " ".join(changed), spaced, " ".join(reversed(words)), "one two", None, ""]
    bits = [simhash.fingerprint((t or "").encode()) for t in texts]
    assert (bits[0] ^ bits[1]).bit_count() <= simhash.DISTANCE
    distinct = spark.createDataFrame([(i, b - (b >> 63 << 64)) for i, b in enumerate(bits)], "set_key long, bits long")
    pairs = {(r.a, r.b) for r in similar.fingerprint_pairs(distinct).collect()}
    assert (0, 2) in pairs and (0, 1) in pairs and (5, 6) in pairs
    docs = corpus(spark, texts)
    found = {r.doc_id: r.component for r in similar.components_of(docs).collect()}
    assert found[0] == found[1] == found[2] and found[5] == found[6] and len(set(found.values())) == 4
    assert {r.doc_id for r in similar.first_of_each(docs).collect()} == {0, 3, 4, 5}


def test_near_copies_without_or_under_one_id(spark, vocabulary):
    rng = random.Random(10)
    a, b, c, d = (prose(rng, 60, vocabulary) for _ in range(4))
    docs = corpus(spark, [a, a, a, b, c, c, d, d, None, ""], ids=[None, None, 3, 4, 4, None, None, None, 9, None])
    kept = Counter((r["doc_id"], r["text"]) for r in similar.first_of_each(docs).collect())
    assert kept == {(3, a): 1, (4, b): 1, (4, c): 1, (None, d): 1, (9, None): 1}


def test_anchors_meet_for_all_close_fingerprints():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2**63, 200).astype(np.uint64)
    y = x.copy()
    for k in range(200):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            y[k] ^= np.uint64(1) << np.uint64(bit)
    places = []
    for bits in (x, y):
        index, anchor, cost = simhash.anchors(bits)
        places.append([{(int(a), int(c) <= 1) for a, c in zip(anchor[index == k], cost[index == k])} for k in range(200)])
    for near, far in zip(*places):
        assert any((a, True) in near or (a, True) in far for a in {a for a, _ in near} & {a for a, _ in far})


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (300, 200)]
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(51)) and all(found[100 + i] == 100 for i in range(40)) and found[300] == 200
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toxicity(spark, vocabulary):
    rng = random.Random(9)
    texts, toxic = [], []
    for i in range(400):
        words = prose(rng, 80, vocabulary).split()
        toxic.append(int(i % 4 == 0))
        if toxic[-1]:
            for _ in range(5):
                words[rng.randrange(80)] = rng.choice(["blockhead", "nitwitted", "dunderly"])
        texts.append(" ".join(words))
    docs = corpus(spark, texts + ODD)
    labels = spark.createDataFrame([*enumerate(toxic), (None, 1), (5000, None), (6000, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, toxicity.learnable(labels))
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert sum(found[i]["predicted"] == y for i, y in enumerate(toxic) if found[i]["held_out"]) > 0.95 * sum(r["held_out"] for i, r in found.items() if i < 400)
    assert all(0 <= r["score"] <= 1 for r in found.values()) and found[400]["predicted"] == 0 and found[400]["score"] == found[401]["score"]
    assert toxicity.ordinary(docs, model).count() == sum(r["score"] < 0.5 for r in found.values())
    blank = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, blank).filter("predicted = 1").count() == 0 and toxicity.score(docs.limit(0), model).count() == 0


def repeats(texts):
    raw = [(t or "").encode() for t in texts]
    n = run_length_index.LENGTH
    seen = Counter(r[i : i + n] for r in raw for i in range(len(r) - n + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("together", [2_000, 3])
def test_run_length_index(spark, vocabulary, monkeypatch, together):
    monkeypatch.setattr(run_length_index, "TOGETHER", together)
    monkeypatch.setattr(run_length_index, "INDEX_BYTES", 20_000)
    monkeypatch.setattr(run_length_index, "SHARD_WINDOWS", 2_000)
    rng = random.Random(10)
    passages = [prose(rng, n, vocabulary) for n in (70, 90, 200, 120)]
    texts = []
    for _ in range(60):
        parts = [prose(rng, rng.randint(0, 60), vocabulary)]
        for _ in range(rng.randint(0, 3)):
            cut = rng.choice(passages)
            if rng.random() < 0.5:
                at = rng.randrange(len(cut))
                cut = cut[:at] + "#" + cut[at + 1 :]
            parts += [cut, prose(rng, rng.randint(0, 40), vocabulary)]
        texts.append(" ".join(parts))
    texts += [None, "", "ü" * 900, "ab" * 600, texts[0], texts[0]]
    found = run_length_index.remove_repeats(corpus(spark, texts, ids=[*range(len(texts) - 1), None])).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found}
    for i, want in zip([*range(len(texts) - 1), None], repeats(texts)):
        assert got[i] == want
    assert run_length_index.remove_repeats(corpus(spark, texts).limit(0)).count() == 0


def test_mixing(spark, monkeypatch):
    rng = random.Random(11)
    texts = [" ".join(["w"] * rng.randint(0, 40)) for _ in range(400)] + [None, ""]
    sources = [rng.choice(["a", "b", "c", "d", None]) for _ in texts]
    docs = corpus(spark, texts, sources=sources)
    plain = mixing.mix(docs).orderBy("doc_id").collect()
    assert plain == mixing.mix(docs.repartition(7)).orderBy("doc_id").collect()
    sizes = [len((t or "").split()) for t in texts]
    by = {s: sum(n for n, x in zip(sizes, sources) if x == s) for s in set(sources)}
    weight = dict(zip([*sorted(s for s in by if s), None], itertools.cycle((3, 1, 2))))
    target, left, free = {}, 1.5 * sum(sizes), set(by)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * by[s]}
        target |= {s: 2 * by[s] for s in full} if full else share
        left -= sum(2 * by[s] for s in full)
        free = free - full if full else set()
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    for rows in (plain, mixing.mix(docs).collect()):
        taken = Counter()
        for r in rows:
            assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == by[sources[r["doc_id"]]]
            assert r["target"] == pytest.approx(target[sources[r["doc_id"]]]) and 0 <= r["taken"] <= 2 * r["size"]
            taken[sources[r["doc_id"]]] += r["taken"]
        assert all(abs(taken[s] - target[s]) <= 40 for s in by)
    copies = mixing.repeat(docs, mixing.mix(docs))
    assert copies.columns == docs.columns and copies.count() == sum(r["copies"] for r in mixing.mix(docs).collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_pairs_keep_words_and_expectations():
    sizes, parts = np.array([50.0, 20, 20, 10, 5]), np.full(5, 0.3)
    drawn = [mixing._pair_up(sizes, parts, np.random.default_rng(s)) for s in range(4000)]
    assert all(abs(float(d @ sizes) - 0.3 * sizes.sum()) < 1e-6 and sum(0 < x < 1 for x in d) <= 1 for d in drawn)
    assert np.mean(drawn, axis=0) == pytest.approx(parts, abs=0.04)


def test_pipeline(spark, vocabulary, tmp_path):
    rng = random.Random(12)
    texts = ["\n".join(prose(rng, 20, vocabulary) for _ in range(4)) for _ in range(60)]
    texts += texts[:5] + ODD[:9]
    folder = str(tmp_path)
    corpus(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
    kept = {r["doc_id"] for r in docs.collect()}
    assert not kept & set(range(61, 65)) and len(kept) > 25  # one text left without lines stays for all of them
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    out = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == kept and out.filter("NOT decoded_ok").isEmpty()
