"""Clashing names, many equal rows, rows without id, many languages, long samples, missing files."""

from __future__ import annotations

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import kneser_ney, language, line_dedup, mixing, run_length_index, similar, toxicity
from tests.llm.test_operators import corpus, prose, repeats

CLASHING = [
    "removed", "repeated_text", "removed_from", "removed_doc", "first_id", "first_hash", "mix_key", "mix_copies", "mix_row", "copies",
    "row", "whole_row", "key", "text_hash", "text_key", "row_key", "least_key", "equal_rows", "copy", "col", "set_key", "line", "doc",
]


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(55)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(150)]


def test_stages_keep_columns_of_any_name(spark, vocabulary):
    rng = random.Random(56)
    texts = [prose(rng, 40, vocabulary) for _ in range(8)]
    texts += [texts[0], texts[1] + " end", None, ""]
    docs = corpus(spark, texts, ids=[*range(10), None, None]).select("doc_id", "text", "source", "n_chars")
    docs = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    for stage in (line_dedup.dedup, similar.first_of_each, lambda d: mixing.repeat(d, mixing.mix(d))):
        out = stage(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHING)


def test_mixing_rows_without_id_and_equal_rows(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rng = random.Random(57)
    texts = [prose(rng, rng.randint(1, 60), vocabulary) for _ in range(300)]
    texts += ["the same text for all of these"] * 400 + [None] * 20
    ids = [None] * 200 + [7] * 100 + [None] * 420
    docs = corpus(spark, texts, ids=ids)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts) and all(r["taken"] == r["copies"] * r["size"] and r["taken"] <= 2 * r["size"] for r in rows)
    taken, target = Counter(), {}
    for r in rows:
        taken[r["target"]] += r["taken"]
        target[r["target"]] = r["target"]
    assert all(abs(taken[t] - t) <= 60 for t in target)
    assert Counter((r["key"], r["taken"]) for r in rows) == Counter((r["key"], r["taken"]) for r in mixing.mix(docs.repartition(7)).collect())
    assert mixing.repeat(docs, mixing.mix(docs)).count() == sum(r["copies"] for r in rows)


def test_equal_rows_go_to_an_index_once(spark, vocabulary):
    rng = random.Random(58)
    passage = prose(rng, 120, vocabulary)
    one, other = prose(rng, 50, vocabulary) + passage + " x", "y " + passage + prose(rng, 40, vocabulary)
    texts = [one] * 200 + [other, prose(rng, 150, vocabulary)]
    found = run_length_index.remove_repeats(corpus(spark, texts, ids=[1] * 200 + [2, 3])).collect()
    mine = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found)
    assert mine == sorted(tuple(x[:4]) for x in repeats(texts))


def test_many_languages_are_cut_to_the_most_frequent(spark):
    texts, langs = [], []
    for i in range(300):
        texts += [f"wort{i} " * 5] * (2 if i < 3 else 1)
        langs += [f"l{i:03}"] * (2 if i < 3 else 1)
    names, table = language.train(corpus(spark, texts, langs=langs), most=4)
    assert names == ["l000", "l001", "l002", "l003"] and table.shape[1] == 4


def test_long_labelled_rows_are_learned_from(spark, vocabulary):
    rng = random.Random(59)
    texts, toxic = [], []
    for i in range(60):
        words = prose(rng, 4500, vocabulary).split()
        toxic.append(i % 2)
        if toxic[-1]:
            for place in range(0, 4500, 12):
                words[place] = rng.choice(["blockhead", "nitwitted", "dunderly"])
        texts.append(" ".join(words))
    assert min(map(len, texts)) > toxicity.SAMPLE_CHARS
    docs = corpus(spark, texts + [texts[1]] * 5, ids=[*range(60), *[1] * 5])
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert sum(r["predicted"] == toxic[r["doc_id"]] for r in found) >= 0.95 * len(found)


def test_a_missing_file_of_the_model_is_an_error(spark, vocabulary):
    rng = random.Random(60)
    docs = corpus(spark, [prose(rng, 30, vocabulary) for _ in range(20)]).withColumn("held_out", F.lit(False))
    model = kneser_ney.train(docs)
    os.rename(f"{model.folder}/key-0.npy", f"{model.folder}/elsewhere.npy")
    with pytest.raises(Exception, match="key-0.npy"):
        kneser_ney.score(docs, model).collect()
