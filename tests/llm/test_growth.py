"""What an operator of the training-data pipeline moves must grow with its input."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quarry.llm import cover_tree, line_dedup, permutation_index


def test_words_are_moved_for_near_lines_alone(spark, monkeypatch):
    """Before, the words of all pairs that 64 bits let pass were shuffled: any two long lines with a common word."""
    chance = random.Random(5)
    long = [" ".join(["common", *(f"w{i}x{chance.randrange(10**9)}" for _ in range(300))]) for i in range(12)]
    near = " ".join(long[3].split()[:-20] + [f"other{i}" for i in range(20)])
    docs = spark.createDataFrame(list(enumerate([*long, near])), "doc_id long, text string")
    written, write = {}, line_dedup.materialize

    def record(df, name):
        made = write(df, name)
        written.setdefault(name, made)
        return made

    monkeypatch.setattr(line_dedup, "materialize", record)
    found = {r.doc_id: r.removed for r in line_dedup.report(docs).collect()}
    assert found == {i: "0" if i == 12 else "" for i in range(13)}
    pairs = spark.createDataFrame([(a, b) for a in range(13) for b in range(a)], "later long, earlier long")
    sets = line_dedup.line_table(docs).withColumn("set_key", F.col("doc_id"))
    written.clear()
    assert [tuple(r) for r in line_dedup._verified(docs, sets, pairs).collect()] == [(12, 3)]
    assert written["near-pairs"].count() <= 3 and written["compared-words"].count() <= 6


def test_packed_vectors_are_not_sent_to_the_driver(spark):
    """Before, either side of the join of packed trees was broadcast while its compressed files were below Spark's limit."""
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<double>")
    for found in (cover_tree.top_k(vectors, F.col("vec_id") == 5, 3), permutation_index.nearest(vectors, F.col("vec_id") == 5)):
        rows = found.collect()
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert rows and {r.query_id for r in rows} == {5}
