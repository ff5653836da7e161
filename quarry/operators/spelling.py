"""Spelling candidates: an approximate join of unknown tokens with the term dictionary.

Both joins below are blocked by keys that every true pair shares, so they lose nothing:

* edit distance up to two: two words within it meet in a string obtained by deleting at most
  two characters from each (of their first seven characters, if longer);
* similarity of 0.7: the letters of a common subsequence that makes up 70 % of both lengths occur in
  both words, so some of the rarest letters of one are among the rarest of the other (`similar_pairs`).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quarry.operators.ranking import top_k
from quarry.session import materialize

MAX_DISTANCE = 2
PREFIX = 7
CUTOFF = 0.7
MAX_CANDIDATES = 6
#: Common letters needed up to which a key of similar words holds four, three, two letters; beyond, one.
KEY_LETTERS = (12, 18, 28)


def _without_one(word: Column) -> Column:
    """All strings that lack one character of ``word``."""
    return F.transform(
        F.sequence(F.lit(1), F.length(word)),
        lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))),
    )


def _deletions(word: Column) -> Column:
    """``word``'s first characters with none, one or two of them left out."""
    head = F.left(word, F.lit(PREFIX))
    one = _without_one(head)
    two = F.flatten(
        F.transform(F.filter(one, lambda w: F.length(w) > 0), _without_one)
    )
    return F.array_distinct(F.concat(F.array(head), one, two))


def _swaps(word: Column) -> Column:
    """All (i, string) with the neighbouring characters i and i + 1 of ``word`` swapped."""
    return F.when(
        F.length(word) > 1,
        F.transform(
            F.sequence(F.lit(1), F.length(word) - 1),
            lambda i: F.struct(
                i.alias("i"),
                F.concat(
                    F.substring(word, F.lit(1), i - 1),
                    F.substring(word, i + 1, F.lit(1)),
                    F.substring(word, i, F.lit(1)),
                    F.substring(word, i + 2, F.length(word)),
                ).alias("w"),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<i:int,w:string>>"))


def _swap_and_edit(swap: Column, other: Column) -> Column:
    """Whether one edit outside the swapped pair leads from the swapped word to ``other``."""
    i, word = swap["i"], swap["w"]
    rest = F.length(word) - i + 1
    edit_after = (F.left(word, i + 1) == F.left(other, i + 1)) & (
        F.levenshtein(F.substr(word, i + 2), F.substr(other, i + 2), 1) >= 0
    )
    edit_before = (F.right(word, rest) == F.right(other, rest)) & (
        F.levenshtein(F.left(word, i - 1), F.left(other, F.length(other) - rest), 1) >= 0
    )
    return edit_after | edit_before


def edit_distance(a: Column, b: Column) -> Column:
    """Edits up to two, null beyond; a swap of neighbours counts as one, and no character is
    edited twice."""
    plain = F.levenshtein(a, b, MAX_DISTANCE)
    swapped = F.transform(_swaps(a), lambda s: s["w"])
    return (
        F.when((plain >= 0) & (plain <= 1), plain)
        .when(F.array_contains(swapped, b), 1)
        .when(plain == 2, 2)
        .when(F.exists(_swaps(a), lambda s: _swap_and_edit(s, b)), 2)
        .when(F.arrays_overlap(swapped, F.transform(_swaps(b), lambda s: s["w"])), 2)
    )


def near_terms(unknown: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Pairs (token, term, distance) within two edits."""
    typed = unknown.select("token", F.explode(_deletions(F.col("token"))).alias("key"))
    terms = dictionary.select("term", F.explode(_deletions(F.col("term"))).alias("key"))
    pairs = (
        typed.join(terms, "key")
        .filter(F.abs(F.length("token") - F.length("term")) <= MAX_DISTANCE)
        .select("token", "term")
        .distinct()
    )
    return pairs.withColumn("distance", edit_distance(F.col("token"), F.col("term"))).filter(
        "distance is not null"
    )


def nearest_term(unknown: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The one term per token with the fewest edits, then the highest frequency."""
    pairs = near_terms(unknown, dictionary).join(dictionary, "term")
    order = F.struct("distance", -F.col("doc_freq"), "term")
    best = pairs.groupBy("token").agg(
        F.min_by(F.struct("term", "distance", "doc_freq", "term_type"), order).alias("best")
    )
    return best.select("token", "best.*").withColumns(
        {
            "raw_score": F.greatest(F.lit(0.0), 1 - F.col("distance") / F.length("token")),
            "source": F.lit("edit_distance"),
        }
    )


@F.pandas_udf(DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Twice the longest common subsequence over the summed lengths."""

    def common(a: str, b: str) -> int:
        masks: dict[str, int] = {}
        for i, ch in enumerate(a):
            masks[ch] = masks.get(ch, 0) | (1 << i)
        full = (1 << len(a)) - 1
        row = full
        for ch in b:
            hit = row & masks.get(ch, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(a) - row.bit_count()

    return pd.Series(
        [2.0 * common(a, b) / (len(a) + len(b)) for a, b in zip(left, right)], dtype="float64"
    )


def _letters(word: Column) -> Column:
    """The letters of ``word``, each with the number of its occurrence, so that none is repeated."""
    return F.transform(
        F.sequence(F.lit(1), F.length(word)),
        lambda i: F.concat(
            F.substring(word, i, F.lit(1)),
            i - F.length(F.replace(F.left(word, i), F.substring(word, i, F.lit(1)), F.lit(""))),
        ),
    )


def _neighbours(word: Column) -> Column:
    """The pairs of neighbouring letters of ``word`` with its ends marked, repeats included."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(2)))


def _choices(letters: Column, needed: Column, count: int) -> Column:
    """All ways to take ``count`` of the first letters that two words of ``needed`` common ones must share."""
    size = F.array_size(letters) - needed + count
    chosen = F.array(F.struct(F.lit(0).alias("next"), F.lit("").alias("key")))
    for nth in range(count):
        chosen = F.flatten(
            F.transform(
                chosen,
                lambda c: F.transform(
                    F.sequence(c["next"], size - (count - nth)),
                    lambda j: F.struct(
                        (j + 1).alias("next"), F.concat(c["key"], F.get(letters, j)).alias("key")
                    ),
                ),
            )
        )
    return F.transform(chosen, lambda c: c["key"])


def _needed(a: Column, b: Column) -> Column:
    """Length of the common subsequence that words of these lengths need for the similarity."""
    return F.ceil((a + b) * (CUTOFF / 2) - 1e-9).cast("int")


def _taken(needed: Column) -> Column:
    """Letters in a key: fewer for long words, which are rare and could be cut in very many ways."""
    wanted = F.lit(len(KEY_LETTERS) + 1) - sum(
        ((needed > longest).cast("int") for longest in KEY_LETTERS), F.lit(0)
    )
    return F.least(wanted, needed)


def _similarity_keys(words: DataFrame, name: str, letters: DataFrame) -> DataFrame:
    """(word, needed, key): the choices of a word for every length a common subsequence can need."""
    ordered = (
        words.select(name, F.explode(_letters(F.col(name))).alias("letter"))
        .join(letters, "letter", "left")
        .groupBy(name)
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "letter"))).alias("found"))
        .select(name, F.col("found.letter").alias("letters"), F.length(name).alias("length"))
    )
    fewest = _needed(F.col("length"), F.ceil(F.col("length") * CUTOFF / (2 - CUTOFF) - 1e-9))
    each = ordered.withColumn("needed", F.explode(F.sequence(fewest, F.col("length"))))
    choices = F.lit(None).cast("array<string>")
    for count in range(1, len(KEY_LETTERS) + 2):
        choices = F.when(
            _taken(F.col("needed")) == count, _choices(F.col("letters"), F.col("needed"), count)
        ).otherwise(choices)
    return each.select(name, "needed", F.explode(choices).alias("key"))


def similar_pairs(unknown: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Pairs (token, term) whose letters admit a similarity of 0.7; the similarity itself is left to check.

    Words of lengths a and b need a common subsequence of L = 0.35 (a + b) letters, rounded up. With the letters of
    every word in one order, rarest first, the first ``a - L + k`` of one and ``b - L + k`` of the other
    then share k letters; these and L are the join key. What meets so must have L letters in common, and of the L + 1
    pairs of neighbours in the padded common subsequence all but those that the a + b - 2 L other letters can part.
    """
    typed = unknown.select("token").filter("token != ''").distinct()
    terms = dictionary.select("term").filter("term != ''").distinct()
    letters = materialize(
        terms.select(F.explode(_letters(F.col("term"))).alias("letter")).groupBy("letter").agg(F.count("*").alias("n")),
        "term-letters",
    )
    met = (
        _similarity_keys(typed, "token", letters)
        .join(_similarity_keys(terms, "term", letters), ["needed", "key"])
        .filter(F.col("needed") == _needed(F.length("token"), F.length("term")))
        .groupBy("token", "term")
        .agg(F.max("needed").alias("needed"))
    )
    common = F.array_size(F.array_intersect(_letters(F.col("token")), _letters(F.col("term"))))
    left, right = _neighbours(F.col("token")), _neighbours(F.col("term"))
    repeats = F.least(*[F.array_size(p) - F.array_size(F.array_distinct(p)) for p in (left, right)])
    kept = 3 * F.col("needed") + 1 - F.length("token") - F.length("term")
    alike = F.array_size(F.array_intersect(left, right)) >= kept - repeats
    return met.filter((common >= F.col("needed")) & alike).select("token", "term")


def similar_terms(unknown: DataFrame, dictionary: DataFrame, limit: int = 2 * MAX_CANDIDATES) -> DataFrame:
    """Most similar terms per token among those of similarity 0.7 and more."""
    scored = similar_pairs(unknown, dictionary).withColumn("raw_score", similarity("token", "term"))
    best = top_k(
        scored.filter(F.col("raw_score") >= CUTOFF), ["token"], [F.desc("raw_score"), F.asc("term")], limit
    )
    return best.drop("rank").join(dictionary, "term").select(
        "token", "term",
        F.abs(F.length("token") - F.length("term")).alias("distance"),
        "doc_freq", "term_type", "raw_score", F.lit("similarity").alias("source"),
    )


def composite_score(
    token: Column, term: Column, doc_freq: Column, term_type: Column, wanted: Column, raw: Column
) -> Column:
    """Weighted evidence that ``term`` is what ``token`` was meant to be."""

    def ends(count: int, take) -> Column:
        return take(token, F.lit(count)) == take(term, F.lit(count))

    frequency = F.least(F.lit(1.0), F.log1p(doc_freq) / 4.5)
    kind = F.when(wanted.isNull() | (wanted == "token") | (term_type == wanted), 1.0).otherwise(0.75)
    prefix = F.when(ends(2, F.left), 1.0).when(ends(1, F.left), 0.82).otherwise(0.2)
    suffix = F.when(ends(2, F.right), 1.0).when(ends(1, F.right), 0.8).otherwise(0.35)
    length = 1 - F.abs(F.length(token) - F.length(term)) / F.greatest(F.length(token), F.length(term))
    return F.round(
        0.42 * F.least(raw, F.lit(1.0)) + 0.20 * frequency + 0.18 * kind
        + 0.10 * prefix + 0.05 * suffix + 0.05 * length,
        4,
    )


def suggest(unknown: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Ranked candidates per unknown token (token, wanted_type): by edits, else by similarity.

    Each step is written: a plan of them all would hold every step several times, with its broadcasts, on the driver.
    """
    unknown = materialize(unknown, "unknown-tokens")
    terms = dictionary.select("term", "doc_freq", "term_type").filter("term != ''")
    by_edits = materialize(nearest_term(unknown, terms), "nearest-terms")
    rest = materialize(unknown.join(by_edits.select("token"), "token", "left_anti"), "unmatched-tokens")
    similar = materialize(similar_terms(rest, terms), "similar-terms")
    candidates = by_edits.select(
        "token", "term", "distance", "doc_freq", "term_type", "raw_score", "source"
    ).unionByName(similar)
    scored = candidates.join(unknown, "token").withColumn(
        "score",
        composite_score(
            F.col("token"), F.col("term"), F.col("doc_freq"), F.col("term_type"),
            F.col("wanted_type"), F.col("raw_score"),
        ),
    )
    order = [F.desc("score"), F.asc("distance"), F.desc("doc_freq"), F.asc("term")]
    return top_k(scored, ["token"], order, MAX_CANDIDATES).drop("raw_score")
