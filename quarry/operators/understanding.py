"""Query understanding for whole query logs: layout, spelling, lemmas, synonyms.

Equal queries are understood once, and so are equal tokens; the results are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import spelling, vocabulary
from quarry.session import materialize

MAX_ALIASES = 4
NO_STRINGS = "array<string>"


def normalize_queries(queries: DataFrame) -> DataFrame:
    """(query_id, query) with normalised text, tokens and the numbers among them."""
    normalized = queries.withColumn("normalized_query", text.normalize(F.col("query")))
    tokenized = normalized.withColumn("tokens", text.tokens(F.col("normalized_query")))
    return tokenized.withColumn("numbers", numbers(F.col("tokens")))


def numbers(tokens: Column) -> Column:
    """Distinct numeric values found in the tokens, in order."""
    values = F.transform(tokens, lambda t: text.number_and_unit(t)["value"])
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull()))


def classify_tokens(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Distinct tokens with their type, whether protected, and whether the dictionary has them."""
    known = dictionary.select(
        F.col("term").alias("token"), F.col("term_type").alias("dictionary_type")
    )
    typed = (
        tokens.select("token").distinct()
        .join(known, "token", "left")
        .withColumn("token_type", text.requested_type(F.col("token"), F.col("dictionary_type")))
    )
    return typed.select(
        "token", "token_type",
        text.is_protected(F.col("token"), F.col("token_type")).alias("protected"),
        F.col("dictionary_type").isNotNull().alias("in_dictionary"),
    )


def fix_layout(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Tokens typed in the wrong layout: those whose other-layout form the dictionary has."""
    variants = tokens.select("token", text.layout_variant(F.col("token")).alias("term"))
    return (
        variants.filter("term is not null")
        .join(dictionary.select("term"), "term", "left_semi")
        .select(
            "token", F.col("term").alias("variant"),
            text.layout_direction(F.col("token")).alias("keyboard"),
        )
    )


def resolve_tokens(
    tokens: DataFrame, dictionary: DataFrame, known_words: DataFrame | None = None
) -> DataFrame:
    """One row per distinct token: its correction, soft expansion, lemma and candidates.

    ``known_words(word)`` lists words that are right although the dictionary lacks them.
    What several steps read is written, so that the driver never plans more than one of them at a time.
    """
    classified = materialize(classify_tokens(tokens, dictionary), "classified-tokens")
    layout = fix_layout(classified, dictionary)
    if known_words is None:
        checked = classified.withColumn("known_word", F.lit(False))
    else:
        words = known_words.select(F.col("word").alias("token")).distinct()
        checked = classified.join(
            words.withColumn("known_word", F.lit(True)), "token", "left"
        ).withColumn("known_word", F.coalesce("known_word", F.lit(False)))
    typed = checked.join(layout, "token", "left").withColumn(
        "resolved", F.coalesce("variant", "token")
    )
    typed = materialize(typed, "typed-tokens")
    unknown = typed.filter(
        ~F.col("protected") & ~F.col("in_dictionary") & F.col("variant").isNull()
    ).select("token", F.col("token_type").alias("wanted_type"))
    candidates = spelling.suggest(unknown, dictionary).groupBy("token").agg(
        F.array_sort(
            F.collect_list(
                F.struct("rank", "term", "score", "distance", "doc_freq", "term_type", "source")
            )
        ).alias("candidates")
    )
    candidates = materialize(candidates, "spell-candidates")
    with_best = typed.join(candidates, "token", "left").withColumn(
        "best", F.get("candidates", F.lit(0))
    )
    moded = with_best.withColumn("mode", correction_mode(F.col("token"), F.col("best"), F.col("known_word")))
    corrected = moded.withColumn(
        "resolved", F.when(F.col("mode") == "strong", F.col("best.term")).otherwise(F.col("resolved"))
    )
    types = dictionary.select(F.col("term").alias("resolved"), F.col("term_type").alias("resolved_type"))
    final = corrected.join(types, "resolved", "left").withColumn(
        "resolved_type", F.coalesce("resolved_type", "token_type")
    )
    return final.withColumn(
        "lemma", text.lemma(F.col("resolved"), F.col("resolved_type"))
    )


def correction_mode(token: Column, best: Column, known_word: Column) -> Column:
    """``strong``: replace the token; ``soft``: search for both; ``exact``: leave it."""
    term, size_gap = best["term"], F.abs(F.length(token) - F.length(best["term"]))
    needed = F.when((best["distance"] <= 1) | (best["term_type"] == "brand"), 0.75).otherwise(0.82)
    same_start = (F.left(token, F.lit(1)) == F.left(term, F.lit(1))) & (size_gap <= 2)
    long_miss = (
        (F.length(token) >= 6)
        & (best["distance"] > 1)
        & (F.left(token, F.lit(2)) != F.left(term, F.lit(2)))
    )
    known_miss = known_word & (F.left(token, F.lit(3)) != F.left(term, F.lit(3)))
    return (
        F.when(best.isNull(), "exact")
        .when((best["score"] >= needed) & same_start & ~known_word & ~long_miss, "strong")
        .when((best["score"] >= 0.68) & same_start & ~known_miss, "soft")
        .otherwise("exact")
    )


def expand_synonyms(words: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct words with their canonical form and up to four of its aliases."""
    lookup = vocabulary.expansion_lookup(rules)
    return (
        words.select("word").distinct()
        .join(lookup, "word", "left")
        .select(
            "word",
            F.coalesce("canonical", "word").alias("canonical"),
            F.slice(F.coalesce("aliases", F.array().cast(NO_STRINGS)), 1, MAX_ALIASES).alias("aliases"),
        )
    )


def token_plan(resolved: DataFrame, rules: DataFrame) -> DataFrame:
    """Resolved tokens with the words they search for, each expanded by its synonyms."""
    words = F.filter(
        F.array(
            F.when(F.col("mode") == "soft", F.col("best.term")),
            F.when(F.col("lemma") != F.col("resolved"), F.col("lemma")),
            F.col("resolved"),
            F.when(F.col("mode") == "soft", F.col("token")),
        ),
        lambda w: w.isNotNull(),
    )
    searched = resolved.select("token", F.posexplode(words).alias("place", "word"))
    expanded = searched.join(expand_synonyms(searched, rules), "word")
    forms = expanded.groupBy("token").agg(
        F.array_sort(
            F.collect_list(F.struct("place", "word", "canonical", "aliases"))
        ).alias("forms")
    )
    return resolved.join(forms, "token", "left")


def understand_queries(
    queries: DataFrame,
    dictionary: DataFrame,
    rules: DataFrame,
    known_words: DataFrame | None = None,
) -> DataFrame:
    """Every query of (query_id, query, …) with its interpretation."""
    normalized = normalize_queries(queries)
    texts = normalized.select("normalized_query", "tokens").distinct()
    positions = texts.select("normalized_query", F.posexplode("tokens").alias("pos", "token"))
    tokens = materialize(positions.select("token").distinct(), "query-tokens")
    resolved = materialize(resolve_tokens(tokens, dictionary, known_words), "resolved-tokens")
    plan = token_plan(resolved, rules)
    plan = materialize(
        plan.select(
            "token", "protected", "variant", "keyboard", "mode", "best", "resolved", "lemma",
            "candidates", "forms",
        ),
        "query-token-plan",
    )
    parts = positions.join(plan, "token").groupBy("normalized_query").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "pos", "token", "protected", "variant", "keyboard", "mode", "best",
                    "resolved", "lemma", "candidates", "forms",
                )
            )
        ).alias("parts")
    )
    return assemble(normalized.join(parts, "normalized_query", "left"))


def assemble(joined: DataFrame) -> DataFrame:
    """Interpretation columns of queries whose resolved tokens are in ``parts``."""
    forms = F.flatten(F.transform("parts", lambda p: p["forms"]))
    searched = F.array_distinct(
        F.flatten(
            F.transform(forms, lambda f: F.concat(F.array(f["canonical"]), f["aliases"]))
        )
    )
    mapped = F.filter(forms, lambda f: f["canonical"] != f["word"])

    def chosen(condition, *fields):
        return F.transform(
            F.filter("parts", condition), lambda p: F.struct(*[e(p).alias(n) for n, e in fields])
        )

    corrected = F.transform("parts", lambda p: p["resolved"])
    keep = [c for c in joined.columns if c not in ("parts", "tokens", "numbers")]
    full = joined.select(
        *keep, "numbers",
        corrected.alias("corrected_tokens"),
        searched.alias("searched"),
        F.transform(
            F.filter("parts", lambda p: p["protected"]), lambda p: p["token"]
        ).alias("protected_tokens"),
        F.array_distinct(
            F.transform(mapped, lambda f: F.concat_ws(" -> ", f["word"], f["canonical"]))
        ).alias("applied_synonyms"),
        F.transform(
            mapped, lambda f: F.struct(f["word"].alias("from"), f["canonical"].alias("to"))
        ).alias("synonym_mappings"),
        chosen(
            lambda p: p["variant"].isNotNull(),
            ("from", lambda p: p["token"]), ("to", lambda p: p["variant"]),
            ("keyboard", lambda p: p["keyboard"]),
        ).alias("layout_mappings"),
        chosen(
            lambda p: p["mode"] == "strong",
            ("from", lambda p: p["token"]), ("to", lambda p: p["best"]["term"]),
            ("score", lambda p: p["best"]["score"]),
        ).alias("typo_mappings"),
        chosen(
            lambda p: p["lemma"] != p["resolved"],
            ("from", lambda p: p["resolved"]), ("to", lambda p: p["lemma"]),
        ).alias("lemma_mappings"),
        chosen(
            lambda p: p["candidates"].isNotNull(),
            ("token", lambda p: p["token"]), ("candidates", lambda p: p["candidates"]),
        ).alias("spell_candidates"),
    )
    retrieval = text.tokenize(F.array_join("searched", " "))
    empty = F.array().cast(NO_STRINGS)
    return full.select(
        *keep,
        F.array_join(F.coalesce("corrected_tokens", empty), " ").alias("corrected_query"),
        F.coalesce("corrected_tokens", empty).alias("corrected_tokens"),
        F.coalesce(
            F.when(F.size(retrieval) > 0, retrieval), F.col("searched"), empty
        ).alias("retrieval_tokens"),
        F.coalesce("protected_tokens", empty).alias("protected_tokens"),
        F.coalesce("applied_synonyms", empty).alias("applied_synonyms"),
        F.array_distinct(
            F.concat("numbers", F.coalesce(numbers(F.col("corrected_tokens")), F.array().cast("array<double>")))
        ).alias("numeric_tokens"),
        "layout_mappings", "typo_mappings", "synonym_mappings", "lemma_mappings",
        "spell_candidates",
    )
