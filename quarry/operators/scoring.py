"""Transparent search score: factors, gate, explanation."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import constants as K
from quarry.functions import text, weights
from quarry.operators.ranking import spread_join


@dataclass(frozen=True)
class Overlay:
    """What is known about customers and sessions; any part may be missing."""

    product_weights: DataFrame | None = None
    category_weights: DataFrame | None = None
    profiles: DataFrame | None = None
    session_products: DataFrame | None = None
    session_categories: DataFrame | None = None


def _left_join(df: DataFrame, table: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Left join in which rows without a key stay where they are, instead of meeting in one task."""
    known = functools.reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    without = df.filter(~known).select("*", *[F.lit(None).cast(table.schema[n].dataType).alias(n) for n in names])
    return df.filter(known).join(table, keys, "left").unionByName(without)


def _as_map(table: DataFrame, owner: str, key: str, name: str) -> DataFrame:
    """(owner, name): an owner's weights as one map. Its keys are categories, or products of one session's last events."""
    entries = F.collect_list(F.struct(key, "weight"))
    return table.groupBy(owner).agg(F.map_from_entries(entries).alias(name))


MAPS = {
    "category_weights": ("customer_inn", "category_norm", "of_category"),
    "session_products": ("session_id", "ste_id", "of_session_product"),
    "session_categories": ("session_id", "category_norm", "of_session_category"),
}


def with_weight_maps(queries: DataFrame, overlay: Overlay) -> DataFrame:
    """Queries with what their customer and session weigh, as maps: narrow tables meet here, not candidates."""
    for part, (owner, key, name) in MAPS.items():
        table = getattr(overlay, part)
        if table is not None and owner in queries.columns:
            queries = _left_join(queries, _as_map(table, owner, key, name), [owner], [name])
    return queries


def with_product_weights(candidates: DataFrame, overlay: Overlay) -> DataFrame:
    """Narrow candidates (…, customer_inn, ste_id) with ``w_product``, 0 where the customer has not bought the product."""
    if overlay.product_weights is None or "customer_inn" not in candidates.columns:
        return candidates.withColumn("w_product", F.lit(0.0))
    weights_ = overlay.product_weights.select("customer_inn", "ste_id", F.col("weight").alias("w_product"))
    return _left_join(candidates, weights_, ["customer_inn", "ste_id"], ["w_product"]).fillna(0.0, ["w_product"])


def with_bought(asked: DataFrame, pairs: DataFrame, overlay: Overlay, most: int) -> DataFrame:
    """Queries (ask, text, customer_inn, …) with ``of_product``: what their customer's purchases weigh among the candidates of
    their text, as a map. ``pairs`` (text, ste_id) are these, at most ``most`` to a text.

    Purchases, which are few, come to the candidates of a text; only customers with more than ``most`` of them have their candidates
    listed and brought to their purchases, so neither side makes more than ``most`` rows for a query.
    """
    if overlay.product_weights is None or "customer_inn" not in asked.columns:
        return asked
    weighed = overlay.product_weights.select("customer_inn", "ste_id", "weight")
    many = weighed.groupBy("customer_inn").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("customer_inn")
    owners = asked.filter("customer_inn IS NOT NULL").select("ask", "text", "customer_inn")
    few = owners.join(many, "customer_inn", "left_anti").join(weighed, "customer_inn").join(pairs, ["text", "ste_id"], "left_semi")
    listed = spread_join(owners.join(many, "customer_inn", "left_semi"), pairs, "text", "ask").join(weighed, ["customer_inn", "ste_id"])
    found = few.select("ask", "ste_id", "weight").unionByName(listed.select("ask", "ste_id", "weight"))
    return asked.join(_as_map(found, "ask", "ste_id", "of_product"), "ask", "left")


def personalise(candidates: DataFrame) -> DataFrame:
    """Candidates of ``with_weight_maps``' queries with the weights of their product, category and session, 0 where there are none."""
    columns = {"w_product": ("of_product", "ste_id"), "w_category": ("of_category", "category_norm"), "s_product": ("of_session_product", "ste_id"), "s_category": ("of_session_category", "category_norm")}
    found = {
        name: F.coalesce(F.try_element_at(F.col(held), F.col(key)), F.lit(0.0)) if held in candidates.columns else F.lit(0.0)
        for name, (held, key) in columns.items() if name not in candidates.columns
    }
    return candidates.withColumns(found).drop(*[held for held, _ in columns.values()])


def with_profile_tokens(queries: DataFrame, overlay: Overlay) -> DataFrame:
    """Queries with those of their tokens that the customer's profile weighs, and the weights."""
    none = F.lit(None).cast("array<struct<value:string,weight:double>>")
    if overlay.profiles is None or "customer_inn" not in queries.columns:
        return queries.withColumn("profile_tokens", none)
    known = overlay.profiles.select(
        "customer_inn", F.map_from_entries("token_weights").alias("known")
    )
    weighed = F.filter(
        F.transform(
            "retrieval_tokens",
            lambda q: F.struct(q.alias("value"), F.try_element_at("known", q).alias("weight")),
        ),
        lambda item: item["weight"] > 0,
    )
    found = _left_join(queries, known, ["customer_inn"], ["known"])
    return found.withColumn("profile_tokens", F.when(F.col("known").isNotNull(), weighed)).drop("known")


def with_match_columns(products: DataFrame) -> DataFrame:
    """Products with what scoring needs of them, worked out once: attributes without repeats
    and the lemmas of title, category and attributes."""
    words = F.concat(
        F.col("title_tokens"), text.tokens(F.col("category_norm")),
        text.tokenize(F.col("attributes_raw")),
    )
    attributes = text.dedupe_attributes(F.col("attributes"))
    return products.withColumns(
        {
            "attributes": attributes,
            "attribute_texts": F.transform(
                attributes, lambda a: F.concat_ws("\n", a["name_norm"], a["value_norm"])
            ),
            "lemmas": F.array_distinct(F.transform(words, lambda t: text.lemma(t, F.lit("token")))),
        }
    )


def match_columns(candidates: DataFrame) -> DataFrame:
    """What a query and a product have in common, as plain columns; ``said`` are the query's tokens that its texts hold."""
    query = F.col("retrieval_tokens")
    hit_attributes = F.filter(
        "attribute_texts", lambda a: F.exists(query, lambda q: F.contains(a, q))
    )
    hit_numbers = F.filter(
        "numeric_tokens",
        lambda x: F.exists(
            "attributes",
            lambda a: F.coalesce(F.abs(a["numeric_value"] - x) <= 0.01, F.lit(False)),
        ),
    )
    synonym_hits = F.filter(
        "synonym_mappings",
        lambda m: F.contains(F.col("search_text"), m["to"])
        | F.contains(F.col("title_norm"), m["to"])
        | F.contains(F.col("category_norm"), m["to"]),
    )
    query_lemmas = F.array_union(
        F.transform("lemma_mappings", lambda m: m["to"]), F.col("corrected_tokens")
    )
    said = F.filter(
        F.array_distinct(query),
        lambda q: F.contains(F.col("search_text"), q) | F.contains(F.col("title_norm"), q) | F.contains(F.col("category_norm"), q),
    )
    title = F.array_intersect("title_tokens", query)
    return candidates.withColumns(
        {
            "m_phrase": (F.col("corrected_query") != "")
            & F.contains(F.col("title_norm"), F.col("corrected_query")),
            "m_title": title,
            "n_title": F.size(title),
            "m_category": F.exists(query, lambda q: F.contains(F.col("category_norm"), q)),
            "m_attributes": hit_attributes,
            "n_attributes": F.size(hit_attributes),
            "m_numbers": F.size(hit_numbers),
            "m_synonyms": F.size(synonym_hits),
            "m_lemmas": F.size(F.array_intersect(query_lemmas, F.col("lemmas"))),
            "said": said,
        }
    )


#: Of these columns those that scores are made of; they are narrow.
MATCHES = ["m_phrase", "n_title", "m_category", "n_attributes", "m_numbers", "m_synonyms", "m_lemmas", "said"]


def search_factors(matched: DataFrame, lexical_mode: str = "reciprocal") -> DataFrame:
    """The summands of the search score, one ``f_`` column each."""
    title_hits, attribute_hits = F.col("n_title"), F.col("n_attributes")
    phrase = F.col("m_phrase").cast("int")
    category = F.col("m_category").cast("int")
    numbers = F.col("m_numbers")
    gated = matched.withColumn(
        "gate",
        F.least(
            F.lit(1.0),
            0.2 + 0.16 * title_hits + 0.12 * attribute_hits + 0.18 * numbers
            + 0.18 * phrase + 0.12 * category,
        ),
    )
    gate = F.col("gate")
    found = F.filter("profile_tokens", lambda item: F.array_contains("said", item["value"]))
    with_tokens = gated.withColumn("m_profile", found)
    token_sum = F.coalesce(
        F.aggregate(
            "m_profile",
            F.lit(0.0),
            lambda acc, item: acc + F.least(F.lit(0.16), 0.015 * item["weight"]),
        ),
        F.lit(0.0),
    )
    return with_tokens.withColumns(
        {
            "lexical": weights.lexical_score(F.col("bm25"), lexical_mode),
            "f_lexical": 2 * weights.lexical_score(F.col("bm25"), lexical_mode),
            "f_phrase": 1.2 * phrase,
            "f_title": F.least(F.lit(0.9), 0.18 * title_hits),
            "f_category": 0.6 * category,
            "f_attributes": F.least(F.lit(1.2), 0.25 * attribute_hits),
            "f_numbers": F.least(F.lit(1.0), 0.5 * numbers),
            "f_history_product": F.when(
                F.col("w_product") > 0,
                F.least(F.lit(0.75), 0.28 * F.log1p("w_product")) * gate,
            ).otherwise(0.0),
            "f_history_category": F.when(
                F.col("w_category") > 0,
                F.least(F.lit(0.55), 0.14 * F.log1p("w_category")) * F.greatest(F.lit(0.45), gate),
            ).otherwise(0.0),
            "f_history_tokens": F.least(F.lit(0.45), token_sum) * F.greatest(F.lit(0.55), gate),
        }
    )


SEARCH_FACTORS = [
    "f_lexical", "f_phrase", "f_title", "f_category", "f_attributes", "f_numbers",
    "f_history_product", "f_history_category", "f_history_tokens", "s_product", "s_category",
]


def score_candidates(matched: DataFrame, lexical_mode: str = "reciprocal") -> DataFrame:
    """Candidates of ``match_columns`` and ``personalise`` with ``score``; without an overlay all history and session parts are 0."""
    factors = search_factors(matched, lexical_mode)
    total = sum((F.col(f) for f in SEARCH_FACTORS[1:]), F.col(SEARCH_FACTORS[0]))
    return factors.withColumn("heuristic", total).withColumn("score", F.round("heuristic", 6))


def ranking_features() -> Column:
    """The fifteen inputs of the learned ranker for searches, in fixed order."""
    return F.array(
        *[
            c.cast("double")
            for c in (
                F.col("heuristic"), F.col("lexical"), F.col("m_phrase"), F.col("n_title"),
                F.col("m_lemmas"), F.col("m_synonyms"), F.col("m_category"),
                F.col("n_attributes"), F.col("m_numbers"), F.col("f_history_product"),
                F.col("f_history_category"), F.col("f_history_tokens"), F.col("s_product"),
                F.col("s_category"), F.lit(0.0),
            )
        ]
    )


def _factor(kind: str, value: Column, reason: Column) -> Column:
    rounded = F.round(value, 4)
    return F.when(
        rounded != 0,
        F.struct(F.lit(kind).alias("type"), rounded.alias("value"), reason.alias("reason")),
    )


def _up_or_down(value: Column, reasons: dict[str, str], name: str) -> Column:
    return F.when(value > 0, reasons[f"{name}_up"]).otherwise(reasons[f"{name}_down"])


def join_reasons(factors: Column, fallback: str) -> Column:
    listed = F.array_join(F.transform(F.slice(factors, 1, 4), lambda f: f["reason"]), "; ")
    return F.coalesce(F.nullif(listed, F.lit("")), F.lit(fallback))


def explain(scored: DataFrame) -> DataFrame:
    """Scored candidates with their factors and a one-line explanation."""
    say = {name: F.lit(sentence) for name, sentence in K.SEARCH_REASONS.items()}
    named = F.filter(
        "attributes",
        lambda a, i: F.array_contains("m_attributes", F.get("attribute_texts", i)),
    )
    attribute_names = F.array_join(
        F.transform(
            F.slice(named, 1, 3), lambda a: F.concat_ws("=", a["name_raw"], a["value_raw"])
        ),
        "; ",
    )
    factors = F.array_compact(
        F.array(
            _factor("lexical", F.col("f_lexical"), say["lexical"]),
            _factor("title_phrase", F.col("f_phrase"), say["title_phrase"]),
            _factor(
                "token_overlap", F.col("f_title"),
                F.concat(
                    say["token_overlap"],
                    F.array_join(F.slice(F.array_sort("m_title"), 1, 6), ", "),
                ),
            ),
            _factor("category", F.col("f_category"), F.concat(say["category"], "category_raw")),
            _factor("attributes", F.col("f_attributes"), F.concat(say["attributes"], attribute_names)),
            _factor(
                "numeric", F.col("f_numbers"),
                F.concat(say["numeric"], F.col("m_numbers").cast("string")),
            ),
            _factor("history_product", F.col("f_history_product"), say["history_product"]),
            _factor("history_category", F.col("f_history_category"), say["history_category"]),
            _factor(
                "history_tokens", F.col("f_history_tokens"),
                F.concat(say["history_tokens"], F.array_join(F.transform(F.slice("m_profile", 1, 5), lambda item: item["value"]), ", ")),
            ),
            _factor(
                "session_product", F.col("s_product"),
                _up_or_down(F.col("s_product"), K.SEARCH_REASONS, "session_product"),
            ),
            _factor(
                "session_category", F.col("s_category"),
                _up_or_down(F.col("s_category"), K.SEARCH_REASONS, "session_category"),
            ),
        )
    )
    return scored.withColumn("factors", factors).withColumn(
        "explanation", join_reasons(F.col("factors"), K.SEARCH_REASONS["none"])
    )
