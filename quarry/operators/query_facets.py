"""Rule-based facets of free-text queries: category, brand, model, attributes, numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import constants as K
from quarry.session import materialize

#: Characters of a phrase's beginning that it is looked up by.
HEAD = 3

# Patterns of the rules.
WORD = "([a-zа-я0-9]+(?:[.,][0-9]+)?)"
MODEL = r"(?U)\b([a-z][a-z0-9-]*\d+[a-z0-9-]*)\b"
GIGABYTES = r"(?U)\b(\d+(?:[.,]\d+)?)\s*(?:гб|gb)\b"
INCHES = r"(?U)\b(\d+(?:[.,]\d+)?)\s*(?:дюйм(?:а|ов)?|inch(?:es)?)\b"
LOOSE_NUMBER = r"(?U)\b(\d+(?:[.,]\d+)?)\b"


def plain(cell: Column) -> Column:
    """Lower-case text with single spaces and е for ё."""
    spaced = F.regexp_replace(F.coalesce(cell, F.lit("")), r"(?U)\s+", " ")
    return F.replace(F.lower(F.trim(spaced)), F.lit("ё"), F.lit("е"))


def _words(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(WORD), F.lit(1))


def _mentions(query: Column, keywords: list[str]) -> Column:
    found = F.lit(False)
    for keyword in keywords:
        found = found | F.contains(query, F.lit(keyword))
    return found


def _first_mentioned(query: Column, table: dict[str, list[str]]) -> Column:
    name = F.lit(None).cast("string")
    for value in reversed(list(table)):
        name = F.when(_mentions(query, table[value]), F.lit(value)).otherwise(name)
    return name


def _number(query: Column, pattern: str) -> Column:
    value = F.nullif(F.regexp_extract(query, pattern, 1), F.lit(""))
    return F.replace(value, F.lit(","), F.lit("."))


def catalog_phrases(catalog: DataFrame) -> DataFrame:
    """Distinct brands, models and categories as (kind, value, phrase)."""
    columns = {"brand": "manufacturer", "model": "model", "category": "category_name"}
    long = catalog.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in columns.items()]
            )
        ).alias("p")
    ).select("p.kind", "p.value")
    return long.distinct().withColumn("phrase", plain(F.col("value"))).filter("phrase != ''")


def _heads(value: Column, at: Column | int) -> Column:
    return F.array(*[F.substring(value, at, n) for n in range(1, HEAD + 1)])


def phrase_matches(queries: DataFrame, phrases: DataFrame) -> DataFrame:
    """(plain, kind, value) of every phrase that occurs in a query (plain).

    What is looked up are the beginnings of phrases, of HEAD characters, with the lengths that phrases of each have. A
    query is then cut at every place to just these lengths, and its pieces meet the phrases by their hash.
    No phrase is compared with a text that does not hold it, and no text is repeated for its places.
    """
    asked = queries.select("plain").distinct().withColumn("needle", F.monotonically_increasing_id())
    asked = materialize(asked, "needles")
    phrases = materialize(phrases.select("kind", "value", "phrase"), "phrases")
    places = F.sequence(F.lit(1), F.greatest(F.length("plain"), F.lit(1)))
    heads = asked.select("needle", F.explode(F.array_distinct(F.flatten(F.transform(places, lambda i: _heads(F.col("plain"), i))))).alias("head"))
    known = phrases.select(F.left("phrase", F.lit(HEAD)).alias("head"), F.length("phrase").alias("n")).distinct()
    lengths = materialize(known.groupBy("head").agg(F.collect_list("n").alias("lengths")), "phrase-lengths")
    cuts = heads.join(lengths, "head").groupBy("needle").agg(F.map_from_entries(F.collect_list(F.struct("head", "lengths"))).alias("cuts"))
    none = F.array().cast("array<int>")

    def pieces(i: Column) -> Column:
        by_head = F.transform(_heads(F.col("plain"), i), lambda h: F.coalesce(F.try_element_at("cuts", h), none))
        return F.transform(F.array_distinct(F.flatten(by_head)), lambda n: F.substring("plain", i, n))

    cut = asked.join(cuts, "needle").select("plain", F.explode(F.array_distinct(F.flatten(F.transform(places, pieces)))).alias("phrase"))
    keyed = [df.withColumn("hash", F.xxhash64("phrase")) for df in (cut, phrases)]
    return materialize(keyed[0].join(keyed[1], ["hash", "phrase"]).select("plain", "kind", "value"), "phrase-matches")


def contained_phrases(queries: DataFrame, phrases: DataFrame, first_categories: bool = True) -> DataFrame:
    """One phrase of each kind that occurs in a query: (plain, kind, value).

    Of brands and models it is the longest, ties the last by name; of categories the first in the catalogue's list, which
    is sorted by name, or with ``first_categories`` off the longest too.
    """
    found = phrase_matches(queries, phrases)
    longest = F.max_by("value", F.struct(F.length("value"), F.col("value")))
    value = F.when(F.col("kind") == "category", F.min("value")).otherwise(longest) if first_categories else longest
    return found.groupBy("plain", "kind").agg(value.alias("value"))


def extract_query_facets(queries: DataFrame, catalog: DataFrame, first_categories: bool = True) -> DataFrame:
    """(query_id, query) with detected category, brand, model, attributes, numbers, free text."""
    normalized = queries.select("query_id", "query", plain(F.col("query")).alias("plain"))
    found = contained_phrases(normalized.select("plain").distinct(), catalog_phrases(catalog), first_categories)
    by_kind = found.groupBy("plain").pivot("kind", ["brand", "model", "category"]).agg(F.first("value"))
    joined = normalized.join(by_kind, "plain", "left")
    query, words = F.col("plain"), _words(F.col("plain"))
    category = F.coalesce(_first_mentioned(query, K.CATEGORY_KEYWORDS), "category")
    model = F.coalesce(
        "model", F.nullif(F.upper(F.regexp_extract(query, MODEL, 1)), F.lit(""))
    )
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    brand = F.coalesce(
        "brand",
        F.when(first.rlike("^[a-zа-я]+$") & second.rlike(r"\d"), F.initcap(first)),
    )
    kinds = joined.select("query_id", "query", "plain", category.alias("detected_category"),
                          brand.alias("detected_brand"), model.alias("detected_model"))
    attributes = _some(
        {name: _first_mentioned(query, values) for name, values in K.ATTRIBUTE_KEYWORDS.items()}
    )
    loose = _number(query, LOOSE_NUMBER)
    memory = F.coalesce(
        _number(query, GIGABYTES),
        F.when(_mentions(query, ["оператив", "ram"]), loose),
    )
    diameter = F.coalesce(
        _number(query, INCHES), F.when(F.col("detected_category") == "шина", loose)
    )
    detected = kinds.withColumns(
        {
            "detected_attributes": attributes,
            "numeric_constraints": _some({"Память": memory, "Диаметр": diameter}),
        }
    )
    used = F.concat(
        F.array("detected_brand", "detected_model"),
        F.map_values("detected_attributes"), F.map_values("numeric_constraints"),
    )
    remainder = F.aggregate(
        F.filter(F.transform(used, plain), lambda v: v != ""),
        F.col("plain"),
        lambda text, value: F.replace(text, value, F.lit(" ")),
    )

    def long_words(value: Column) -> Column:
        return F.filter(_words(value), lambda w: F.length(w) > 1)

    left = long_words(remainder)
    free = F.when(F.size(left) > 0, left).otherwise(long_words(F.col("plain")))
    return detected.withColumns(
        {
            "free_text": F.nullif(F.array_join(free, " "), F.lit("")),
            "has_structured_data": F.coalesce(
                "detected_category", "detected_brand", "detected_model"
            ).isNotNull()
            | (F.size("detected_attributes") > 0)
            | (F.size("numeric_constraints") > 0),
        }
    ).drop("plain")


def _some(entries: dict[str, Column]) -> Column:
    """Map of the entries whose value is not null."""
    listed = F.array(
        *[F.struct(F.lit(name).alias("k"), value.alias("v")) for name, value in entries.items()]
    )
    return F.map_from_entries(F.filter(listed, lambda e: e["v"].isNotNull()))


def match_sentence(match_type: Column) -> Column:
    """Sentence that says what a result matched by."""
    sentence = F.lit(K.DEFAULT_MATCH_SENTENCE)
    for name, text in K.MATCH_SENTENCES.items():
        sentence = F.when(match_type == name, F.lit(text)).otherwise(sentence)
    return sentence
