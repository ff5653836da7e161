"""Lexicon, term dictionary, synonyms and search text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import constants as K
from quarry.functions import text
from quarry.operators.ranking import top_k
from quarry.session import materialize


def seed_synonyms(spark: SparkSession) -> DataFrame:
    """Seed pairs (alias, canonical), normalised and distinct, with canonical → itself."""
    pairs = list(K.SEED_SYNONYMS.items())
    for canonical, members in K.SEED_GROUPS.items():
        pairs += [(canonical, canonical)] + [(alias, canonical) for alias in members]
    rows = spark.createDataFrame(pairs, "alias string, canonical string")
    return rows.select(
        text.normalize(F.col("alias")).alias("alias"),
        text.normalize(F.col("canonical")).alias("canonical"),
    ).distinct()


def term_counts(products: DataFrame) -> DataFrame:
    """Products per term of the search text."""
    terms = products.select(F.explode(text.tokenize(F.col("search_text"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("doc_freq"))


def lexicon(products: DataFrame, limit: int = 25_000) -> DataFrame:
    """Most frequent terms of the search text."""
    return term_counts(products).orderBy(F.desc("doc_freq"), "term").limit(limit)


def term_occurrences(products: DataFrame, contracts: DataFrame, seeds: DataFrame) -> DataFrame:
    """(term, source bit, forced type, position) for every field value of every source.

    Equal contract names are counted before they are split into terms; ``n`` carries the count. ``contracts`` may be
    such counts already (purchase_name_norm, n).
    """
    counted = F.sum("n") if "n" in contracts.columns else F.count("*")
    no_type = F.lit(None).cast("string")

    def field(tokens, source, forced, number):
        return F.struct(
            tokens.alias("tokens"),
            F.lit(K.SOURCE_BITS[source]).alias("bit"),
            forced.alias("forced"),
            number.cast("int").alias("field"),
        )

    attribute_fields = F.flatten(
        F.transform(
            "attributes",
            lambda a: F.array(
                field(text.tokens(a["name_norm"]), "attribute_name", F.lit("attribute"), a["pos"] * 2 + 2),
                field(text.tokens(a["value_norm"]), "attribute_value", no_type, a["pos"] * 2 + 3),
            ),
        )
    )
    own_fields = F.array(
        field(F.col("title_tokens"), "title", no_type, F.lit(0)),
        field(text.tokens(F.col("category_norm")), "category", F.lit("category"), F.lit(1)),
        field(text.tokenize(F.col("brand_guess")), "brand", F.lit("brand"), F.lit(2)),
        field(text.tokenize(F.col("model_guess")), "model", F.lit("model"), F.lit(3)),
    )
    from_products = products.select(
        F.lit(0).alias("phase"), F.col("ste_id").alias("row"), F.lit(1).alias("n"),
        F.explode(F.concat(own_fields, attribute_fields)).alias("f"),
    ).select("phase", "row", "n", "f.*")
    from_contracts = (
        contracts.groupBy("purchase_name_norm")
        .agg(counted.alias("n"))
        .select(
            F.lit(1).alias("phase"), F.col("purchase_name_norm").alias("row"), "n",
            text.tokens(F.col("purchase_name_norm")).alias("tokens"),
            F.lit(K.SOURCE_BITS["purchase_name"]).alias("bit"),
            no_type.alias("forced"), F.lit(0).alias("field"),
        )
    )
    from_seeds = seeds.select(
        F.concat_ws("\t", "alias", "canonical").alias("row"),
        text.infer_term_type(F.col("canonical")).alias("forced"),
        F.posexplode(F.array("alias", "canonical")).alias("field", "word"),
    ).select(
        F.lit(2).alias("phase"), "row", F.lit(1).alias("n"),
        text.tokens(F.col("word")).alias("tokens"),
        F.lit(K.SOURCE_BITS["seed"]).alias("bit"), "forced", "field",
    )
    every = from_products.unionByName(from_contracts).unionByName(from_seeds)
    return every.select(
        F.explode("tokens").alias("term"), "n", "bit", "forced",
        F.struct("phase", "row", "field").alias("place"),
    )


def term_dictionary(products: DataFrame, contracts: DataFrame, seeds: DataFrame) -> DataFrame:
    """term, lemma, doc_freq, term_type, source_mask over all catalogue and contract text.

    ``doc_freq`` counts field values. The lemma follows the type of the first place a term
    occurs in; the last place that prescribes a type decides the type.
    """
    places = term_occurrences(products, contracts, seeds)
    folded = places.groupBy("term").agg(
        F.sum("n").alias("doc_freq"),
        F.bit_or("bit").alias("source_mask"),
        F.min_by(F.struct("forced"), "place").alias("first"),
        F.max_by(
            F.when(F.col("forced").isNotNull(), F.col("forced")),
            F.when(F.col("forced").isNotNull(), F.col("place")),
        ).alias("forced"),
    )
    return folded.select(
        "term",
        text.lemma(F.col("term"), F.coalesce("first.forced", F.lit("token"))).alias("lemma"),
        "doc_freq",
        F.coalesce("forced", text.infer_term_type(F.col("term"))).alias("term_type"),
        F.col("source_mask").cast("int").alias("source_mask"),
    )


def synonym_candidates(dictionary: DataFrame, seeds: DataFrame) -> DataFrame:
    """Alias → canonical proposals: the seeds, and terms that share a lemma.

    Per lemma the most frequent term is the canonical and the next seven may be aliases.
    """
    leaders = top_k(
        dictionary.select("lemma", "term", "doc_freq", "term_type"),
        ["lemma"], [F.desc("doc_freq"), F.asc("term")], 8,
    )
    first = Window.partitionBy("lemma").orderBy("rank")
    paired = (
        leaders.withColumn("canonical", F.first("term").over(first))
        .withColumn("canonical_type", F.first("term_type").over(first))
        .filter("rank > 1")
        .filter(
            (F.col("term_type") == F.col("canonical_type")) | (F.col("canonical_type") == "token")
        )
    )
    mined = paired.select(
        F.col("term").alias("alias"), "canonical",
        F.when(F.col("canonical_type").isin("token", "category", "attribute"), 0.94)
        .otherwise(0.90).alias("score"),
        F.lit("lemma_group").alias("source"),
    )
    given = seeds.select("alias", "canonical", F.lit(1.0).alias("score"), F.lit("seed").alias("source"))
    return (
        given.unionByName(mined)
        .filter("alias != canonical")
        .groupBy("alias", "canonical")
        .agg(F.max("score").alias("score"), F.max_by("source", "score").alias("source"))
        .withColumn("scope", F.lit("global"))
    )


def synonym_rules(candidates: DataFrame, dictionary: DataFrame, seeds: DataFrame) -> DataFrame:
    """Active rules: the seeds, and strong candidates whose types agree."""
    types = dictionary.select("term", "term_type")
    alias_types = types.toDF("alias", "alias_type")
    canonical_types = types.toDF("canonical", "canonical_type")
    strong = (
        candidates.filter("score >= 0.92 and alias != canonical")
        .join(alias_types, "alias", "left")
        .join(canonical_types, "canonical", "left")
        .withColumn("alias_type", F.coalesce("alias_type", F.lit("token")))
        .withColumn("canonical_type", F.coalesce("canonical_type", F.lit("token")))
        .filter(
            (F.col("alias_type") == F.col("canonical_type"))
            | (F.col("alias_type") == "token")
            | (F.col("canonical_type") == "token")
        )
        .select("alias", "canonical", "scope", F.col("score").alias("confidence"), "source")
    )
    given = seeds.select(
        "alias", "canonical", F.lit("global").alias("scope"),
        F.lit(1.0).alias("confidence"), F.lit("seed").alias("source"),
    )
    return (
        given.unionByName(strong)
        .groupBy("alias", "canonical", "scope")
        .agg(F.max("confidence").alias("confidence"), F.max_by("source", "confidence").alias("source"))
        .withColumn("status", F.lit("active"))
    )


def synonym_lookup(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alias → canonical) and (canonical → aliases): of several rules the last in order wins.

    Aliases are listed seeds first, then by name; an alias list holds one lemma group.
    """
    active = rules.filter("status = 'active' and scope = 'global'")
    canonical = active.groupBy("alias").agg(F.max("canonical").alias("canonical"))
    aliases = (
        active.filter("alias != canonical")
        .groupBy("canonical")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct((F.col("source") != "seed").alias("late"), "alias"))),
                lambda item: item["alias"],
            ).alias("aliases")
        )
    )
    return canonical, aliases


def expansion_lookup(rules: DataFrame) -> DataFrame:
    """word → (canonical, aliases of the canonical): one row per word a rule mentions."""
    canonical, aliases = synonym_lookup(rules)
    words = (
        canonical.select(F.col("alias").alias("word"), "canonical")
        .unionByName(aliases.select(F.col("canonical").alias("word"), F.lit(None).alias("canonical")))
        .groupBy("word")
        .agg(F.max("canonical").alias("canonical"))
        .withColumn("canonical", F.coalesce("canonical", "word"))
    )
    return words.join(aliases, "canonical", "left").select(
        "word", "canonical",
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
    )


def with_search_text(products: DataFrame, rules: DataFrame) -> DataFrame:
    """Products with ``search_text``: tokens and lemmas of all fields, canonical forms, aliases.

    The expansions are written, so that Spark sees how few they are and no word is shuffled to meet them. A word that
    is in a large share of the products is a small row joined to many, which adaptive execution splits.
    """
    lookup = materialize(expansion_lookup(rules), "expansions")
    everything = F.concat_ws(
        " ",
        F.col("title_norm"), F.col("category_norm"),
        text.normalize(F.col("brand_guess")), text.normalize(F.col("model_guess")),
        F.flatten(F.transform("attributes", lambda a: F.array(a["name_norm"], a["value_norm"]))),
    )
    words = products.select("ste_id", text.tokenize(everything).alias("words"))
    with_lemmas = words.select(
        "ste_id", F.concat("words", F.transform("words", text.stem)).alias("words")
    )
    expanded = (
        with_lemmas.select("ste_id", F.posexplode("words").alias("pos", "word"))
        .join(lookup, "word", "left")
        .select(
            "ste_id", "pos",
            F.concat(
                F.array(F.coalesce("canonical", "word")),
                F.coalesce("aliases", F.array().cast("array<string>")),
            ).alias("forms"),
        )
    )
    texts = expanded.groupBy("ste_id").agg(
        F.array_join(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.sort_array(F.collect_list(F.struct("pos", "forms"))),
                        lambda item: item["forms"],
                    )
                )
            ),
            " ",
        ).alias("search_text")
    )
    return products.drop("search_text").join(texts, "ste_id", "left").withColumn(
        "search_text", F.coalesce("search_text", F.lit(""))
    )
