"""Customer profiles: counts, spend and weighted affinities.

Purchases are folded to one weight per (customer, product) and per (customer, purchase name)
before anything is joined or exploded, so neither a customer nor a product with a large share of
the contracts reaches a single task unfolded.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text, weights
from quarry.operators.ranking import spread_out, top_k


def _weighted(contracts: DataFrame, as_of: Column) -> DataFrame:
    return contracts.withColumn(
        "w", weights.purchase_weight(F.col("contract_date"), F.col("cost"), as_of)
    )


def purchase_counts(contracts: DataFrame, as_of: datetime) -> DataFrame:
    """Per customer: name, contracts, matched contracts, spend, last purchase not in the future."""
    recent = weights.recency_weight(F.col("contract_date"), F.lit(as_of)) > 0
    return contracts.groupBy("customer_inn").agg(
        F.min_by("customer_name", "contract_key").alias("customer_name"),
        F.count("*").alias("purchase_count"),
        F.count_if("matched_product").alias("matched_purchase_count"),
        F.sum(F.coalesce("cost", F.lit(0.0))).alias("total_spend"),
        F.max(F.when(recent, F.col("contract_date"))).alias("last_purchase_at"),
    )


def customer_product_weights(contracts: DataFrame, as_of: datetime) -> DataFrame:
    """Summed purchase weight per customer and product, unmatched products included."""
    weighted = _weighted(contracts, F.lit(as_of))
    return weighted.groupBy("customer_inn", "ste_id").agg(F.sum("w").alias("weight"))


def customer_category_weights(product_weights: DataFrame, products: DataFrame) -> DataFrame:
    """Summed purchase weight per customer and category."""
    categories = products.select("ste_id", "category_norm").filter("category_norm != ''")
    return (
        product_weights.join(categories, "ste_id")
        .groupBy("customer_inn", "category_norm")
        .agg(F.sum("weight").alias("weight"))
    )


def customer_token_weights(
    contracts: DataFrame, product_weights: DataFrame, products: DataFrame, as_of: datetime
) -> DataFrame:
    """Summed weight per customer and token: purchase names in full, product titles at 0.8.

    Texts are shuffled whole and split into tokens where they are summed, so that no token is shuffled; a customer's
    rows are folded to one per name and one per product before. They stay together for a following cut per customer.
    """
    names = (
        _weighted(contracts, F.lit(as_of))
        .groupBy("customer_inn", "purchase_name_norm")
        .agg(F.sum("w").alias("w"))
        .select("customer_inn", "w", text.tokens(F.col("purchase_name_norm")).alias("tokens"))
    )
    titles = product_weights.join(products.select("ste_id", "title_tokens"), "ste_id").select(
        "customer_inn", (F.col("weight") * 0.8).alias("w"), F.col("title_tokens").alias("tokens")
    )
    return (
        spread_out(names.unionByName(titles), "customer_inn")
        .select("customer_inn", "w", F.explode("tokens").alias("token"))
        .groupBy("customer_inn", "token")
        .agg(F.sum("w").alias("weight"))
    )


def top_items(weights_df: DataFrame, value: str, k: int, key: str = "customer_inn") -> DataFrame:
    """Heaviest ``k`` values per key in rank order; equal weights by value."""
    rounded = weights_df.select(
        key, F.col(value).alias("value"), F.round("weight", 4).alias("weight")
    )
    return top_k(rounded, [key], [F.desc("weight"), F.asc("value")], k)


def as_list(ranked: DataFrame, name: str, key: str = "customer_inn") -> DataFrame:
    """One array of (value, weight) per key, from rows limited by ``top_items``."""
    return ranked.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "value", "weight"))),
            lambda item: F.struct(item["value"].alias("value"), item["weight"].alias("weight")),
        ).alias(name)
    )


def customer_profiles(
    counts: DataFrame,
    category_weights: DataFrame,
    product_weights: DataFrame,
    token_weights: DataFrame,
) -> DataFrame:
    """One row per customer: counts and its top 8 categories, 10 products and 30 tokens."""
    categories = as_list(top_items(category_weights, "category_norm", 8), "top_categories")
    products = as_list(top_items(product_weights, "ste_id", 10), "top_products")
    tokens = as_list(top_items(token_weights, "token", 30), "token_weights")
    profiles = counts
    for items in (categories, products, tokens):
        profiles = profiles.join(items, "customer_inn", "left")
    return profiles


def showcase_profiles(counts: DataFrame, category_weights: DataFrame, n: int = 3) -> DataFrame:
    """Customers to show: most matched purchases, then widest, then most purchases."""
    diversity = category_weights.groupBy("customer_inn").agg(
        F.count("*").alias("category_diversity")
    )
    ordered = counts.join(diversity, "customer_inn", "left").withColumn(
        "category_diversity", F.coalesce("category_diversity", F.lit(0))
    )
    order = [
        F.desc("matched_purchase_count"), F.desc("category_diversity"),
        F.desc("purchase_count"), F.asc("customer_inn"),
    ]
    shown = top_k(ordered, [], order, n, rank="sort_order")
    return shown.withColumn("label", F.concat(F.lit("Demo profile "), F.col("sort_order")))


def refresh_profiles(current: DataFrame, touched: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Profiles with the rows of touched customers replaced by rebuilt ones."""
    return current.join(touched, "customer_inn", "left_anti").unionByName(
        rebuilt, allowMissingColumns=True
    )
