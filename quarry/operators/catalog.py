"""Products and contracts: standard columns, upserts, matching, look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import substrings
from quarry.operators.ranking import top_k
from quarry.session import materialize


def standardize_products(raw: DataFrame) -> DataFrame:
    """Raw (ste_id, title, category, attributes_raw[, updated_at]) → catalogue rows."""
    cells = raw.select(
        text.clean(F.col("ste_id")).alias("ste_id"),
        text.clean(F.col("title")).alias("title_raw"),
        text.clean(F.col("category")).alias("category_raw"),
        text.clean(F.col("attributes_raw")).alias("attributes_raw"),
        *[c for c in ("created_at", "updated_at", "_place") if c in raw.columns],
    )
    with_norms = cells.withColumns(
        {
            "title_norm": text.normalize(F.col("title_raw")),
            "category_norm": text.normalize(F.col("category_raw")),
            "attributes": text.parse_attributes(F.col("attributes_raw")),
        }
    )
    with_tokens = with_norms.withColumn("title_tokens", text.tokens(F.col("title_norm")))
    return with_tokens.withColumns(
        {
            "brand_guess": text.guess_brand(F.col("title_tokens")),
            "model_guess": text.guess_model(F.col("title_tokens")),
        }
    )


def product_attributes(products: DataFrame) -> DataFrame:
    """Long view of the attributes of the products."""
    return products.select("ste_id", F.explode("attributes").alias("a")).select("ste_id", "a.*")


def standardize_contracts(raw: DataFrame) -> DataFrame:
    """Raw contract cells → typed contract rows with their key."""
    words = [
        "purchase_name", "contract_id", "ste_id", "customer_inn", "customer_name",
        "customer_region", "supplier_inn", "supplier_name", "supplier_region",
    ]
    kept = [c for c in ("created_at", "updated_at", "_place", "matched_product") if c in raw.columns]
    cells = raw.select(
        *[text.clean(F.col(c)).alias(c) for c in words],
        F.col("contract_date").try_cast("timestamp").alias("contract_date"),
        F.col("cost").try_cast("double").alias("cost"),
        *kept,
    )
    return cells.withColumnRenamed("purchase_name", "purchase_name_raw").withColumns(
        {
            "contract_key": F.concat_ws(":", "contract_id", "ste_id"),
            "purchase_name_norm": text.normalize(F.col("purchase_name_raw")),
        }
    )


def normalized_name(cell: Column) -> Column:
    """The ``purchase_name_norm`` of a raw purchase name."""
    return text.normalize(text.clean(cell))


def latest_per_key(df: DataFrame, key: str | list[str], order: Column, keep_first: list[str]) -> DataFrame:
    """Last row per key, of one column or several, by ``order``; ``keep_first`` columns from the first row.

    One partial aggregation: a key's copies are folded to one row inside the map tasks.
    """
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys and c not in keep_first]
    folded = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), order).alias("last"),
        *[F.min_by(c, order).alias(c) for c in keep_first],
    )
    return folded.select(
        *[F.col(c) if c in keys or c in keep_first else F.col(f"last.{c}") for c in df.columns]
    )


def upsert(
    base: DataFrame, delta: DataFrame, key: str, order: str, keep_first: list[str] = ()
) -> DataFrame:
    """Base with delta laid over it: delta rows win, later ones over earlier ones."""
    rows = base.withColumn("_layer", F.lit(0)).unionByName(delta.withColumn("_layer", F.lit(1)))
    latest = latest_per_key(rows, key, F.struct("_layer", order), list(keep_first))
    return latest.drop("_layer")


def replace_children(
    child: DataFrame, touched: DataFrame, new_child: DataFrame, key: str
) -> DataFrame:
    """Child rows with those of touched parents replaced by the new ones."""
    return child.join(touched.select(key).distinct(), key, "left_anti").unionByName(new_child)


def flag_matched(contracts: DataFrame, products: DataFrame) -> DataFrame:
    """Contracts with ``matched_product``: whether the catalogue has their product."""
    known = products.select("ste_id").distinct().withColumn("_known", F.lit(True))
    return (
        contracts.drop("matched_product")
        .join(known, "ste_id", "left")
        .withColumn("matched_product", F.col("_known").isNotNull())
        .drop("_known")
    )


def contracts_enriched(contracts: DataFrame, products: DataFrame) -> DataFrame:
    """All contracts with the title and category of their product, if any."""
    columns = products.select("ste_id", "title_raw", "category_norm", "title_tokens")
    return contracts.join(columns, "ste_id", "left")


def matched_purchases(contracts: DataFrame, products: DataFrame) -> DataFrame:
    """Contracts whose product is in the catalogue, with its title."""
    return contracts.join(products.select("ste_id", "title_raw", "title_tokens"), "ste_id")


def unmatched_contracts(contracts: DataFrame, products: DataFrame) -> DataFrame:
    return contracts.join(products.select("ste_id"), "ste_id", "left_anti")


def import_stats(contracts: DataFrame) -> DataFrame:
    """Rows, matched, unmatched and distinct customers of an import."""
    return contracts.agg(
        F.count("*").alias("contracts"),
        F.count_if("matched_product").alias("matched"),
        F.count_if(~F.col("matched_product")).alias("unmatched"),
        F.count_distinct("customer_inn").alias("customers"),
    )


def touched_customers(contracts: DataFrame) -> DataFrame:
    return contracts.select("customer_inn").distinct()


def product_popularity(contracts: DataFrame) -> DataFrame:
    """Number of contracts per product."""
    return contracts.groupBy("ste_id").agg(F.count("*").alias("popularity"))


def lookup_products(products: DataFrame, ids: DataFrame) -> DataFrame:
    """Products with the given ids and their attributes, repeats removed."""
    return products.join(ids.select("ste_id").distinct(), "ste_id", "left_semi").select(
        "ste_id", "title_raw", "category_raw", "brand_guess", "model_guess", "attributes_raw",
        text.dedupe_attributes(F.col("attributes")).alias("attributes"),
    )


def saved_results(saved: DataFrame, products: DataFrame, per_user: int = 100) -> DataFrame:
    """Newest saved products of every user."""
    newest = top_k(
        saved, ["customer_inn"], [F.desc("created_at"), F.desc("saved_id")], per_user
    )
    titles = products.select("ste_id", "title_raw", "category_raw")
    return newest.join(titles, "ste_id", "left")


def with_plain_text(products: DataFrame) -> DataFrame:
    """Products with the lower-cased text that substring search looks into."""
    attributes = F.array_join(
        F.flatten(F.transform("attributes", lambda a: F.array(a["name_raw"], a["value_raw"]))), " "
    )
    return products.withColumn(
        "plain_text",
        text.plain_search_text(
            F.col("title_raw"), F.col("brand_guess"), F.col("model_guess"), F.col("category_raw"), attributes
        ),
    )


def searched_fields(products: DataFrame) -> DataFrame:
    """The two texts of a product that substring search looks into, lower-cased."""
    return products.select("ste_id", "plain_text", F.lower("attributes_raw").alias("raw"))


def contains_search(
    products: DataFrame, queries: DataFrame, limit: int = 20, offset: int = 0,
    pieces: substrings.PieceIndex | None = None,
) -> DataFrame:
    """Substring search over (ste_id, plain_text, attributes_raw): page and total per query.

    ``pieces`` is the index of a snapshot (`index_store.load_pieces`). Without it the pieces are counted, and met as the
    texts are read again; only those that a query asks for are kept.
    """
    typed = queries.select(
        "query_id", F.lower(F.trim(F.col("query"))).alias("needle")
    ).filter("needle != ''")
    texts, fields = searched_fields(products), ["plain_text", "raw"]
    if pieces is None:
        places = substrings.piece_places(texts, "ste_id", fields)
        pieces = substrings.PieceIndex(places, substrings.count_pieces(places))
    hits = materialize(substrings.find(typed.select("needle").distinct(), pieces, texts, "ste_id", fields), "substring-hits")
    totals = hits.groupBy("needle").agg(F.count("*").alias("total_count"))
    ranked = top_k(hits, ["needle"], [F.asc("ste_id")], offset + limit, spread_by="ste_id")
    shown = ranked.filter(F.col("rank") > offset).join(totals, "needle")
    return typed.join(shown, "needle")


def customer_summary(profiles: DataFrame, ids: DataFrame) -> DataFrame:
    """Profile rows of the given customers, in the shape shown to users."""
    return profiles.join(ids.select("customer_inn").distinct(), "customer_inn", "left_semi").select(
        "customer_inn", "customer_name", "purchase_count", "matched_purchase_count",
        "total_spend", "last_purchase_at", "top_categories", "top_products",
    )

