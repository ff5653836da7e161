"""Interaction events: validation, session signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import constants as K
from quarry.operators.ranking import top_k

SESSION_EVENTS = 250
CATEGORY_SHARE = 0.6


def event_weight(event_type: Column) -> Column:
    weight = F.lit(0.0)
    for name, value in K.EVENT_WEIGHTS.items():
        weight = F.when(event_type == name, F.lit(value)).otherwise(weight)
    return weight


def enrich_events(events: DataFrame, products: DataFrame) -> DataFrame:
    """Events of the supported types with the category of their product."""
    categories = products.select("ste_id", "category_norm")
    supported = events.filter(F.col("event_type").isin(K.EVENT_TYPES)).drop("category_norm")
    return supported.join(categories, "ste_id", "left")


def saved_from_events(events: DataFrame) -> DataFrame:
    """Saved products recorded by the events."""
    return events.filter("event_type = 'result_saved' and ste_id is not null").select(
        F.col("event_id").alias("saved_id"), "session_id", "customer_inn", "ste_id", "created_at"
    )


def newest_events(events: DataFrame, n: int = SESSION_EVENTS) -> DataFrame:
    """The latest events of every session; equal times by id."""
    order = [F.desc("created_at"), F.desc("event_id")]
    in_session = events.filter("session_id is not null")
    return top_k(in_session, ["session_id"], order, n).drop("rank")


def session_signals(events: DataFrame, n: int = SESSION_EVENTS) -> tuple[DataFrame, DataFrame]:
    """Weights per (session, product) and per (session, category) of the latest events."""
    weighted = newest_events(events, n).withColumn("w", event_weight(F.col("event_type")))
    by_product = (
        weighted.filter("ste_id is not null")
        .groupBy("session_id", "ste_id")
        .agg(F.sum("w").alias("weight"))
    )
    by_category = (
        weighted.filter("category_norm is not null")
        .groupBy("session_id", "category_norm")
        .agg((F.sum("w") * CATEGORY_SHARE).alias("weight"))
    )
    return by_product, by_category
