"""Numeric expressions: recency, cost, lexical score, exploration, proxy, blend."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recency_weight(purchased_at: Column, as_of: Column) -> Column:
    """0 without a date or for a future one, else 1.5 falling to 0.5 over ten years."""
    age_days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(purchased_at)) / 86400)
    return F.when(purchased_at.isNull() | (purchased_at > as_of), F.lit(0.0)).otherwise(
        F.lit(1.5) - F.least(age_days, F.lit(3650)) / F.lit(3650)
    )


def cost_weight(cost: Column) -> Column:
    return F.when(cost > 0, F.least(F.lit(0.6), F.log10(cost + 10) / 6)).otherwise(F.lit(0.0))


def purchase_weight(purchased_at: Column, cost: Column, as_of: Column) -> Column:
    return F.lit(1.0) + recency_weight(purchased_at, as_of) + cost_weight(cost)


def lexical_score(bm25: Column, mode: str = "reciprocal") -> Column:
    """Full-text score in (0, 1].

    ``reciprocal`` falls as the match gets better, as the compared system does;
    ``monotone`` grows with it.
    """
    size = F.abs(bm25)
    if mode == "reciprocal":
        return 1 / (1 + size)
    if mode == "monotone":
        return size / (1 + size)
    raise ValueError(f"unknown mode {mode!r}")


def exploration_bonus(
    customer: Column, category_norm: Column, ste_id: Column, has_history: Column
) -> Column:
    """Stable pseudo-random bonus from a hash of customer, category and product."""
    seed = F.concat_ws("::", F.coalesce(customer, F.lit("global")), category_norm, ste_id)
    fraction = F.conv(F.left(F.sha2(seed, 256), F.lit(8)), 16, 10).cast("double") / 0xFFFFFFFF
    return F.round(fraction * F.when(has_history, 0.04).otherwise(0.18), 4)


def proxy_score(popularity: Column, category_weight: Column, history_weight: Column) -> Column:
    """Cheap order of feed candidates before the full score."""
    return (
        0.42 * F.log1p(popularity)
        + 0.28 * F.log1p(category_weight)
        + 0.22 * F.log1p(history_weight)
        + F.when((history_weight <= 0) & (category_weight > 0), 0.12).otherwise(0.0)
    )


def blend_scores(heuristic: Column, learned: Column, feed_mode: bool = False) -> Column:
    share = 0.5 if feed_mode else 0.6
    return F.round(share * heuristic + (1 - share) * learned, 6)
