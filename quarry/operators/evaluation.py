"""Ranking quality and the learned ranker."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text, weights
from quarry.operators.ranking import top_k

CASES_PER_CUSTOMER = 18
RELIABLE_CASES = 10


def recent_purchases(
    purchases: DataFrame, n: int = CASES_PER_CUSTOMER, before: datetime | None = None
) -> DataFrame:
    """Last ``n`` matched purchases of every customer, newest first.

    ``before`` takes only earlier ones, to build profiles and cases from different times.
    """
    if before is not None:
        purchases = purchases.filter(F.col("contract_date") < F.lit(before))
    order = [F.desc_nulls_last("contract_date"), F.asc("contract_key")]
    return top_k(purchases, ["customer_inn"], order, n)


def eval_cases(purchases: DataFrame, customers: DataFrame, n: int = CASES_PER_CUSTOMER) -> DataFrame:
    """Cases (query_id, customer_inn, query, expected): first title words of bought products."""
    asked = purchases.join(customers.select("customer_inn"), "customer_inn", "left_semi")
    cases = recent_purchases(asked, n).select(
        F.concat_ws("#", "customer_inn", F.col("rank").cast("string")).alias("query_id"),
        "customer_inn",
        text.title_snippet(F.col("title_tokens"), 4).alias("query"),
        F.col("ste_id").alias("expected"),
    )
    return cases.filter("query != ''")


def expected_ranks(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases with the rank of the expected product, null if it is not among the results."""
    found = results.select("query_id", F.col("ste_id").alias("expected"), "rank")
    return cases.join(found, ["query_id", "expected"], "left")


def ranking_metrics(results: DataFrame, cases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean Recall@20, Success@5, MRR@10 and NDCG@10 over the cases, rounded to four places."""
    r = F.col("rank")
    ranked = expected_ranks(results, cases)

    def mean(value: Column) -> Column:
        return F.round(F.coalesce(F.avg(F.coalesce(value, F.lit(0.0))), F.lit(0.0)), 4)

    metrics = ranked.groupBy(*by).agg(
        F.count("*").alias("cases"),
        mean(F.when(r <= 10, 1 / F.log2(r + 1))).alias("ndcg10"),
        mean(F.when(r <= 10, 1 / r)).alias("mrr10"),
        mean(F.when(r <= 20, 1.0)).alias("recall20"),
        mean(F.when(r <= 5, 1.0)).alias("success5"),
    )
    return metrics.withColumns(
        {
            "ndcgAt10": F.col("ndcg10"), "mrrAt10": F.col("mrr10"),
            "recallAt20": F.col("recall20"), "successAt5": F.col("success5"),
            "is_reliable": F.col("cases") >= RELIABLE_CASES,
        }
    )


def metric_deltas(baseline: DataFrame, personalised: DataFrame) -> DataFrame:
    """Both metric rows in long form with the gain of personalisation."""
    names = ["ndcg10", "mrr10", "recall20", "success5"]

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*names).unpivot([], names, "metric", name)

    return (
        long(baseline, "baseline")
        .join(long(personalised, "personalised"), "metric")
        .withColumn("delta", F.round(F.col("personalised") - F.col("baseline"), 4))
    )


def training_cases(purchases: DataFrame, n: int = 2000) -> DataFrame:
    """Matched purchases loaded last as (query_id, customer_inn, query, expected).

    Those of one load, or all where no load times are kept, are ordered by the day of the purchase, then by key.
    """
    name = F.nullif(F.trim("purchase_name_raw"), F.lit(""))
    title = F.nullif(F.trim("title_raw"), F.lit(""))
    order = [F.desc_nulls_last("contract_date"), F.asc("contract_key")]
    if "updated_at" in purchases.columns:
        order = [F.desc_nulls_last("updated_at"), *order]
    latest = top_k(purchases, [], order, n, rank="case_no")
    return latest.select(
        F.concat_ws("#", "contract_key", "customer_inn").alias("query_id"), "case_no",
        "customer_inn", F.coalesce(name, title).alias("query"), F.col("ste_id").alias("expected"),
    ).filter("query is not null")


def training_groups(
    cases: DataFrame, ranked: DataFrame, shown: int = 24, negatives: int = 7
) -> DataFrame:
    """Per case the expected product and the best-ranked others among the first results.

    Cases without both are left out.
    """
    top = ranked.filter(F.col("rank") <= shown).join(cases.select("query_id", "expected"), "query_id")
    labelled = top.withColumn("label", (F.col("ste_id") == F.col("expected")).cast("int"))
    kept = top_k(
        labelled.withColumnRenamed("rank", "shown_rank"),
        ["query_id", "label"], [F.asc("shown_rank")], negatives, rank="label_rank",
    )
    kept = kept.filter((F.col("label") == 0) | (F.col("label_rank") == 1)).drop("label_rank")
    both = kept.groupBy("query_id").agg(F.count_distinct("label").alias("labels")).filter("labels = 2")
    return kept.join(both.select("query_id"), "query_id", "left_semi")


def fit_ranker(groups: DataFrame, features: str = "features") -> list[float]:
    """Weights of a pairwise logistic ranker: expected product against each of the others."""
    positive = groups.filter("label = 1").select("query_id", F.col(features).alias("p"))
    negative = groups.filter("label = 0").select("query_id", F.col(features).alias("n"))
    pairs = positive.join(negative, "query_id").select(
        F.zip_with("p", "n", lambda a, b: a - b).alias("d")
    )
    both_ways = pairs.select(
        F.explode(
            F.array(
                F.struct(F.lit(1.0).alias("label"), F.col("d").alias("d")),
                F.struct(
                    F.lit(0.0).alias("label"), F.transform("d", lambda x: -x).alias("d")
                ),
            )
        ).alias("row")
    ).select("row.label", array_to_vector("row.d").alias("features"))
    model = LogisticRegression(fitIntercept=False, regParam=0.01, maxIter=50).fit(both_ways)
    return [float(x) for x in model.coefficients]


def apply_ranker(
    scored: DataFrame, coefficients: Sequence[float], features: str = "features", feed_mode: bool = False
) -> DataFrame:
    """Scores blended with the learned score; without coefficients they stay as they are."""
    if not coefficients:
        return scored
    products = F.zip_with(
        F.col(features), F.array(*[F.lit(c) for c in coefficients]), lambda x, w: x * w
    )
    learned = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    return scored.withColumn("learned", learned).withColumn(
        "score", weights.blend_scores(F.col("score"), F.col("learned"), feed_mode)
    )
