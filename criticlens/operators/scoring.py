"""Helpfulness-weighted and Bayesian product scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from criticlens.functions.scores import weight_simple, weight_smooth
from criticlens.operators.cleaning import drop_incomplete
from criticlens.operators.ranks import exact_medians
from criticlens.session import stage

METRICS = [
    "mean_score",
    "num_reviews",
    "weighted_mean_simple",
    "weighted_mean_smooth",
    "bayesian_mean_smooth",
    "bayesian_mean_simple",
]
_SMALLEST_PRIOR = 1e-6


def impossible_votes(df: DataFrame) -> DataFrame:
    """Reviews with more helpful votes than votes."""
    return df.where(F.col("helpfulness_numerator") > F.col("helpfulness_denominator"))


def drop_impossible_votes(df: DataFrame) -> DataFrame:
    more = F.col("helpfulness_numerator") > F.col("helpfulness_denominator")
    return df.where(~F.coalesce(more, F.lit(False)))


def review_weights(df: DataFrame, a: float = 1.0, b: float = 1.0, lo: float = 0.05, hi: float = 10.0) -> DataFrame:
    """Add the simple and smooth weights and the scores multiplied by them."""
    numerator, denominator = F.col("helpfulness_numerator"), F.col("helpfulness_denominator")
    weighted = df.withColumns(
        {
            "weight_simple": weight_simple(numerator),
            "weight_smooth": weight_smooth(numerator, denominator, a, b, lo, hi),
        }
    )
    return weighted.withColumns(
        {
            "wscore_simple": F.col("score") * F.col("weight_simple"),
            "wscore_smooth": F.col("score") * F.col("weight_smooth"),
        }
    )


def _sums(weighted: DataFrame, *extra: Column) -> DataFrame:
    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0.0)).alias(f"sum_{name}")

    return weighted.groupBy("product_id").agg(
        F.avg("score").alias("mean_score"),
        F.count(F.lit(1)).alias("num_reviews"),
        *[total(n) for n in ("weight_simple", "wscore_simple", "weight_smooth", "wscore_smooth")],
        *extra,
    )


def weight_sums(weighted: DataFrame) -> DataFrame:
    """Per product: mean score, rows, and the four sums; a sum of nothing is 0."""
    return _sums(weighted.where(F.col("product_id").isNotNull()))


def with_weighted_means(sums: DataFrame) -> DataFrame:
    """Weighted means; NULL where the weights sum to nothing."""

    def mean(kind: str) -> Column:
        weight = F.col(f"sum_weight_{kind}")
        return F.when(weight > 0, F.try_divide(F.col(f"sum_wscore_{kind}"), weight))

    return sums.withColumns({f"weighted_mean_{k}": mean(k) for k in ("simple", "smooth")})


def product_scores(df: DataFrame, drop_impossible: bool = False, **weight_options: float) -> DataFrame:
    """One row per product with the mean, weighted and Bayesian scores.

    The reviews are read once into product sums. The prior (mean score over all reviews, median
    weight over all products) comes from those sums as a one-row subquery. Reviews without a
    product count for the mean score only.
    """
    reviews = drop_impossible_votes(df) if drop_impossible else df
    score_sums = F.sum("score").cast("double").alias("_score_sum"), F.count("score").alias("_score_n")
    everything = stage(_sums(review_weights(reviews, **weight_options), *score_sums))
    prior = _prior(everything).select(F.struct("*")).scalar()
    return with_bayesian_means(everything.where(F.col("product_id").isNotNull()), prior).drop("_score_sum", "_score_n")


def with_bayesian_means(sums: DataFrame, prior: Column) -> DataFrame:
    """Weighted and Bayesian means under a prior: a struct of global_mean, prior_simple and prior_smooth."""

    def bayesian(kind: str) -> Column:
        m, mean = prior.getField(f"prior_{kind}"), prior.getField("global_mean")
        weight = F.col(f"sum_weight_{kind}")
        return (m * mean + F.col(f"weighted_mean_{kind}") * weight) / (m + weight)

    return with_weighted_means(sums).withColumns({f"bayesian_mean_{k}": bayesian(k) for k in ("smooth", "simple")})


def score_prior(df: DataFrame, **weight_options: float) -> DataFrame:
    """One row: global_mean, prior_simple, prior_smooth of a review table, for sums kept elsewhere."""
    score_sums = F.sum("score").cast("double").alias("_score_sum"), F.count("score").alias("_score_n")
    return _prior(stage(_sums(review_weights(df, **weight_options), *score_sums)))


def _prior(sums: DataFrame) -> DataFrame:
    """One row: global_mean, prior_simple, prior_smooth."""
    weights = ["sum_weight_simple", "sum_weight_smooth"]
    medians = exact_medians(sums.where(F.col("product_id").isNotNull()), weights)

    def median(kind: str) -> Column:
        value = F.max(F.when(F.col("variable") == f"sum_weight_{kind}", F.col("median")))
        return F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(_SMALLEST_PRIOR)).alias(f"prior_{kind}")

    mean = sums.agg(F.try_divide(F.sum("_score_sum"), F.sum("_score_n"))).scalar()
    return medians.agg(median("simple"), median("smooth")).withColumn("global_mean", mean)


def score_table(scores: DataFrame) -> DataFrame:
    return scores.select("product_id", *METRICS)


def merge_scores(products: DataFrame, scores: DataFrame) -> DataFrame:
    """Products with their scores; metric columns already present are replaced."""
    base = products.drop(*METRICS).withColumn("product_id", F.col("product_id").cast("string"))
    table = score_table(scores).withColumn("product_id", F.col("product_id").cast("string"))
    merged = base.join(table, "product_id", "left")
    return merged.withColumns(
        {
            "diff_smooth_vs_simple": F.col("weighted_mean_smooth") - F.col("weighted_mean_simple"),
            "diff_bayes_vs_mean": F.col("bayesian_mean_smooth") - F.col("mean_score"),
        }
    )


def score_preview(products: DataFrame, n: int = 10) -> DataFrame:
    """The first products by id."""
    return products.orderBy("product_id").limit(n)


def score_sample(scores: DataFrame, n: int = 300, seed: int = 42, min_reviews: int = 5) -> DataFrame:
    """Repeatable sample of products with enough reviews and all metrics, at most ``n`` rows."""
    required = ["num_reviews", "mean_score", "weighted_mean_smooth", "bayesian_mean_smooth"]
    kept = drop_incomplete(scores, required).where(F.col("num_reviews") >= min_reviews)
    draw = F.md5(F.concat_ws("#", F.col("product_id"), F.lit(str(seed))))
    return kept.orderBy(draw, "product_id").limit(n)


def single_review_product(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("num_reviews") == 1).orderBy("product_id").limit(1)


def best_reviewed_product(scores: DataFrame, min_reviews: int = 20) -> DataFrame:
    kept = scores.where(F.col("num_reviews") >= min_reviews)
    return kept.orderBy(F.desc_nulls_last("weighted_mean_smooth"), "product_id").limit(1)
