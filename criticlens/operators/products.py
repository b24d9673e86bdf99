"""Derived product columns, and the comments of product documents as reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from criticlens.functions.scores import (
    STARS,
    first_number,
    percent_distribution,
    polarization,
    rating_count,
    vote_count,
)
from criticlens.operators.cleaning import keep_first


def product_features(df: DataFrame) -> DataFrame:
    """Add the image count, score, distribution, polarization, rating count and food flag; drop ``rating``."""
    distribution = percent_distribution(F.col("rating.dist"))
    featured = df.withColumns(
        {
            "count_alt_images": F.size("alt_images"),
            "score": first_number(F.col("rating.score")),
            "score_distribution": distribution,
            "num_ratings": rating_count(F.try_element_at("product_detail", F.lit("Customer Reviews"))),
            "is_food": F.exists("category", lambda c: F.lower(c).contains("food")),
        }
    )
    return featured.withColumn("score_polarization_index", polarization(F.col("score_distribution"))).drop("rating")


def distribution_columns(df: DataFrame, column: str = "score_distribution") -> DataFrame:
    """count_1star..count_5star as whole numbers from an array or list text; zeros when missing or malformed."""
    values: Column = F.col(column)
    if df.schema[column].dataType.simpleString() == "string":
        values = F.from_json(F.translate(F.trim(values), "()", "[]"), "array<double>")
    return df.withColumns(
        {
            f"count_{i + 1}star": F.coalesce(F.get(values, F.lit(i)).try_cast("int"), F.lit(0))
            for i in range(STARS)
        }
    )


def product_comments(df: DataFrame) -> DataFrame:
    """One review row per comment of each product document."""
    exploded = df.select("product_id", F.explode("top_comments").alias("c"))
    formats = ("MMMM d, yyyy", "d MMMM yyyy")
    written = F.coalesce(*[F.try_to_timestamp(F.col("c.date"), F.lit(f)) for f in formats])
    return exploded.select(
        "product_id",
        vote_count(F.col("c.helpfulness")).alias("helpfulness_numerator"),
        first_number(F.col("c.score")).try_cast("int").alias("score"),
        written.alias("review_time"),
        F.col("c.title").alias("summary"),
        F.col("c.text").alias("text"),
    )


def merge_reviews(
    reviews: DataFrame,
    comments: DataFrame,
    order_cols: Sequence[str] = ("id", "product_id", "text", "helpfulness_numerator"),
    key_cols: Sequence[str] = ("score", "review_time", "summary"),
) -> DataFrame:
    """Reviews and comments together, one row per score, time and summary, across products.

    Columns the comments lack are NULL; an original review wins over a comment.
    """
    both = reviews.withColumn("_source", F.lit(0)).unionByName(
        comments.withColumn("_source", F.lit(1)), allowMissingColumns=True
    )
    return keep_first(both, key_cols, ["_source", *order_cols]).drop("_source")
