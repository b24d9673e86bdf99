"""End-to-end jobs: cleaning, negative reviews, product scores and description correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from criticlens.functions.words import REASON_CATEGORIES
from criticlens.operators import correlation, negative, products, scoring, sentiment
from criticlens.operators.cleaning import clean_reviews
from criticlens.session import stage
from criticlens.sources.products import read_products
from criticlens.sources.reviews import read_cleaned, read_reviews_csv, write_analysis, write_cleaned


def run_cleaning(
    spark: SparkSession,
    src: str,
    dst: str,
    overwrite: bool = False,
    model: PipelineModel | None = None,
    polarity: Mapping[str, int] | None = None,
    order_cols: Sequence[str] = ("id",),
) -> DataFrame:
    """Raw CSV reviews to cleaned Parquet with a sentiment score; existing output is reused."""
    if model is None and polarity is None:
        raise ValueError("give a trained sentiment model or a word table")
    cleaned = clean_reviews(read_reviews_csv(spark, src), order_cols=order_cols)
    if model is not None:
        scored = sentiment.score_sentiment(cleaned, "text_cleaned", model)
    else:
        scored = sentiment.lexicon_sentiment(cleaned, "text_cleaned", polarity)
    write_cleaned(scored, dst, overwrite)
    return read_cleaned(spark, dst)


def negative_report(
    reviews: DataFrame,
    top_n: int = 30,
    top_n_products: int = 10,
    mapping: Mapping[str, Sequence[str]] = REASON_CATEGORIES,
) -> dict[str, DataFrame]:
    """Keyword table with categories, category shares, issues per product and all their keywords."""
    words = stage(negative.clean_keywords(negative.negative_reviews(reviews).select("product_id", "score", "keywords")))
    keywords = stage(negative.categorize(negative.top_keywords(words, top_n), mapping))
    issues = stage(negative.product_issues(words, top_n_products))
    return {
        "keywords": keywords,
        "categories": negative.category_share(keywords),
        "products": issues,
        "product_keywords": negative.product_keywords(words, issues),
    }


def run_negative_analysis(spark: SparkSession, cleaned_path: str, out_dir: str) -> dict[str, DataFrame]:
    report = negative_report(read_cleaned(spark, cleaned_path))
    write_analysis(report["keywords"], report["products"], out_dir, report["product_keywords"])
    return report


def load_products(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Product documents with their derived columns."""
    return products.product_features(read_products(spark, path, one_per_file))


def enrich_reviews(reviews: DataFrame, product_table: DataFrame) -> DataFrame:
    """Reviews together with the comments found on the product pages."""
    return products.merge_reviews(reviews, products.product_comments(product_table))


def scored_products(reviews: DataFrame, product_table: DataFrame) -> DataFrame:
    """Products with weighted and Bayesian scores and the star distribution as columns."""
    merged = scoring.merge_scores(product_table, scoring.product_scores(reviews))
    return products.distribution_columns(merged) if "score_distribution" in merged.columns else merged


def description_report(product_table: DataFrame, with_p_value: bool = True) -> dict[str, DataFrame]:
    """Every correlation of the ratings with the description features."""
    return {
        "images": correlation.image_correlation(product_table, with_p_value),
        "length": correlation.length_correlation(product_table, with_p_value=with_p_value),
        "marketing": correlation.marketing_correlation(product_table, with_p_value=with_p_value),
        "reading": correlation.reading_correlation(product_table, with_p_value),
        "items": correlation.item_correlation(product_table, with_p_value=with_p_value),
    }
