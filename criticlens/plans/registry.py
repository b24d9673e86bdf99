"""The registered queries: every operator over the whole shared tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from criticlens.functions import text as text_functions
from criticlens.functions.scores import helpfulness_index, polarization
from criticlens.operators import cleaning, correlation, negative, pages, products, ranks, scoring, sentiment, timeseries
from criticlens.operators.bins import histograms
from criticlens.plans import adapters as views
from criticlens.plans import jobs
from criticlens.session import ensure_settings, scratch_path, stage
from criticlens.sources import products as product_files
from criticlens.sources import reviews as review_files
from criticlens.sources.loaded import LoadedProducts
from criticlens.streaming import reviews as streams

# Word table for the deterministic sentiment, drawn from the words of the shared documents.
POLARITY = {
    "the": 1, "that": 1, "with": 1, "und": 1, "der": 1, "les": 1, "une": 1, "los": 1,
    "not": -1, "but": -1, "was": -1, "die": -1, "nicht": -1, "pas": -1, "que": -1, "del": -1,
}
# Marketing words found in the shared documents, since the default ones do not occur there.
TONE_WORDS = ["the", "and", "with", "la", "les", "der", "und", "los", "que"]
GOOD_SCORE = 3.2
ROUND = 6


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), ROUND) for c in columns})


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as text, for comparing values."""
    return df.withColumns({c: F.concat_ws("|", F.col(c)) for c in columns})


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    return views.load(spark, sf, views.RATINGS)


def offers(spark: SparkSession, sf: str) -> DataFrame:
    return views.load(spark, sf, views.OFFERS)


def text_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return views.load(spark, sf, views.TEXT_REVIEWS)


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    ensure_settings(spark)
    return spark.read.parquet(f"{sf}/pages.parquet")


# --- sources -------------------------------------------------------------------------------


def reviews_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    raw = text_reviews(spark, sf).withColumn("review_time", F.timestamp_seconds("time"))
    path = scratch_path(spark, "reviews-csv")
    review_files.write_reviews_csv(raw, path)
    return review_files.read_reviews_csv(spark, path).select(
        "id", "product_id", "user_id", "helpfulness_numerator", "helpfulness_denominator", "score", "review_time",
        "summary", "text",
    )


def read_cleaned_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords written as list text, as older files have them, and restored."""
    cleaned = cleaning.add_text_columns(text_reviews(spark, sf).where(F.col("text").isNotNull()))
    listed = F.concat(F.lit("['"), F.array_join("keywords", "', '"), F.lit("']"))
    legacy = cleaned.withColumn("keywords", F.when(F.size("keywords") > 0, listed).otherwise("[]"))
    path = scratch_path(spark, "cleaned")
    review_files.write_cleaned(legacy, path)
    restored = review_files.read_cleaned(spark, path)
    return joined(restored.select("id", "product_id", "score", "keywords"), "keywords")


def product_json_load(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "products-json")
    product_files.write_products(views.product_documents(spark, sf), path)
    loaded = product_files.read_products(spark, path, one_per_file=False)
    return loaded.select(
        "product_id",
        "product_title",
        F.size("category").alias("n_category"),
        F.size("product_detail").alias("n_detail"),
        F.size("important_information").alias("n_information"),
        F.col("rating.score").alias("rating_score"),
        F.try_element_at("rating.dist", F.lit("5 star")).alias("five_star"),
    )


def product_files_load(spark: SparkSession, sf: str) -> DataFrame:
    """One document per file, some empty and some cut off in the middle; the id is the file's name."""
    found = _product_pages(spark, sf)
    document = F.to_json(F.struct(*[c for c in found.columns if c != "page_id"]))
    documents = text_functions.add_once(found, {"document": document})
    cut = F.expr("substring(document, 1, length(document) - 5)")
    text = F.when(F.col("page_id") % 10 == 4, "{}").when(F.col("page_id") % 10 == 9, cut).otherwise(F.col("document"))
    path = scratch_path(spark, "product-files")
    # Each task moves its own files into place; by default the driver moves them all, one after the other.
    own_commit = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
    # In a local or mounted folder no file of checksums stands beside each: Hadoop starts a process to set the mode of every file it makes.
    plain_files = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
    documents.select(text.alias("value")).write.options(maxRecordsPerFile=1, **own_commit, **plain_files).text(path)
    loaded = jobs.load_products(spark, path)
    named = F.col("product_id").rlike("^part-[0-9a-f-]+-c[0-9]+$").alias("named")
    return joined(loaded.select("product_title", "category", "alt_images", "count_alt_images", F.size("top_comments").alias("n_comments"), named), "category", "alt_images")


def pending_products(spark: SparkSession, sf: str) -> DataFrame:
    """Order keys stand for reviewed products: the small ones are known parts, the others are not."""
    parts = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").cast("string").alias("product_id"))
    reviewed = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("product_id"))
    return product_files.pending_products(reviewed, parts)


def pending_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """What is pending after each of two rounds of loading (parts, then customers), and all with ``replace``."""
    ids = lambda name, key: spark.read.parquet(f"{sf}/{name}.parquet").select(F.col(key).cast("string").alias("product_id"))
    reviewed = ids("orders", "o_orderkey")
    path = scratch_path(spark, "loaded")
    known = LoadedProducts(spark, f"loaded_{path[-32:]}", path)
    rounds = [known.pending(reviewed).withColumn("round", F.lit("none"))]
    for name, key in (("part", "p_partkey"), ("customer", "c_custkey")):
        known.record(ids(name, key))
        # What is pending now is written, for the next round adds to the table.
        rounds.append(stage(known.pending(reviewed).withColumn("round", F.lit(name))))
    rounds.append(known.pending(reviewed, replace=True).withColumn("round", F.lit("replace")))
    return functools.reduce(DataFrame.unionByName, rounds).select("round", "product_id")


# --- pages ---------------------------------------------------------------------------------


def page_fields(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_fields(_pages(spark, sf)).select("page_id", "title", "heading", "lang")


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    linked = pages.page_links(_pages(spark, sf))
    return joined(linked.select("page_id", F.size("links").alias("n_links"), "links"), "links")


def page_key_values(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_key_values(_pages(spark, sf)).select("page_id", F.explode("key_values").alias("label", "address"))


def page_fill_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pages.page_fill_rate(_pages(spark, sf)), "share_title", "share_heading", "share_lang", "share_links")


# Where the shared pages keep what a product page has; the rest does not occur in them.
SHARED_PAGES = {name: ("table", None, None) for name in pages.PRODUCT} | {
    "title": ("h1", None, None),
    "description": ("article", None, None),
    "bullets": ("nav", None, None),
}


def page_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Nested sections of the pages as they are."""
    parsed = pages.extract_pages(_pages(spark, sf).select("page_id", "html"), selectors=SHARED_PAGES)
    return parsed.select(
        "page_id", "product_title", "product_description", F.size("product_detail").alias("n_detail"),
        F.size("top_comments").alias("n_comments"),
    )


def _product_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Product documents; the pages are spread first, since a split of their table holds far more of this work than one task should do."""
    return pages.extract_pages(views.load(spark, sf, views.PRODUCT_PAGES, spread=True))


def page_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Breadcrumbs and product images of product pages, in every state of markup."""
    found = _product_pages(spark, sf).select("page_id", "product_title", "byline_info", "category", "alt_images")
    return joined(found, "category", "alt_images")


def page_bullets(spark: SparkSession, sf: str) -> DataFrame:
    return _product_pages(spark, sf).select("page_id", F.explode("product_detail").alias("label", "value"))


def page_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Headline score and star shares; NULL where a part of the rating is missing."""
    stars = [F.try_element_at("rating.dist", F.lit(f"{k} star")).alias(f"share_{k}") for k in range(1, 6)]
    return _product_pages(spark, sf).select("page_id", F.col("rating.score").alias("rating_score"), *stars)


def page_comments(spark: SparkSession, sf: str) -> DataFrame:
    found = _product_pages(spark, sf).select("page_id", F.posexplode("top_comments").alias("nth", "c"))
    return found.select("page_id", "nth", "c.*")


# --- scalar columns ------------------------------------------------------------------------


def product_features(spark: SparkSession, sf: str) -> DataFrame:
    featured = products.product_features(views.product_documents(spark, sf)).select(
        "product_id", "count_alt_images", "score", "score_distribution", "score_polarization_index", "num_ratings", "is_food"
    )
    percents = F.transform("score_distribution", lambda p: p.cast("int"))
    return rounded(featured.withColumn("score_distribution", F.concat_ws("|", percents)), "score_polarization_index")


def score_polarization(spark: SparkSession, sf: str) -> DataFrame:
    info = views.load(spark, sf, views.PRODUCT_ROWS)
    shares = F.array(*[F.col(f"n{i}").cast("double") for i in range(1, 6)])
    return rounded(info.select("product_id", polarization(shares).alias("polarization")), "polarization")


def helpfulness(spark: SparkSession, sf: str) -> DataFrame:
    index = helpfulness_index(F.col("helpfulness_numerator"), F.col("helpfulness_denominator"))
    return ratings(spark, sf).select("id", index.alias("helpfulness_index"))


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return text_reviews(spark, sf).select("id", text_functions.clean_text(F.col("text")).alias("text_cleaned"))


def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    split = text_functions.with_tokens(text_reviews(spark, sf), "text", tokens_col="tokens").select("id", "tokens")
    return joined(split.withColumn("n_tokens", F.size("tokens")), "tokens")


def keywords(spark: SparkSession, sf: str) -> DataFrame:
    kept = cleaning.add_text_columns(text_reviews(spark, sf)).select("id", "keywords")
    return joined(kept.withColumn("n_keywords", F.size("keywords")), "keywords")


def sentiment_model_score(spark: SparkSession, sf: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    model = sentiment.train_sentiment(documents.join(labels, "doc_id"), "text", "quality")
    return rounded(sentiment.score_sentiment(documents, "text", model).drop("text"), "sentiment_score")


def sentiment_word_model(spark: SparkSession, sf: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    odds = sentiment.train_word_odds(documents.join(labels, "doc_id"), "text", "quality")
    return rounded(sentiment.score_word_odds(documents, "doc_id", "text", odds), "log_odds", "sentiment_score")


# Words of the model that is sent to the executors.
MODEL_WORDS = 20_000


def sentiment_batch_score(spark: SparkSession, sf: str) -> DataFrame:
    """Scores in batches by a model of a bounded number of words, sent to the executors once."""
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    odds = sentiment.train_word_odds(documents.join(labels, "doc_id"), "text", "quality", top=MODEL_WORDS)
    words = text_functions.with_tokens(documents, "text").select("doc_id", F.coalesce(F.array_join("_tokens", " "), F.lit("")).alias("words"))
    scored = sentiment.score_with_model(words, "words", sentiment.odds_predictor(odds))
    return rounded(scored.select("doc_id", "sentiment_score"), "sentiment_score")


def sentiment_lexicon_score(spark: SparkSession, sf: str) -> DataFrame:
    scored = sentiment.lexicon_sentiment(text_reviews(spark, sf), "text", POLARITY)
    return rounded(scored.select("id", "sentiment_score"), "sentiment_score")


def review_time_parts(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.time_parts(text_reviews(spark, sf), "time").select("id", "review_date", "year", "month", "month_num")


def review_weights(spark: SparkSession, sf: str) -> DataFrame:
    weighted = scoring.review_weights(ratings(spark, sf))
    columns = ["weight_simple", "weight_smooth", "wscore_simple", "wscore_smooth"]
    return rounded(weighted.select("id", *columns), *columns)


def score_distribution_columns(spark: SparkSession, sf: str) -> DataFrame:
    featured = products.product_features(views.product_documents(spark, sf)).select("product_id", "score_distribution")
    return products.distribution_columns(featured).drop("score_distribution")


def marketing_tone(spark: SparkSession, sf: str) -> DataFrame:
    toned = text_functions.marketing_tone(text_reviews(spark, sf), "text", TONE_WORDS)
    return rounded(toned.select("id", "marketing_tone_score"), "marketing_tone_score")


def reading_ease(spark: SparkSession, sf: str) -> DataFrame:
    measured = text_functions.reading_ease(text_reviews(spark, sf), "text")
    return rounded(measured.select("id", *correlation.READING_MEASURES), *correlation.READING_MEASURES)


# --- cleaning ------------------------------------------------------------------------------


def clean_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return joined(cleaning.clean_reviews(text_reviews(spark, sf)).drop("sentiment_score"), "keywords")


def cleaning_report(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.cleaning_report(text_reviews(spark, sf))


def table_profile(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.table_profile(ratings(spark, sf))


def merge_reviews(spark: SparkSession, sf: str) -> DataFrame:
    reviews = text_reviews(spark, sf).withColumn("review_time", F.timestamp_seconds("time")).drop("time", "sentiment_score")
    comments = products.product_comments(views.commented_products(spark, sf))
    return products.merge_reviews(reviews, comments).select(
        "id", "product_id", "user_id", "helpfulness_numerator", "helpfulness_denominator", "score", "review_time",
        "summary", "text",
    )


def enriched_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews and the comments of product documents that were written and loaded again, by the end-to-end jobs."""
    path = scratch_path(spark, "commented")
    # A document needs a title, or it counts as that of a failed page.
    product_files.write_products(views.commented_products(spark, sf).withColumn("product_title", F.col("product_id")), path)
    reviews = text_reviews(spark, sf).withColumn("review_time", F.timestamp_seconds("time")).drop("time", "sentiment_score")
    return jobs.enrich_reviews(reviews, jobs.load_products(spark, path, one_per_file=False)).select(
        "id", "product_id", "user_id", "helpfulness_numerator", "helpfulness_denominator", "score", "review_time",
        "summary", "text",
    )


# --- scores --------------------------------------------------------------------------------

_SUMS = ["mean_score", "sum_weight_simple", "sum_wscore_simple", "sum_weight_smooth", "sum_wscore_smooth"]
_MEANS = ["mean_score", "weighted_mean_simple", "weighted_mean_smooth"]
_SCORES = [*_MEANS, "bayesian_mean_smooth", "bayesian_mean_simple"]


def product_weight_sums(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.weight_sums(scoring.review_weights(ratings(spark, sf))), *_SUMS)


def weighted_product_scores(spark: SparkSession, sf: str) -> DataFrame:
    sums = scoring.weight_sums(scoring.review_weights(offers(spark, sf)))
    means = scoring.with_weighted_means(sums).select("product_id", "num_reviews", *_MEANS)
    return rounded(means, *_MEANS)


def bayesian_product_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.score_table(scoring.product_scores(ratings(spark, sf))), *_SCORES)


def bayesian_offer_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.score_table(scoring.product_scores(offers(spark, sf))), *_SCORES)


def impossible_votes(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.impossible_votes(ratings(spark, sf)).select("id", "helpfulness_numerator", "helpfulness_denominator")


def _stored_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """What the scores and the star counts need of the ratings, stored once, since both would join the items with their orders."""
    return stage(ratings(spark, sf).select("product_id", "helpfulness_numerator", "helpfulness_denominator", "score"))


def product_score_merge(spark: SparkSession, sf: str) -> DataFrame:
    reviews = _stored_ratings(spark, sf)
    info = views.star_counts(spark, sf, reviews).select("product_id", "product_title", "num_ratings")
    merged = scoring.merge_scores(info, scoring.product_scores(reviews))
    return rounded(merged, *_SCORES, "diff_smooth_vs_simple", "diff_bayes_vs_mean")


def scored_products(spark: SparkSession, sf: str) -> DataFrame:
    """Product documents with their derived columns, scores and star counts, by the end-to-end job."""
    reviews = _stored_ratings(spark, sf)
    featured = products.product_features(views.product_documents(spark, sf, reviews))
    scored = jobs.scored_products(reviews, featured)
    return rounded(scored.select("product_id", "num_ratings", "num_reviews", *_SCORES, *[f"count_{i}star" for i in range(1, 6)]), *_SCORES)


def score_preview(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.score_preview(scoring.score_table(scoring.product_scores(ratings(spark, sf)))), *_SCORES)


def score_sample(spark: SparkSession, sf: str) -> DataFrame:
    sample = scoring.score_sample(scoring.product_scores(ratings(spark, sf)))
    return rounded(scoring.score_table(sample), *_SCORES)


def single_review_product(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.score_table(scoring.single_review_product(scoring.product_scores(offers(spark, sf)))), *_SCORES)


def best_reviewed_product(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.score_table(scoring.best_reviewed_product(scoring.product_scores(ratings(spark, sf)))), *_SCORES)


# --- sentiment gap -------------------------------------------------------------------------


def sentiment_outliers(spark: SparkSession, sf: str) -> DataFrame:
    found = sentiment.sentiment_outliers(ratings(spark, sf))
    return rounded(
        found.select("id", "sentiment_score_scaled", "sentiment_gap", "z_score", "is_outlier"),
        "sentiment_score_scaled", "sentiment_gap", "z_score",
    )


def sentiment_gap_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sentiment.gap_stats(ratings(spark, sf)), "mean_gap", "std_gap")


def outlier_sample(spark: SparkSession, sf: str) -> DataFrame:
    sample = sentiment.outlier_sample(ratings(spark, sf))
    return rounded(sample.select("id", "product_id", "score", "sentiment_gap", "z_score"), "sentiment_gap", "z_score")


def outlier_extremes(spark: SparkSession, sf: str) -> DataFrame:
    sample = sentiment.outlier_sample(ratings(spark, sf), n=25, by="abs_z")
    return rounded(sample.select("id", "product_id", "score", "sentiment_gap", "z_score"), "sentiment_gap", "z_score")


def sentiment_gap_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(histograms(sentiment.sentiment_gap(ratings(spark, sf)), ["sentiment_gap"], 50), "bin_lo", "bin_hi")


# --- time series ---------------------------------------------------------------------------


def monthly_review_volume(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.monthly_volume(text_reviews(spark, sf), "time")


def yearly_review_count(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.yearly_count(text_reviews(spark, sf), "time")


def rating_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(timeseries.rating_heatmap(ratings(spark, sf)), *[f"m{i}" for i in range(1, 13)])


# --- negative reviews ----------------------------------------------------------------------


def _spoken_negative(spark: SparkSession, sf: str) -> DataFrame:
    """Negative reviews of the ratings with their cleaned keywords."""
    low = negative.negative_reviews(views.load(spark, sf, views.SPOKEN_RATINGS))
    return negative.clean_keywords(cleaning.add_text_columns(low).select("product_id", "score", "keywords"))


def negative_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return negative.negative_reviews(ratings(spark, sf)).select("id", "product_id", "score", "sentiment_score")


def negative_keywords_clean(spark: SparkSession, sf: str) -> DataFrame:
    low = cleaning.add_text_columns(negative.negative_reviews(text_reviews(spark, sf)))
    cleaned = negative.clean_keywords(low.select("id", "keywords")).select("id", "cleaned_keywords")
    return joined(cleaned.withColumn("n_keywords", F.size("cleaned_keywords")), "cleaned_keywords")


def negative_keyword_top(spark: SparkSession, sf: str) -> DataFrame:
    return negative.top_keywords(_spoken_negative(spark, sf))


def negative_text_keyword_top(spark: SparkSession, sf: str) -> DataFrame:
    low = cleaning.add_text_columns(negative.negative_reviews(text_reviews(spark, sf)))
    return negative.top_keywords(negative.clean_keywords(low.select("keywords")))


def negative_reason_categories(spark: SparkSession, sf: str) -> DataFrame:
    return negative.categorize(negative.top_keywords(_spoken_negative(spark, sf)))


def negative_category_share(spark: SparkSession, sf: str) -> DataFrame:
    share = negative.category_share(negative.categorize(negative.top_keywords(_spoken_negative(spark, sf))))
    return rounded(share, "share_percent")


def product_top_issues(spark: SparkSession, sf: str) -> DataFrame:
    return joined(negative.product_issues(stage(_spoken_negative(spark, sf))), "top_issues")


def product_keyword_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every keyword of the ten products with the most negative reviews."""
    low = stage(_spoken_negative(spark, sf))
    return negative.product_keywords(low, negative.top_products(low))


def negative_report_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The report written as CSV and read back: top keywords (no product) and those of the top products."""
    spoken = cleaning.add_text_columns(views.load(spark, sf, views.SPOKEN_RATINGS))
    path = scratch_path(spark, "report")
    report = jobs.negative_report(spoken)
    review_files.write_analysis(report["keywords"], report["products"], path, report["product_keywords"])
    read = lambda name, schema: spark.read.schema(schema).csv(f"{path}/{name}", header=True, quote='"', escape='"')
    overall = read("negative_keywords_categorized", "keyword string, frequency long, category string")
    own = read("top_negative_product_keywords", "product_id string, keyword string, frequency long")
    return own.unionByName(overall, allowMissingColumns=True)


# --- description features ------------------------------------------------------------------


def average_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.average_rank(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_extendedprice")


def description_item_counts(spark: SparkSession, sf: str) -> DataFrame:
    return correlation.item_counts(views.with_item_maps(views.product_rows(spark, sf)))


def score_bins(spark: SparkSession, sf: str) -> DataFrame:
    info = stage(views.product_rows(spark, sf).select("num_ratings", *correlation.TARGETS))
    score = correlation.score_bins(info).withColumn("variable", F.lit("score"))
    index = correlation.score_bins(info, "score_polarization_index", 50).withColumn("variable", F.lit("polarization"))
    return rounded(score.unionByName(index), "bin_lo", "bin_hi", "bin_mid")


def description_length_bins(spark: SparkSession, sf: str) -> DataFrame:
    binned = correlation.length_bins(views.product_info(spark, sf), good_score=GOOD_SCORE)
    return rounded(binned, "bin_lo", "bin_hi", "bin_mid", "good_score_proportion", "low_polarity_proportion")


def image_count_quality(spark: SparkSession, sf: str) -> DataFrame:
    quality = correlation.image_count_quality(views.product_rows(spark, sf), good_score=GOOD_SCORE)
    return rounded(quality, "good_score_proportion", "low_polarity_proportion")


def spearman_images(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlation.image_correlation(views.product_rows(spark, sf)), "corr", "t")


def correlation_p_values(spark: SparkSession, sf: str) -> DataFrame:
    table = correlation.image_correlation(views.product_rows(spark, sf), with_p_value=True)
    return rounded(table, "corr", "t", "p_value")


def spearman_description_length(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlation.length_correlation(views.product_info(spark, sf)), "corr", "t")


def _reading(texts: DataFrame) -> DataFrame:
    return text_functions.reading_ease(texts, "product_description")


def _marketing(texts: DataFrame) -> DataFrame:
    scored = sentiment.lexicon_sentiment(texts, "product_description", POLARITY)
    return text_functions.marketing_tone(scored, "product_description", TONE_WORDS)


def spearman_marketing(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlation.marketing_correlation(views.measured_products(spark, sf, _marketing), TONE_WORDS), "corr", "t")


def spearman_reading_ease(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlation.reading_correlation(views.measured_products(spark, sf, _reading)), "corr", "t")


def _described_items(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings and description maps of the products, staged because several passes read them."""
    rows = views.with_item_maps(views.product_rows(spark, sf))
    return stage(rows.select(*correlation.TARGETS, "product_detail", "important_information"))


def _item_table(spark: SparkSession, sf: str) -> DataFrame:
    return correlation.item_correlation(_described_items(spark, sf))


def spearman_description_items(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_item_table(spark, sf), "corr", "t")


def correlated_item_summary(spark: SparkSession, sf: str) -> DataFrame:
    return correlation.correlated_item_summary(_item_table(spark, sf))


def feature_histograms(spark: SparkSession, sf: str) -> DataFrame:
    measured = stage(views.measured_products(spark, sf, lambda texts: _marketing(_reading(texts))))
    tables = correlation.reading_histograms(measured).unionByName(correlation.marketing_histograms(measured, TONE_WORDS))
    return rounded(tables, "bin_lo", "bin_hi")


def score_density(spark: SparkSession, sf: str) -> DataFrame:
    described = _described_items(spark, sf)
    items = ["Best Sellers Rank", "Directions", "Item model number", "Safety Information"]
    return rounded(correlation.score_density(described, items), "x", "density")


def price_density(spark: SparkSession, sf: str) -> DataFrame:
    """Density of a continuous column per group."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    priced = items.select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("price"))
    return rounded(correlation.binned_density(priced, "price", "l_returnflag"), "x", "density")


# --- cleaning rounds -----------------------------------------------------------------------


def observed_cleaning_report(spark: SparkSession, sf: str) -> DataFrame:
    """Counts taken while the reviews are cleaned and written."""
    return cleaning.clean_with_report(text_reviews(spark, sf), stage)[1].select("rows_read", "rows_missing", "rows_duplicate", "rows_kept", "n_text")


def yearly_cleaning_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned reviews by year, written twice: the second time one year has other scores, and only that one is written."""
    cleaned = cleaning.clean_reviews(text_reviews(spark, sf)).drop("keywords", "sentiment_score")
    cleaned = stage(cleaned.withColumn("year", F.year(F.timestamp_seconds("time"))))
    path = scratch_path(spark, "by-year")
    review_files.write_changed(cleaned, path, "year")
    last = cleaned.agg(F.max("year")).scalar()
    revised = cleaned.withColumn("score", F.when(F.col("year") == last, 6 - F.col("score")).otherwise(F.col("score")))
    written = review_files.write_changed(revised, path, "year").select(F.col("year").alias("_year"))
    kept = spark.read.schema(cleaned.schema).parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score_sum"))
    return kept.join(written, F.col("year") == F.col("_year"), "left").select("year", "n", "score_sum", F.col("_year").isNotNull().alias("rewritten"))


def quarantined_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as lines of a review file, some without all fields or with a word for a number: good rows and bad records."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    good = F.concat(key, F.lit(",p"), cust, F.lit(',u,"a, b",1,2,'), (1 + F.col("o_custkey") % 5).cast("string"), F.lit(',1700000000,s,"said ""yes"" twice"'))
    line = F.when(F.col("o_orderkey") % 10 == 3, F.concat(key, F.lit(",p,u,n,1,2,five,1700000000,s,t"))).when(F.col("o_orderkey") % 10 == 7, F.concat(key, F.lit(",broken"))).otherwise(good)
    path = scratch_path(spark, "lines")
    orders.select(line.alias("value")).write.text(path)
    reviews, bad = review_files.read_reviews_checked(spark, path, header=False)
    rows = reviews.select(F.col("id").cast("string").alias("id"), "product_id", "score", "text", F.lit(None).cast("string").alias("record"))
    return rows.unionByName(bad, allowMissingColumns=True)


# --- streams -------------------------------------------------------------------------------


def _deliver(rows: DataFrame, folder: str) -> None:
    """Put a table into the folder a stream reads, as several files."""
    rows.repartition(4).write.mode("append").parquet(folder)


def _drain(spark: SparkSession, result: DataFrame, mode: str, target: str) -> None:
    streams.run_available(result, f"{target}-state", mode, streams.batch_folders(target))


def _delivered_twice(spark: SparkSession, sf: str, name: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Append results of the events, which arrive a second time when the watermark has passed nearly all of them."""
    ensure_settings(spark)
    events = spark.read.parquet(f"{sf}/events.parquet")
    source, target = scratch_path(spark, f"{name}-in"), scratch_path(spark, name)
    for _ in range(2):
        _deliver(events, source)
        result = transform(spark.readStream.schema(events.schema).parquet(source))
        _drain(spark, result, "append", target)
    return spark.read.schema(result.schema).parquet(target).drop("batch")


def event_volume_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that are final; the second delivery comes too late for them."""
    return _delivered_twice(spark, sf, "volume", lambda s: streams.windowed_volume(s, "ts"))


def deduplicated_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Every event once, with one day of state: older repeats are late, newer ones are known."""
    columns = ["event_id", "user_id", "event_type"]
    return _delivered_twice(spark, sf, "unique", lambda s: streams.deduplicate(s, ["event_id"], "ts", "1 day").select(*columns))


def late_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows read and rows too late, for a first and a second delivery of the events under one day of delay."""
    ensure_settings(spark)
    events = spark.read.parquet(f"{sf}/events.parquet")
    source, target = scratch_path(spark, "late-in"), scratch_path(spark, "late")
    counted = []
    for delivery in (1, 2):
        _deliver(events, source)
        unique = streams.deduplicate(spark.readStream.schema(events.schema).parquet(source), ["event_id"], "ts", "1 day")
        progress = streams.run_available(unique.select("event_id"), f"{target}-state", "append", streams.batch_folders(target))
        counted.append((delivery, *streams.late_rows(progress)))
    return spark.createDataFrame(counted, "delivery int, n_rows long, n_late long")


def incremental_product_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Sums updated file by file, scored under the prior of the batch table."""
    reviews = ratings(spark, sf).select("product_id", "helpfulness_numerator", "helpfulness_denominator", "score")
    source, target = scratch_path(spark, "sums-in"), scratch_path(spark, "sums")
    _deliver(reviews, source)
    arriving = spark.readStream.schema(reviews.schema).option("maxFilesPerTrigger", 1).parquet(source)
    sums = streams.incremental_weight_sums(arriving)
    _drain(spark, sums, "update", target)
    updates = spark.read.schema(sums.schema.add("batch", "long")).parquet(target)
    scored = streams.with_prior(streams.latest(updates, "product_id"), scoring.score_prior(reviews))
    return rounded(scored.select("product_id", "num_reviews", *_SCORES), *_SCORES)


class _Stopped(Exception):
    pass


def restarted_product_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Sums per month with expiring state, delivered year by year, where the run of the middle year breaks off and is started again; scored under the batch prior."""
    reviews = ratings(spark, sf).select("product_id", "helpfulness_numerator", "helpfulness_denominator", "score", F.col("review_time").cast("timestamp").alias("review_time"))
    reviews = stage(reviews.withColumn("_year", F.year("review_time")), "_year")
    source, target = scratch_path(spark, "months-in"), scratch_path(spark, "months")
    years = sorted(r[0] for r in reviews.select("_year").distinct().collect())
    write = streams.batch_folders(target)

    def break_off(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        raise _Stopped

    for i, year in enumerate(years):
        # All files of a year are one batch, however many they are: no later batch reaches back behind the watermark.
        delivered = reviews.where(F.col("_year") == year).drop("_year")
        delivered.write.mode("append").parquet(source)
        sums = streams.windowed_weight_sums(spark.readStream.schema(delivered.schema).parquet(source), "review_time")
        run = functools.partial(streams.run_available, sums, f"{target}-state", "update", state_store=streams.ROCKSDB, no_data_batches=False)
        if i == len(years) // 2:
            try:
                run(break_off)
            except StreamingQueryException:
                pass
        run(write)
    updates = spark.read.schema(StructType([*sums.schema, StructField("batch", LongType())])).parquet(target)
    merged = streams.merged_weight_sums(updates)
    scored = streams.with_prior(merged, scoring.score_prior(reviews))
    return rounded(scored.select("product_id", "num_reviews", *_SCORES), *_SCORES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        bayesian_product_scores, bayesian_offer_scores, product_weight_sums, weighted_product_scores, review_weights,
        impossible_votes, product_score_merge, score_preview, score_sample, single_review_product, best_reviewed_product,
        reviews_csv_roundtrip, read_cleaned_reviews, product_json_load, product_files_load, pending_products, pending_rounds,
        page_fields, page_links, page_key_values, page_fill_rate, page_sections,
        page_lists, page_bullets, page_ratings, page_comments,
        product_features, score_polarization, clean_text, tokenize, keywords,
        sentiment_model_score, sentiment_lexicon_score, sentiment_batch_score, review_time_parts, score_distribution_columns,
        marketing_tone, reading_ease, clean_reviews, cleaning_report, table_profile, merge_reviews, enriched_reviews,
        sentiment_outliers, sentiment_gap_stats, outlier_sample, outlier_extremes, sentiment_gap_histogram,
        monthly_review_volume, yearly_review_count, rating_heatmap,
        negative_reviews, negative_keywords_clean, negative_keyword_top, negative_text_keyword_top,
        negative_reason_categories, negative_category_share, product_top_issues, product_keyword_counts,
        negative_report_csv, scored_products, sentiment_word_model,
        average_rank, description_item_counts, score_bins, description_length_bins, image_count_quality,
        correlation_p_values, spearman_images, spearman_description_length, spearman_marketing, spearman_reading_ease,
        spearman_description_items, correlated_item_summary, feature_histograms, score_density, price_density,
        yearly_cleaning_rounds, quarantined_reviews,
        event_volume_stream, deduplicated_stream, late_event_counts, incremental_product_scores, restarted_product_scores,
    )
}
QUERIES["helpfulness_index"] = helpfulness
