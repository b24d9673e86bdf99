"""Sentiment scores, and the reviews whose rating disagrees with them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from criticlens.functions.text import add_once, clean_text, lexicon_sentiment, tokenize, with_tokens
from criticlens.operators.joins import hot_keys, lookup_join
from criticlens.session import shuffle_width, stage

__all__ = [
    "gap_stats", "lexicon_sentiment", "odds_predictor", "outlier_sample", "score_sentiment", "score_with_model", "score_word_odds",
    "sentiment_gap", "sentiment_outliers", "train_sentiment", "train_word_odds",
]


#: A table of word odds up to this size is broadcast: some tens of bytes a word.
FEW_WORDS = 200_000


def train_sentiment(
    df: DataFrame, text_col: str, label_col: str, n_features: int = 1 << 16, max_iter: int = 20
) -> PipelineModel:
    """Logistic regression on hashed words, trained on a labelled table (1 is positive)."""
    labelled = df.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    words = with_tokens(labelled, text_col).select("_tokens", F.col(label_col).cast("double").alias("_label"))
    hashing = HashingTF(numFeatures=n_features, inputCol="_tokens", outputCol="_tf")
    # The counts are staged, since both fits read them, and spread evenly for the iterations.
    counted = stage(hashing.transform(words).select("_tf", "_label").repartition(shuffle_width(df.sparkSession)))
    weighting = IDF(inputCol="_tf", outputCol="_features").fit(counted)
    classifier = LogisticRegression(
        featuresCol="_features", labelCol="_label", probabilityCol="_probability", regParam=0.1, maxIter=max_iter
    ).fit(weighting.transform(counted))
    return PipelineModel([hashing, weighting, classifier])


def score_sentiment(df: DataFrame, text_col: str, model: PipelineModel) -> DataFrame:
    """Add ``sentiment_score``: probability that the whole text is positive."""
    prepared = with_tokens(df, text_col).drop("_cleaned")
    scored = model.transform(prepared).withColumn("sentiment_score", vector_to_array("_probability").getItem(1))
    return scored.select(*df.columns, "sentiment_score")


def _word_rows(df: DataFrame, text_col: str, keep: str) -> DataFrame:
    """``keep`` and ``word``, one row per word; the words of a text are split once, whatever the explode filters on."""
    cleaned = df.select(F.col(keep), clean_text(F.col(text_col)).alias("_cleaned"))
    return add_once(cleaned, {"_tokens": tokenize(F.col("_cleaned"))}).select(F.col(keep), F.explode("_tokens").alias("word"))


def train_word_odds(df: DataFrame, text_col: str, label_col: str, smoothing: float = 1.0, top: int | None = None) -> DataFrame:
    """(word, log_odds, n): multinomial log-odds and frequency of every word of a labelled table (1 is positive, 0 negative).

    Counts are aggregated before the shuffle; the totals are a one-row subquery. Rows without a text or a label are left out.
    With ``top`` only that many of the most frequent words are given, ties by word; the totals are still those of all words.
    """
    labelled = df.where(F.col(text_col).isNotNull() & F.col(label_col).isin(0, 1))
    words = _word_rows(labelled, text_col, label_col).withColumnRenamed(label_col, "_label")
    counts = stage(words.groupBy("word").agg(F.count_if(F.col("_label") == 1).alias("pos"), F.count_if(F.col("_label") == 0).alias("neg")))
    sums = F.struct(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count(F.lit(1)).alias("words"))
    total = counts.agg(sums).scalar()

    def log_share(kind: str) -> Column:
        return F.log((F.col(kind) + smoothing) / (total.getField(kind) + smoothing * total.getField("words")))

    given = counts if top is None else counts.orderBy(F.desc(F.col("pos") + F.col("neg")), "word").limit(top)
    return given.select("word", (log_share("pos") - log_share("neg")).alias("log_odds"), (F.col("pos") + F.col("neg")).alias("n"))


def odds_predictor(odds: DataFrame) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """The model of :func:`score_with_model` for texts of words separated by spaces: the score of ``score_word_odds``.

    The table is collected and broadcast, so it must be bounded: learned with ``top``.
    """
    sent = odds.sparkSession.sparkContext.broadcast({r["word"]: r["log_odds"] for r in odds.collect()})

    def load() -> Callable[[np.ndarray], np.ndarray]:
        known = sent.value

        def predict(texts: np.ndarray) -> np.ndarray:
            total = np.array([sum(known.get(w, 0.0) for w in t.split(" ")) for t in texts], float)
            return 1 / (1 + np.exp(-np.clip(total, -500.0, 500.0)))

        return predict

    return load


def score_word_odds(df: DataFrame, id_col: str, text_col: str, odds: DataFrame) -> DataFrame:
    """``id_col``, ``log_odds`` (sum over the words of the text, unknown words 0) and ``sentiment_score``, per distinct id.

    A table of at most ``FEW_WORDS`` words is broadcast to the texts. Of a larger one with frequencies ``n``, about that many of the most
    frequent words are, and meet nearly all words of the texts there; only the others are shuffled. Such a word counts once per text and
    meets its odds with its frequency; words in very many texts are spread over parts. A text without known words has odds 0 and the score 0.5;
    rows without an id are left out.
    """
    rows = df.where(F.col(id_col).isNotNull())
    words = _word_rows(rows, text_col, id_col)
    odds = stage(odds)
    n_words = odds.count()
    if n_words <= FEW_WORDS:
        # The words of a text meet their odds in the task that reads it; only sums per text are shuffled.
        parts = words.join(F.broadcast(odds), "word").withColumn("n", F.lit(1))
    else:
        # At most FEW_WORDS words, but for the error of the sketch, are more frequent than this.
        often = odds.agg(F.percentile_approx("n", 1 - FEW_WORDS / n_words)).scalar() if "n" in odds.columns else F.lit(None)
        frequent = odds.where((F.col("n") if "n" in odds.columns else F.lit(0)) > often)
        met = words.join(F.broadcast(frequent.select("word", "log_odds")), "word", "left")
        # The frequent words of a text are one row here, each other word is one with its count.
        rare = F.when(F.col("log_odds").isNull(), F.col("word")).alias("word")
        counts = stage(met.groupBy(id_col, rare).agg(F.count(F.lit(1)).alias("n"), F.sum("log_odds").alias("log_odds")))
        others = counts.where(F.col("word").isNotNull()).drop("log_odds")
        hot = hot_keys(others.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word")
        joined = lookup_join(others, odds.select("word", "log_odds"), "word", hot)
        summed = counts.where(F.col("word").isNull()).withColumn("n", F.lit(1).cast("long"))
        parts = joined.unionByName(summed)
    sums = parts.groupBy(id_col).agg(F.sum(F.col("n") * F.col("log_odds")).alias("log_odds"))
    scored = rows.select(id_col).distinct().join(sums, id_col, "left")
    total = F.coalesce("log_odds", F.lit(0.0))
    clipped = F.greatest(F.least(total, F.lit(500.0)), F.lit(-500.0))
    return scored.select(id_col, total.alias("log_odds"), (1 / (1 + F.exp(-clipped))).alias("sentiment_score"))


def score_with_model(
    df: DataFrame, text_col: str, make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 64
) -> DataFrame:
    """Add ``sentiment_score`` from a model of the user's own.

    ``make_predict`` runs once per Python worker, loads the model and returns a function from an
    array of texts to an array of probabilities. Texts come in Arrow batches.
    """
    predict = predict_batch_udf(make_predict, return_type=DoubleType(), batch_size=batch_size)
    return df.withColumn("sentiment_score", predict(F.col(text_col)))


def sentiment_gap(df: DataFrame) -> DataFrame:
    """Add the sentiment on the rating scale and the rating minus it."""
    scaled = df.withColumn("sentiment_score_scaled", F.col("sentiment_score") * 5)
    return scaled.withColumn("sentiment_gap", F.col("score") - F.col("sentiment_score_scaled"))


def sentiment_outliers(df: DataFrame, z: float = 2.0) -> DataFrame:
    """Add ``z_score`` of the gap and ``is_outlier``. Mean and deviation are a one-row subquery."""
    gaps = sentiment_gap(df)
    stats = gaps.agg(
        F.struct(F.avg("sentiment_gap").alias("mean"), F.stddev_samp("sentiment_gap").alias("std"))
    ).scalar()
    score = F.try_divide(F.col("sentiment_gap") - stats.getField("mean"), stats.getField("std"))
    return gaps.withColumn("z_score", score).withColumn(
        "is_outlier", F.coalesce(F.abs("z_score") > z, F.lit(False))
    )


def gap_stats(df: DataFrame, z: float = 2.0) -> DataFrame:
    """One row: mean and deviation of the gap, outliers and all reviews."""
    return sentiment_outliers(df, z).agg(
        F.avg("sentiment_gap").alias("mean_gap"),
        F.stddev_samp("sentiment_gap").alias("std_gap"),
        F.count_if("is_outlier").alias("n_outliers"),
        F.count(F.lit(1)).alias("n_reviews"),
    )


def outlier_sample(df: DataFrame, n: int = 10, by: str = "id", z: float = 2.0) -> DataFrame:
    """The first ``n`` outliers by id, or the ``n`` most extreme with ``by="abs_z"``."""
    outliers = sentiment_outliers(df, z).where("is_outlier")
    order = ["id"] if by == "id" else [F.desc(F.abs("z_score")), F.col("id")]
    return outliers.orderBy(*order).limit(n)
