from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from criticlens.operators import sentiment


def test_trained_model_separates_words(spark):
    rows = [(i, "lovely tasty tea" if i % 2 else "awful stale box", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string, label int")
    model = sentiment.train_sentiment(df, "text", "label", n_features=1 << 10)
    asked = spark.createDataFrame([(1, "tasty tea"), (2, "stale"), (3, ""), (4, None)], "id int, text string")
    scores = {r["id"]: r["sentiment_score"] for r in sentiment.score_sentiment(asked, "text", model).collect()}
    assert scores[1] > 0.5 > scores[2]
    assert all(0 <= s <= 1 for s in scores.values())


def test_own_model_in_batches(spark):
    def make_predict():
        import numpy as np

        return lambda texts: np.array([min(1.0, len(t) / 10) for t in texts])

    df = spark.range(500).select("id", F.repeat(F.lit("x"), (F.col("id") % 20).cast("int")).alias("text"))
    scored = sentiment.score_with_model(df, "text", make_predict, batch_size=16)
    assert scored.where(F.abs(F.col("sentiment_score") - F.least(F.lit(1.0), F.length("text") / 10)) > 1e-9).count() == 0


def test_word_odds_by_hand(spark):
    rows = [(1, "good good fine", 1), (2, "bad fine", 0), (3, None, 1), (4, "", 0), (5, "good", None)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    odds = {r["word"]: r["log_odds"] for r in sentiment.train_word_odds(df, "text", "label").collect()}
    share = {"good": (3 / 6, 1 / 5), "fine": (2 / 6, 2 / 5), "bad": (1 / 6, 2 / 5)}
    assert odds == {w: pytest.approx(math.log(p) - math.log(q)) for w, (p, q) in share.items()}
    scored = {r["id"]: r for r in sentiment.score_word_odds(df, "id", "text", sentiment.train_word_odds(df, "text", "label")).collect()}
    assert scored[1]["log_odds"] == pytest.approx(2 * odds["good"] + odds["fine"])
    assert scored[1]["sentiment_score"] == pytest.approx(1 / (1 + math.exp(-scored[1]["log_odds"])))
    assert [scored[k]["sentiment_score"] for k in (3, 4)] == [0.5, 0.5] and scored[2]["sentiment_score"] < 0.5
    assert sentiment.train_word_odds(df.where("id > 9"), "text", "label").count() == 0


def test_few_and_many_words_score_alike(spark, monkeypatch):
    """A broadcast table of odds and a joined one; and the same model applied in batches."""
    rows = [(k, " ".join(f"w{(k * j) % 23}" for j in range(k % 17)) if k % 5 else None, k % 2) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    odds = sentiment.train_word_odds(df, "text", "label")
    scores = lambda: {r["id"]: round(r["sentiment_score"], 9) for r in sentiment.score_word_odds(df, "id", "text", odds).collect()}
    few = scores()
    monkeypatch.setattr(sentiment, "FEW_WORDS", 0)
    assert scores() == few and len(few) == 200
    words = df.select("id", F.coalesce("text", F.lit("")).alias("text"))
    batches = sentiment.score_with_model(words, "text", sentiment.odds_predictor(odds), batch_size=7).collect()
    assert {r["id"]: round(r["sentiment_score"], 9) for r in batches} == few
    top = sentiment.train_word_odds(df, "text", "label", top=3).collect()
    assert len(top) == 3 and {r["word"] for r in top} <= {r["word"] for r in odds.collect()}


def test_frequent_words_are_not_shuffled(spark, monkeypatch):
    """Of a large table of odds the frequent words meet the texts in place: one row a text is left of them, and rows of rare words."""
    rows = [(k, " ".join(["often good bad fine", f"rare{k % 40}"] * 3), k % 2) for k in range(120)] + [(120, None, 1), (121, "unknown", None)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    odds = sentiment.train_word_odds(df, "text", "label")
    scores = lambda table: {r["id"]: round(r["log_odds"], 9) for r in sentiment.score_word_odds(df, "id", "text", table).collect()}
    expected, staged = scores(odds), []
    keep = sentiment.stage
    monkeypatch.setattr(sentiment, "FEW_WORDS", 10)
    monkeypatch.setattr(sentiment, "stage", lambda table: staged.append(keep(table)) or staged[-1])
    assert scores(odds) == expected
    # 120 rows of frequent words, 120 of rare ones and one of an unknown one; before, a row for each of 5 words a text.
    assert staged[-1].count() == 241
    assert scores(odds.drop("n")) == expected and staged[-1].count() == 601
