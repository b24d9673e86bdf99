from __future__ import annotations

import math
import time

import pytest
from pyspark.sql import functions as F

from criticlens.functions import text
from criticlens.functions.words import REASON_CATEGORIES, STOP_WORDS
from criticlens.operators import negative
from criticlens.operators.cleaning import add_text_columns

TEXTS = [
    ("empty", ""),
    ("missing", None),
    ("accents", "Café Crème, très BON!"),
    ("contraction", "I don't like it"),
    ("cannot", "I cannot; CANNOT gonna scannot cannoty"),
    ("spaces", "  two\t\twords   here  "),
    ("hyphen", "A must-have BEST buy"),
    ("comma", "the best, ever"),
    ("three", "Wonderful. A delicious meal! Is it?"),
    ("underscore", "snake_case 42"),
    ("symbols", "!!! ... ???"),
    ("newline", "line one\nline two"),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "name string, text string")


def by_name(df, column):
    return {r["name"]: r[column] for r in df.collect()}


def test_clean_text(texts):
    cleaned = by_name(texts.withColumn("c", text.clean_text(F.col("text"))), "c")
    assert cleaned["empty"] == ""
    assert cleaned["missing"] is None
    assert cleaned["accents"] == "café crème très bon"
    assert cleaned["contraction"] == "i dont like it"
    assert cleaned["spaces"] == "two words here"
    assert cleaned["underscore"] == "snake_case 42"
    assert cleaned["symbols"] == ""
    assert cleaned["newline"] == "line one line two"


def test_tokens(texts):
    tokens = by_name(text.with_tokens(texts, "text"), "_tokens")
    assert tokens["empty"] == tokens["missing"] == tokens["symbols"] == []
    assert tokens["cannot"] == ["i", "can", "not", "can", "not", "gon", "na", "scannot", "cannoty"]
    assert tokens["spaces"] == ["two", "words", "here"]


def test_keywords_keep_words_without_apostrophe(texts):
    keywords = by_name(add_text_columns(texts), "keywords")
    assert keywords["contraction"] == ["dont", "like"]
    assert keywords["missing"] == []
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 179


def test_marketing_tone(texts):
    tone = by_name(text.marketing_tone(texts, "text"), "marketing_tone_score")
    assert tone["hyphen"] == pytest.approx(2 / 5 * 100)
    assert tone["comma"] == 0
    assert tone["empty"] == 0
    assert tone["missing"] is None


def test_description_length(texts):
    length = by_name(texts.withColumn("n", text.description_length(F.col("text"))), "n")
    assert length["empty"] == 0
    assert length["three"] == pytest.approx(math.log2(6))
    assert length["spaces"] == pytest.approx(math.log2(len(TEXTS[5][1].split(" "))))


def test_reading_ease(texts):
    rows = {r["name"]: r for r in text.reading_ease(texts, "text").collect()}
    # "Wonderful. A delicious meal! Is it?": 6 words, 3 sentences, vowel groups 3+1+3+1+1+1, 2 complex words
    row = rows["three"]
    assert row["flesch_reading_ease"] == pytest.approx(206.835 - 1.015 * 2 - 84.6 * 10 / 6)
    assert row["flesch_kincaid_grade"] == pytest.approx(0.39 * 2 + 11.8 * 10 / 6 - 15.59)
    assert row["gunning_fog"] == pytest.approx(0.4 * (2 + 100 * 2 / 6))
    assert rows["empty"]["flesch_reading_ease"] == rows["symbols"]["gunning_fog"] == 0


def test_lexicon_sentiment(texts):
    scored = by_name(text.lexicon_sentiment(texts, "text", {"best": 1, "delicious": 1, "cannoty": -1}), "sentiment_score")
    assert scored["hyphen"] == pytest.approx(2 / 3)
    assert scored["cannot"] == pytest.approx(1 / 3)
    assert scored["empty"] == 0.5


def test_categories(spark):
    words = spark.createDataFrame([("sour",), ("taste",), ("large",), ("thing",)], "keyword string")
    category = {r["keyword"]: r["category"] for r in negative.categorize(words).collect()}
    assert category == {"sour": "smell", "taste": "taste", "large": "quantity", "thing": "other"}
    terms = [t for listed in REASON_CATEGORIES.values() for t in listed]
    assert len(REASON_CATEGORIES) == 8 and len(terms) - 1 == len(set(terms))


def test_clean_keywords(spark):
    rows = [
        (1, ["boxes", "box", "berries", "berry", "glass", "glas"]),
        (2, ["Boxes", "product", "ab", "leaves", "leaf", "items", "item", "firemen", "fireman"]),
        (3, []),
        (4, None),
    ]
    df = spark.createDataFrame(rows, "id int, keywords array<string>")
    cleaned = {r["id"]: r["cleaned_keywords"] for r in negative.clean_keywords(df).collect()}
    assert cleaned[1] == ["box", "box", "berry", "berry", "glas", "glas"]
    assert cleaned[2] == ["box", "leaf", "leaf", "fireman", "fireman"]
    assert cleaned[3] == []
    assert not cleaned[4]


def test_clean_keywords_with_one_word_everywhere(spark):
    """A word in every row is spread over tasks and still looked up for each of them."""
    df = spark.range(2000).select("id", F.array(F.lit("boxes"), F.concat(F.lit("word"), "id")).alias("keywords"))
    one = spark.createDataFrame([(9999, ["box"])], "id bigint, keywords array<string>")
    cleaned = negative.clean_keywords(df.unionByName(one))
    assert cleaned.where(F.get("cleaned_keywords", F.lit(0)) == "box").count() == 2001


def test_clean_keywords_is_linear_in_the_row(spark):
    """One very long row: the time of a word does not grow with the words of its row."""

    def seconds(n):
        words = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(n // 2)), lambda i: F.array(
            F.concat(F.lit("word"), F.translate(i.cast("string"), "0123456789", "abcdefghij"), F.lit("s")),
            F.concat(F.lit("word"), F.translate(i.cast("string"), "0123456789", "abcdefghij")),
        )))
        df = spark.range(1).select("id", words.alias("keywords"))
        begin = time.perf_counter()
        row = negative.clean_keywords(df).select(F.array_distinct("cleaned_keywords").alias("w"), "cleaned_keywords").first()
        assert len(row["cleaned_keywords"]) == n // 2 * 2
        assert len(row["w"]) < n
        return time.perf_counter() - begin

    seconds(4000)
    short, long = seconds(4000), seconds(64000)
    assert long < 16 * max(short, 1.0)


def test_top_keywords_break_ties_by_name(spark):
    df = spark.createDataFrame([(["b", "a", "c", "c"],)], "cleaned_keywords array<string>")
    assert [tuple(r) for r in negative.top_keywords(df, 2).collect()] == [("c", 2), ("a", 1)]
