from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from criticlens.operators import cleaning, products, sentiment, timeseries

SCHEMA = "id long, product_id string, user_id string, helpfulness_numerator int, helpfulness_denominator int, score int, text string"
ROWS = [
    (3, "p", "u", 1, 2, 5, "third"),
    (1, "p", "u", 1, 0, 5, "The first one!"),
    (2, "p", None, 0, None, 5, "no user"),
    (4, "p", None, 0, None, 5, "no user again"),
    (5, None, "u", 0, 0, 5, "no product"),
    (6, "q", "u", 0, 0, None, "no score"),
    (7, "q", "u", 0, 0, 4, None),
]


def test_clean_reviews(spark):
    cleaned = cleaning.clean_reviews(spark.createDataFrame(ROWS, SCHEMA))
    assert cleaned.columns == ["id", "product_id", "user_id", "helpfulness_index", "score", "text_cleaned", "keywords"]
    rows = {r["id"]: r for r in cleaned.collect()}
    assert set(rows) == {1, 2}
    assert rows[1]["text_cleaned"] == "the first one" and rows[1]["keywords"] == ["first", "one"]
    assert rows[1]["helpfulness_index"] == 0 and rows[2]["helpfulness_index"] is None


def test_dedup_is_idempotent_and_ignores_order(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    once = cleaning.keep_first(df, cleaning.REVIEW_KEY, ["id"])
    twice = cleaning.keep_first(once.repartition(5), cleaning.REVIEW_KEY, ["id"])
    assert sorted(r["id"] for r in once.collect()) == sorted(r["id"] for r in twice.collect()) == [1, 2, 5, 6, 7]


def test_cleaning_report_and_profile(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert tuple(cleaning.cleaning_report(df).first()) == (7, 3, 2, 2)
    profile = cleaning.table_profile(df).first()
    assert (profile["n_rows"], profile["n_user_id"], profile["n_score"], profile["distinct_product_id"]) == (7, 5, 6, 2)
    assert tuple(cleaning.cleaning_report(df.limit(0)).first()) == (0, 0, 0, 0)


def test_merge_prefers_reviews(spark):
    day = datetime.datetime(2025, 8, 27)
    reviews = spark.createDataFrame([(8, "p", 4, day, "Good", "original", "u")], "id long, product_id string, score int, review_time timestamp, summary string, text string, user_id string")
    comment = "struct<date:string,title:string,score:string,text:string,helpfulness:string>"
    comments = [
        ("August 27, 2025", "Good", "4.0 out of 5 stars", "copy", "One"),
        ("August 27, 2025", "Bad", "1.0 out of 5 stars", "new", "1,234"),
        ("Augustus 27, 2025", None, None, "odd", "0"),
        ("2 May 2024", "UK", "3.0 out of 5 stars", "british", "2"),
    ]
    documents = spark.createDataFrame([("x", comments), ("y", comments[:2]), ("z", [])], f"product_id string, top_comments array<{comment}>")
    merged = {r["text"]: r for r in products.merge_reviews(reviews, products.product_comments(documents)).collect()}
    assert set(merged) == {"original", "new", "odd", "british"}
    assert merged["original"]["id"] == 8 and merged["new"]["user_id"] is None
    assert merged["new"]["product_id"] == "x" and merged["new"]["helpfulness_numerator"] == 1234
    assert merged["british"]["review_time"] == datetime.datetime(2024, 5, 2)
    assert merged["odd"]["review_time"] is None and merged["odd"]["score"] is None


def test_time_series_fill_gaps(spark):
    times = ["2020-11-30 10:00:00", "2021-02-01 00:00:00", "2021-02-28 23:59:59", "2023-01-01 00:00:00", None]
    df = spark.createDataFrame([(t, 4) for t in times], "t string, score int").withColumn("review_time", F.col("t").cast("timestamp"))
    months = {str(r["month"])[:7]: r["review_count"] for r in timeseries.monthly_volume(df).collect()}
    assert len(months) == 27 and sum(months.values()) == 4
    assert months["2020-11"] == 1 and months["2020-12"] == 0 and months["2021-02"] == 2 and months["2023-01"] == 1
    years = {r["year"]: r["review_count"] for r in timeseries.yearly_count(df).collect()}
    assert years == {2020: 1, 2021: 2, 2022: 0, 2023: 1}
    heat = {r["year"]: r for r in timeseries.rating_heatmap(df).collect()}
    assert heat[2021]["m2"] == 4 and heat[2021]["m1"] is None and 2022 not in heat
    assert timeseries.monthly_volume(df.where("t IS NULL")).count() == 0


def test_time_parts_accept_epoch_and_text(spark):
    df = spark.createDataFrame([("1104537600",), ("2005-01-01",), ("bad",), ("99999999999999999",)], "t string")
    years = [r["year"] for r in timeseries.time_parts(df, "t").collect()]
    assert years == [2005, 2005, None, None]
    numbers = spark.createDataFrame([(1104537600,), (10**17,)], "t long")
    assert [r["year"] for r in timeseries.time_parts(numbers, "t").collect()] == [2005, None]


def test_outliers(spark):
    rows = [(i, "p", 4, 0.8) for i in range(40)] + [(40, "p", 1, 0.99), (41, "p", None, 0.5)]
    df = spark.createDataFrame(rows, "id long, product_id string, score int, sentiment_score double")
    found = {r["id"]: r for r in sentiment.sentiment_outliers(df).collect()}
    assert found[40]["is_outlier"] and not found[0]["is_outlier"] and found[41]["is_outlier"] is False
    assert [r["id"] for r in sentiment.outlier_sample(df).collect()] == [40]
    assert [r["id"] for r in sentiment.outlier_sample(df, by="abs_z").collect()] == [40]
    stats = sentiment.gap_stats(df).first()
    assert (stats["n_outliers"], stats["n_reviews"]) == (1, 42)
