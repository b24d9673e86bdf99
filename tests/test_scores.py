from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from criticlens.functions import scores
from criticlens.operators import products, scoring


@pytest.fixture(scope="module")
def slide(spark):
    """Ten five-star reviews without votes and one harsh, popular one."""
    rows = [("p", 5, 0, 0)] * 10 + [("p", 1, 50, 50)]
    return spark.createDataFrame(
        rows, "product_id string, score int, helpfulness_numerator int, helpfulness_denominator int"
    )


def test_weighted_means(slide):
    row = scoring.with_weighted_means(scoring.weight_sums(scoring.review_weights(slide))).first()
    assert row["weighted_mean_simple"] == pytest.approx(100 / 60)
    assert row["weighted_mean_smooth"] == pytest.approx(3.0331, abs=5e-5)


def test_polarization(spark):
    rows = [
        ("one", [0.0, 0.0, 10.0, 0.0, 0.0]),
        ("ends", [50.0, 0.0, 0.0, 0.0, 50.0]),
        ("even", [20.0] * 5),
        ("none", None),
        ("zero", [0.0] * 5),
    ]
    df = spark.createDataFrame(rows, "name string, d array<double>")
    index = {r["name"]: r["i"] for r in df.select("name", scores.polarization(F.col("d")).alias("i")).collect()}
    assert index["one"] == 0
    assert index["ends"] == pytest.approx(8 * 0.5**3.3)
    assert index["even"] == pytest.approx(40 * 0.2**3.3)
    assert index["none"] is None and index["zero"] is None


def test_distribution_columns(spark):
    df = spark.createDataFrame([("[1, 2, 3, 4, 5.9]",), ("bad",), (None,), ("",), ("(5, 4, 3, 2, 1)",)], "score_distribution string")
    rows = [tuple(r)[1:] for r in products.distribution_columns(df).collect()]
    assert rows == [(1, 2, 3, 4, 5), (0,) * 5, (0,) * 5, (0,) * 5, (5, 4, 3, 2, 1)]


def test_helpfulness_index(spark):
    df = spark.createDataFrame([(1, 8), (3, 8), (1, 0), (1, None), (None, 4)], "n int, d int")
    index = [r[0] for r in df.select(scores.helpfulness_index(F.col("n"), F.col("d"))).collect()]
    assert index == [0.12, 0.38, 0.0, None, None]


def test_weights_of_unusual_votes(spark):
    df = spark.createDataFrame([(None, None), (-3, 2), (0, 5), (4, 4)], "n int, d int")
    rows = [tuple(r) for r in df.select(scores.weight_simple(F.col("n")), scores.weight_smooth(F.col("n"), F.col("d"))).collect()]
    assert [r[0] for r in rows] == [1, 1, 1, 4]
    assert rows[0][1] is None and rows[1][1] == 0.05


def random_reviews(n: int = 3000) -> pd.DataFrame:
    rng = random.Random(7)
    rows = []
    for i in range(n):
        product = "hot" if rng.random() < 0.4 else f"p{rng.randrange(300)}"
        d = None if rng.random() < 0.3 else rng.randrange(20)
        rows.append((i, product, rng.randint(1, 5), rng.randrange(12), d))
    return pd.DataFrame(rows, columns=["id", "product_id", "score", "helpfulness_numerator", "helpfulness_denominator"])


def as_spark(spark, frame):
    schema = "id long, product_id string, score int, helpfulness_numerator int, helpfulness_denominator int"
    rows = [tuple(None if pd.isna(v) else (int(v) if not isinstance(v, str) else v) for v in r) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, schema)


def test_product_scores_properties(spark):
    frame = random_reviews()
    result = scoring.product_scores(as_spark(spark, frame)).toPandas().set_index("product_id")
    assert result["num_reviews"].sum() == len(frame)
    mean = frame["score"].mean()
    known = result.dropna(subset=["bayesian_mean_smooth"])
    lo = known[["weighted_mean_smooth"]].assign(c=mean).min(axis=1)
    hi = known[["weighted_mean_smooth"]].assign(c=mean).max(axis=1)
    assert (known["bayesian_mean_smooth"] >= lo - 1e-9).all() and (known["bayesian_mean_smooth"] <= hi + 1e-9).all()
    missing = frame.groupby("product_id")["helpfulness_denominator"].count()
    assert set(result.index[result["weighted_mean_smooth"].isna()]) == set(missing.index[missing == 0])


def test_product_scores_do_not_depend_on_partitions(spark):
    df = as_spark(spark, random_reviews())
    one = scoring.product_scores(df.coalesce(1)).orderBy("product_id").toPandas()
    many = scoring.product_scores(df.repartition(13, "id")).orderBy("product_id").toPandas()
    pd.testing.assert_frame_equal(one, many, rtol=1e-12)


def test_reviews_without_product_count_for_the_mean_only(spark, slide):
    nameless = spark.createDataFrame([(None, 1, 0, 0)] * 11, slide.schema)
    alone = scoring.product_scores(slide).first()
    both = scoring.product_scores(slide.unionByName(nameless)).collect()
    assert len(both) == 1 and both[0]["mean_score"] == alone["mean_score"]
    # one product: its weight is the prior, so the score is halfway to the mean of all reviews
    assert both[0]["bayesian_mean_simple"] == pytest.approx((62 / 22 + both[0]["weighted_mean_simple"]) / 2)


def test_merge_replaces_metric_columns(spark, slide):
    table = spark.createDataFrame([("p", 9.0), ("q", 9.0)], "product_id string, mean_score double")
    rows = {r["product_id"]: r for r in scoring.merge_scores(table, scoring.product_scores(slide)).collect()}
    assert rows["p"]["mean_score"] == pytest.approx(51 / 11)
    assert rows["q"]["num_reviews"] is None
    assert rows["p"]["diff_smooth_vs_simple"] == pytest.approx(3.0331 - 1.6667, abs=1e-4)


def test_impossible_votes(spark):
    df = spark.createDataFrame([(3, 2), (2, 2), (1, None)], "helpfulness_numerator int, helpfulness_denominator int")
    assert scoring.impossible_votes(df).count() == 1
    assert scoring.drop_impossible_votes(df).count() == 2


def test_sample_is_clamped_and_repeatable(spark):
    made = scoring.product_scores(as_spark(spark, random_reviews()))
    few = [r["product_id"] for r in scoring.score_sample(made, 20).collect()]
    assert few == [r["product_id"] for r in scoring.score_sample(made, 20).collect()] and len(few) == 20
    assert few != [r["product_id"] for r in scoring.score_sample(made, 20, seed=1).collect()]
    assert scoring.score_sample(made, 10_000).count() <= made.count()
