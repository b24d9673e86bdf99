from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from criticlens.functions import stats
from criticlens.operators import correlation, ranks
from criticlens.operators.joins import hot_keys, lookup_join
from criticlens.session import stage


def frame(n=1500, seed=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = 5.0 if rng.random() < 0.4 else round(rng.uniform(1, 5), 2)
        y = None if rng.random() < 0.1 else rng.gauss(0, 1) + 0.3 * x
        z = rng.randrange(4)
        rows.append((x, y, float(z)))
    return pd.DataFrame(rows, columns=["x", "y", "z"])


def as_spark(spark, data):
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in data.itertuples(index=False)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data.columns))


def brute_ranks(values: list[float]) -> list[float]:
    return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]


@pytest.mark.parametrize("n_buckets", [1, 2, 7, 64])
def test_average_ranks_match_brute_force(spark, n_buckets):
    data = frame(400)
    counts = stage(ranks.value_counts(as_spark(spark, data), ["x", "z"]))
    result = ranks.average_ranks(counts, n_buckets).collect()
    for column in ("x", "z"):
        values = list(data[column])
        expected = dict(zip(values, brute_ranks(values)))
        assert {r["value"]: r["rank"] for r in result if r["variable"] == column} == expected


@pytest.mark.parametrize("n", [1, 2, 5, 400])
def test_exact_median(spark, n):
    data = frame(n)
    medians = {r["variable"]: r["median"] for r in ranks.exact_medians(as_spark(spark, data), ["x", "z"]).collect()}
    assert medians["x"] == pytest.approx(np.median(data["x"]))
    assert medians["z"] == pytest.approx(np.median(data["z"]))


def test_spearman_matches_brute_force(spark):
    data = frame()
    complete = data.dropna()
    pairs = [("x", "y"), ("z", "y")]
    result = {r["feature"]: r for r in correlation.spearman(as_spark(spark, data), pairs).collect()}
    for a, b in pairs:
        expected = np.corrcoef(complete[a].rank(), complete[b].rank())[0, 1]
        assert result[a]["corr"] == pytest.approx(expected, abs=1e-12)
        assert result[a]["n"] == len(complete)


def test_constant_column_has_no_correlation(spark):
    df = as_spark(spark, frame(50)).withColumn("x", F.lit(1.0))
    row = correlation.with_conclusion(correlation.spearman(df, [("x", "y")]), with_p_value=True).first()
    assert row["corr"] is None and row["t"] is None and row["conclusion"] == stats.NOT_SIGNIFICANT


def test_perfect_correlation(spark):
    df = spark.range(30).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    row = correlation.with_conclusion(correlation.spearman(df, [("x", "y")]), with_p_value=True).first()
    assert row["corr"] == pytest.approx(1.0) and row["p_value"] < 1e-12 and row["conclusion"] == "Highly correlated"


def p_values(spark, pairs):
    df = spark.createDataFrame(pairs, "t double, n bigint")
    return [r[0] for r in df.select(stats.p_value(F.col("t"), F.col("n"))).collect()]


def finite_sum_p(t, nu):
    """The finite trigonometric sum of Student's t for whole degrees of freedom."""
    angle = math.atan(abs(t) / math.sqrt(nu))
    term, total = 1.0, 0.0
    if nu % 2 == 0:
        for k in range(nu // 2):
            total += term
            term *= (2 * k + 1) / (2 * k + 2) * math.cos(angle) ** 2
        return 1 - math.sin(angle) * total
    term = math.cos(angle)
    for k in range((nu - 1) // 2):
        total += term
        term *= (2 * k + 2) / (2 * k + 3) * math.cos(angle) ** 2
    return 1 - 2 / math.pi * (angle + math.sin(angle) * total)


def test_p_values(spark):
    def t(r, n):
        return r * ((n - 2) / (1 - r * r)) ** 0.5, n

    given = p_values(spark, [t(0.0588, 3354), t(-0.0469, 3354), t(0.3809, 3354)])
    assert given[0] == pytest.approx(0.000657, rel=5e-3)
    assert given[1] == pytest.approx(0.00659, rel=5e-3)
    assert given[2] == pytest.approx(2.89e-116, rel=2e-2)
    assert p_values(spark, [(0.0, 12), (12.706204736, 3)]) == pytest.approx([1.0, 0.05], rel=1e-6)
    assert p_values(spark, [(1.0, 2), (None, 50)]) == [None, None]


def test_p_values_match_the_finite_sum(spark):
    pairs = [(t, nu + 2) for nu in (1, 2, 3, 4, 19, 20, 21, 50, 2001) for t in (0.0, 1e-9, 0.3, 1.0, 1.7, 3.29, -4.0)]
    for (t, n), p in zip(pairs, p_values(spark, pairs)):
        assert p == pytest.approx(finite_sum_p(t, n - 2), rel=1e-7, abs=1e-10), (t, n)


def test_the_label_follows_p_around_the_threshold(spark):
    """At 20 degrees of freedom p is 0.001 at t = 3.84952."""
    rows = [(t / math.sqrt(20 + t * t), 22) for t in (3.8494, 3.8497)]
    df = correlation.with_conclusion(spark.createDataFrame(rows, "corr double, n bigint"), with_p_value=True)
    below, above = df.orderBy("corr").collect()
    assert below["p_value"] > stats.ALPHA and below["conclusion"] == stats.NOT_SIGNIFICANT
    assert above["p_value"] <= stats.ALPHA and above["conclusion"] == "Highly correlated"


def test_hot_keys_follow_the_width(spark):
    """With 60 % and 2 % of the rows on two keys, no part is larger than one of the partitions."""
    counts = spark.createDataFrame([(1, 600), (2, 20)] + [(k, 1) for k in range(3, 383)], "k int, n bigint")
    hot = dict(hot_keys(counts, "k", width=200))
    assert set(hot) == {1, 2}
    assert all(n / hot[k] <= 1000 / 200 for k, n in ((1, 600), (2, 20)))


def test_lookup_join_with_hot_key(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    table = rows.select("k").distinct().withColumn("label", F.concat(F.lit("l"), "k"))
    hot = hot_keys(rows.groupBy("k").agg(F.count("*").alias("n")), "k")
    assert [k for k, _ in hot] == [-1] and hot[0][1] >= 2
    joined = lookup_join(rows, table, "k", hot)
    assert joined.count() == 3000
    assert joined.where(F.col("label") != F.concat(F.lit("l"), "k")).count() == 0
    assert joined.columns == ["k", "id", "label"]


def items_frame(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        score, polarization = round(rng.uniform(1, 5), 1), round(rng.random(), 3)
        detail = {"#rank": "1"}
        if score > 3:
            detail["Rank"] = "x"
        if rng.random() < 0.5:
            detail["Weight"] = rng.choice(["1 kg", ""])
        if i < 5:
            detail["Rare"] = "y"
        if rng.random() < 0.3:
            detail["Is Discontinued By Manufacturer"] = "No"
        info = {k: "z" for k in ("A", "B", "C", "D") if rng.random() < {"A": 0.5, "B": 0.4, "C": 0.3, "D": 0.1}[k]}
        rows.append((None if rng.random() < 0.1 else score, polarization, detail, info))
    schema = "score double, score_polarization_index double, product_detail map<string,string>, important_information map<string,string>"
    return spark.createDataFrame(rows, schema), rows


def test_item_correlation_matches_brute_force(spark):
    df, rows = items_frame(spark)
    result = correlation.item_correlation(df, with_p_value=True).collect()
    # every item of both sections that is frequent enough and not excluded
    assert {r["item"] for r in result} == {"Rank", "Weight", "A", "B", "C", "D"}
    complete = pd.DataFrame([r for r in rows if r[0] is not None], columns=["score", "index", "product_detail", "important_information"])
    for r in result:
        section = "product_detail" if r["category"] == "detail" else "important_information"
        has = complete[section].map(lambda m: 1 if m.get(r["item"]) else -1)
        target = complete["score" if r["compare_with"] == "score" else "index"]
        expected = np.corrcoef(has.rank(), target.rank())[0, 1]
        assert r["corr"] == pytest.approx(expected, abs=1e-12)
        assert r["num_samples"] == sum(r["item"] in row[2 if section == "product_detail" else 3] for row in rows)
        assert r["n"] == len(complete)
    rank = next(r for r in result if r["item"] == "Rank" and r["compare_with"] == "score")
    assert rank["conclusion"] == "Highly correlated" and rank["p_value"] < 1e-20


def test_score_density_integrates_to_one(spark):
    df, _ = items_frame(spark)
    curves = correlation.score_density(df, ["Rank", "A"]).toPandas()
    assert set(curves["item"]) == {"All", "Rank", "A"}
    for _, curve in curves.groupby("item"):
        ordered = curve.sort_values("point")
        assert len(ordered) == 200
        assert np.trapezoid(ordered["density"], ordered["x"]) == pytest.approx(1, abs=5e-3)
