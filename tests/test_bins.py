from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from criticlens.operators import bins, correlation


def doubles(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double")


def test_cut_is_closed_on_the_right(spark):
    values = [0.0, 1.0, 1.0, 2.5, 4.0, 10.0, None]
    counted = bins.cut_counts(doubles(spark, values), "v", 5).orderBy("bin").collect()
    expected = pd.cut(pd.Series(values), bins=5).value_counts(sort=False)
    assert [r["n_samples"] for r in counted] == list(expected)
    edges = [(i.left, i.right) for i in expected.index]
    assert [(round(r["bin_lo"], 3), r["bin_hi"]) for r in counted] == edges


def test_cut_of_a_constant(spark):
    counted = bins.cut_counts(doubles(spark, [3.0, 3.0]), "v", 3).collect()
    assert sum(r["n_samples"] for r in counted) == 2 and len(counted) == 3


def test_cut_of_nothing(spark):
    assert bins.cut_counts(doubles(spark, [None]), "v", 3).count() == 0


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(5)
    values = [float(v) for v in rng.normal(size=500)]
    df = doubles(spark, values + [None]).withColumn("w", F.lit(2.0))
    rows = bins.histograms(df, ["v", "w"], 20).toPandas().sort_values(["variable", "bin"])
    counts, edges = np.histogram(values, bins=20)
    v = rows[rows["variable"] == "v"]
    assert list(v["n"]) == list(counts)
    assert np.allclose(v["bin_lo"], edges[:-1]) and np.allclose(v["bin_hi"], edges[1:])
    w = rows[rows["variable"] == "w"]
    assert w["n"].sum() == 501 and w["bin_lo"].iloc[0] == 1.5


def test_score_bins_count_tenths(spark):
    df = doubles(spark, [1.0, 1.4, 2.0, 5.0]).withColumnRenamed("v", "score").withColumn("num_ratings", F.lit(30))
    rows = correlation.score_bins(df).collect()
    assert len(rows) == 41 and sum(r["n_samples"] for r in rows) == 4
    assert correlation.score_bins(df.withColumn("num_ratings", F.lit(20))).count() == 0


def test_image_quality_counts_missing_as_not_good(spark):
    rows = [(0, 4.9, 0.1, 11), (0, None, None, 11), (1, 5.0, 0.5, 10)]
    df = spark.createDataFrame(rows, "count_alt_images int, score double, score_polarization_index double, num_ratings int")
    only = correlation.image_count_quality(df).collect()
    assert len(only) == 1
    assert (only[0]["n_samples"], only[0]["good_score_proportion"], only[0]["low_polarity_proportion"]) == (1, 0.5, 0.5)
    assert correlation.image_count_quality(df, good_score=4.9).first()["good_score_proportion"] == pytest.approx(0)
