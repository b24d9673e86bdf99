"""Steps that several product queries share, on tables of their own."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from criticlens.operators import correlation, scoring, sentiment
from criticlens.plans import adapters as views
from criticlens.plans import registry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """60 parts described by 7 documents (one without a text, one key twice), with 900 rated items."""
    path = tmp_path_factory.mktemp("shared")
    key = F.col("id")
    rows = {
        "documents": spark.range(7).select(
            F.when(key < 6, key).otherwise(5).alias("doc_id"),
            F.when(key != 3, F.concat(F.lit("the "), F.repeat(F.lit("but nice und. "), key.cast("int")), F.lit("Sentence number one."))).alias("text"),
        ),
        "part": spark.range(60).select(
            key.alias("p_partkey"), F.lit("name").alias("p_name"), F.lit("brand").alias("p_brand"), F.lit("PROMO").alias("p_type"), (key % 50).cast("int").alias("p_size")
        ),
        "orders": spark.range(90).select(key.alias("o_orderkey"), (key % 5).alias("o_custkey")),
        "lineitem": spark.range(900).select(
            (key % 90).alias("l_orderkey"), (key % 61).alias("l_partkey"), (1 + key % 60).alias("l_suppkey"), (1 + key % 4).cast("int").alias("l_linenumber"),
            (1 + (key * key) % 50).cast("double").alias("l_quantity"), ((key % 11) / 100).alias("l_discount"), ((key % 9) / 100).alias("l_tax"),
            F.when(key % 3 > 0, "A").otherwise("N").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), F.lit("2020-01-01").cast("timestamp").alias("l_shipdate"),
        ),
    }
    for name, table in rows.items():
        table.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def values(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in df.select(*sorted(df.columns)).collect())


def test_a_text_is_measured_once_however_many_products_it_describes(spark, tables, monkeypatch):
    plain = sentiment.lexicon_sentiment
    described = plain(views.product_info(spark, tables), "product_description", registry.POLARITY)
    expected = {
        "spearman_marketing": values(correlation.marketing_correlation(described, registry.TONE_WORDS)),
        "spearman_reading_ease": values(correlation.reading_correlation(described)),
        "feature_histograms": values(correlation.reading_histograms(described).unionByName(correlation.marketing_histograms(described, registry.TONE_WORDS))),
    }
    measured = []
    monkeypatch.setattr(sentiment, "lexicon_sentiment", lambda df, *rest: measured.append(df.count()) or plain(df, *rest))
    assert {name: values(registry.QUERIES[name](spark, tables)) for name in expected} == expected
    assert measured == [6, 6]


@pytest.mark.parametrize("name", ["scored_products", "product_score_merge"])
def test_items_are_joined_with_their_orders_once(spark, tables, monkeypatch, name):
    scores = scoring.product_scores(registry.ratings(spark, tables))
    expected = {r["product_id"]: (r["num_reviews"], round(r["bayesian_mean_simple"], 6)) for r in scores.collect()}
    plans, keep = [], registry.stage

    def staged(table):
        plans.append(table)
        return keep(table)

    for module in (registry, scoring):
        monkeypatch.setattr(module, "stage", staged)
    result = registry.QUERIES[name](spark, tables)
    plans.append(result)
    joined = ["o_orderkey" in table._jdf.queryExecution().optimizedPlan().toString() for table in plans]
    assert sum(joined) == 1
    got = {r["product_id"]: (r["num_reviews"], r["bayesian_mean_simple"]) for r in result.collect()}
    assert got == {k: v for k, v in expected.items() if k != "60"}
