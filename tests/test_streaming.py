from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from criticlens.operators import scoring
from criticlens.operators.scoring import review_weights, weight_sums
from criticlens.plans import registry
from criticlens.session import scratch_path
from criticlens.streaming import reviews as streams

START = datetime.datetime(2024, 1, 1)


def stream_of(spark, df, tmp_path, files=1):
    path = str(tmp_path / "in")
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def collected(spark, result, mode):
    target, state = scratch_path(spark, "stream-test"), scratch_path(spark, "stream-state")
    write = "append" if mode == "append" else "overwrite"
    streams.run_available(result, state, mode, lambda batch, _: batch.write.mode(write).parquet(target))
    return spark.read.parquet(target)


@pytest.fixture(scope="module")
def events(spark):
    rows = [(i % 7, START + datetime.timedelta(minutes=11 * i)) for i in range(200)]
    return spark.createDataFrame(rows, "user_id int, ts timestamp")


def test_windowed_volume_equals_batch(spark, events, tmp_path):
    result = streams.windowed_volume(stream_of(spark, events, tmp_path), "ts")
    got = {r["window_start"]: r["n"] for r in collected(spark, result, "append").collect()}
    batch = {r["h"]: r["n"] for r in events.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n")).collect()}
    # windows still open under the watermark are not final yet
    assert got and all(batch[h] == n for h, n in got.items())
    assert set(batch) - set(got) <= {max(batch)}


def test_late_rows_are_left_out(spark, events, tmp_path):
    path = tmp_path / "in"
    events.coalesce(1).write.parquet(str(path))
    late = spark.createDataFrame([(1, START)], events.schema)
    stream = spark.readStream.schema(events.schema).parquet(str(path))
    target, state = scratch_path(spark, "late"), scratch_path(spark, "late-state")

    def run():
        streams.run_available(
            streams.windowed_volume(stream, "ts"), state, "append", lambda b, _: b.write.mode("append").parquet(target)
        )

    run()
    before = spark.read.parquet(target).agg(F.sum("n")).first()[0]
    late.coalesce(1).write.mode("append").parquet(str(path))
    run()
    assert spark.read.parquet(target).agg(F.sum("n")).first()[0] == before


def test_deduplicate_equals_batch(spark, events, tmp_path):
    twice = events.unionByName(events)
    result = streams.deduplicate(stream_of(spark, twice, tmp_path, 3), ["user_id", "ts"], "ts", "30 days")
    assert collected(spark, result, "append").count() == events.count()


def test_incremental_sums_equal_batch(spark, tmp_path):
    df = spark.range(500).select(
        (F.col("id") % 9).cast("string").alias("product_id"),
        (1 + F.col("id") % 5).cast("int").alias("score"),
        (F.col("id") % 4).cast("int").alias("helpfulness_numerator"),
        F.when(F.col("id") % 3 > 0, (F.col("id") % 6).cast("int")).alias("helpfulness_denominator"),
    )
    streamed = collected(spark, streams.incremental_weight_sums(stream_of(spark, df, tmp_path, 4)), "complete")
    batch = weight_sums(review_weights(df))

    def rows(table):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in table.collect())

    assert rows(streamed) == rows(batch)
    prior = scoring.score_prior(df)
    scored = {r["product_id"]: r for r in streams.with_prior(streamed, prior).collect()}
    for r in scoring.product_scores(df).collect():
        for kind in ("smooth", "simple"):
            mine, other = scored[r["product_id"]][f"bayesian_mean_{kind}"], r[f"bayesian_mean_{kind}"]
            assert mine == other or mine == pytest.approx(other)


def test_a_batch_run_again_replaces_its_rows_and_the_last_update_wins(spark, tmp_path):
    write = streams.batch_folders(str(tmp_path / "out"))
    first, second = (spark.createDataFrame(rows, "k string, v int") for rows in ([("a", 1), ("b", 1)], [("a", 2)]))
    for batch, number in ((first, 0), (first, 0), (second, 1), (second, 1)):
        write(batch, number)
    updates = spark.read.parquet(str(tmp_path / "out"))
    assert updates.count() == 3
    assert sorted(tuple(r) for r in streams.latest(updates, "k").select("k", "v").collect()) == [("a", 2), ("b", 1)]


def test_a_year_is_delivered_by_many_tasks(spark, tmp_path, monkeypatch):
    """The reviews of a year are several files of one batch, and the sums are those of the whole table."""
    orders = spark.range(40).select(F.col("id").alias("o_orderkey"), (F.col("id") % 5).alias("o_custkey"))
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 2).cast("int")).cast("timestamp")
    lines = spark.range(600).select(
        (F.col("id") % 40).alias("l_orderkey"), (F.col("id") % 9).alias("l_partkey"), (1 + F.col("id") % 60).alias("l_suppkey"),
        (1 + F.col("id") % 4).cast("int").alias("l_linenumber"), (1 + F.col("id") % 50).cast("double").alias("l_quantity"),
        ((F.col("id") % 11) / 100).alias("l_discount"), ((F.col("id") % 9) / 100).alias("l_tax"),
        F.when(F.col("id") % 3 > 0, "A").otherwise("N").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), day.alias("l_shipdate"),
    )
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(registry, "scratch_path", lambda _, name: str(tmp_path / name))
    wide = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in wide}
    try:
        for key, value in wide.items():
            spark.conf.set(key, value)
        got = sorted(tuple(r) for r in registry.restarted_product_scores(spark, str(tmp_path)).collect())
        expected = scoring.product_scores(registry.ratings(spark, str(tmp_path)))
        expected = expected.select("product_id", "num_reviews", *registry._SCORES)
        assert got == sorted(tuple(r) for r in registry.rounded(expected, *registry._SCORES).collect())
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    years = lines.select(F.year("l_shipdate")).distinct().count()
    assert years == 4 and len(list((tmp_path / "months-in").glob("*.parquet"))) >= 2 * years
