"""Ranks, medians and value counts of columns too long for one sorted partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from criticlens.session import shuffle_width, stage


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, value, n): how often each value of each column occurs. NULL and NaN are left out.

    Repeated values meet in the partial aggregate, so a value holding a third of the rows is a
    single row from here on.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    long = df.select(F.inline(pairs))
    present = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return present.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))


def _with_bucket(counts: DataFrame, n_buckets: int) -> DataFrame:
    """Add ``bucket``: ranges of about equally many distinct values, in value order.

    The only thing brought to the driver is the cut points, at most ``n_buckets`` per variable.
    """
    probabilities = [i / n_buckets for i in range(1, n_buckets)]
    if not probabilities:
        return counts.withColumn("bucket", F.lit(0.0))
    cuts = (
        counts.groupBy("variable")
        .agg(F.percentile_approx("value", probabilities, 20 * n_buckets).alias("cuts"))
        .collect()
    )
    bucket = F.lit(0.0)
    for i, row in enumerate(cuts):
        inner = sorted(set(row["cuts"]))
        name = f"_bucket_{i}"
        splits = [float("-inf"), *inner, float("inf")]
        counts = Bucketizer(splits=splits, inputCol="value", outputCol=name).transform(counts)
        bucket = F.when(F.col("variable") == row["variable"], F.col(name)).otherwise(bucket)
    return counts.withColumn("bucket", bucket).drop(*[f"_bucket_{i}" for i in range(len(cuts))])


def cumulative_counts(counts: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """Add ``before`` (rows with a smaller value) and ``total`` (all rows) per variable.

    Sorted running sums run inside range buckets, many tasks wide; the bucket totals, at most
    ``n_buckets`` rows per variable, are what is broadcast. ``counts`` should be staged: it is
    read for the cut points, the totals and the running sums.
    """
    n_buckets = n_buckets or shuffle_width(counts.sparkSession)
    keyed = _with_bucket(counts, n_buckets)
    sizes = keyed.groupBy("variable", "bucket").agg(F.sum("n").alias("_size"))
    along = Window.partitionBy("variable").orderBy("bucket")
    offsets = sizes.select(
        "variable",
        "bucket",
        F.sum("_size").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_upto"),
        F.sum("_size").over(Window.partitionBy("variable")).alias("total"),
        "_size",
    ).select("variable", "bucket", (F.col("_upto") - F.col("_size")).alias("_offset"), "total")
    inside = Window.partitionBy("variable", "bucket").orderBy("value")
    running = keyed.withColumn(
        "_running", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return running.join(F.broadcast(offsets), ["variable", "bucket"]).select(
        "variable", "value", "n", (F.col("_offset") + F.col("_running") - F.col("n")).alias("before"), "total"
    )


def average_ranks(counts: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """(variable, value, n, rank, total): 1-based ranks, equal values sharing their mean rank."""
    return cumulative_counts(counts, n_buckets).select(
        "variable", "value", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"), "total"
    )


def average_rank(df: DataFrame, column: str) -> DataFrame:
    """Average rank of each distinct value of one column, with its count."""
    counts = stage(value_counts(df, [column]))
    return average_ranks(counts).select("value", "n", "rank")


def exact_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, median), exact. The middle rows are found by position, so nothing is gathered."""
    counts = stage(value_counts(df, columns))
    placed = cumulative_counts(counts)
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    until = F.col("before") + F.col("n")
    middle = [F.max(F.when((F.col("before") <= p) & (p < until), F.col("value"))) for p in (low, high)]
    return placed.groupBy("variable").agg(((middle[0] + middle[1]) / 2).alias("median"))
