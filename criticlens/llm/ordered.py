"""Global order without a single partition: neighbours and positions of range-sorted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from criticlens.session import shuffle_width, stage

PART = "_part"


def ranged(df: DataFrame, keys: list[Column]) -> DataFrame:
    """``df`` dealt out by range of ``keys`` and written once; ``_part`` numbers the ranges in order.

    Equal keys may be spread over several ranges when a further key tells them apart, so a frequent
    value does not fill one task.
    """
    width = shuffle_width(df.sparkSession)
    return stage(df.repartitionByRange(width, *keys).withColumn(PART, F.spark_partition_id()))


def with_neighbours(df: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """Each row with ``_before`` and ``_after``: the ``carry`` columns of its neighbours in key order.

    Inside a range the neighbours come from a window; across ranges from the first and last row of
    each range, of which there are two per shuffle partition.
    """
    rows = ranged(df, [F.col(k) for k in keys])
    within = Window.partitionBy(PART).orderBy(*keys)
    carried = F.struct(*carry)
    order = F.struct(*keys)
    edges = rows.groupBy(PART).agg(F.min_by(carried, order).alias("_first"), F.max_by(carried, order).alias("_last"))
    parts = Window.orderBy(PART)
    edges = edges.select(PART, F.lag("_last").over(parts).alias("_left"), F.lead("_first").over(parts).alias("_right"))
    return rows.select(
        *df.columns, PART, F.lag(carried).over(within).alias("_lag"), F.lead(carried).over(within).alias("_lead")
    ).join(edges, PART).select(
        *df.columns,
        F.coalesce("_lag", "_left").alias("_before"),
        F.coalesce("_lead", "_right").alias("_after"),
    )


def with_position(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """Each row with its 0-based position in key order as column ``name``."""
    rows = ranged(df, keys)
    counts = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(PART).orderBy(*keys)
    return rows.join(offsets, PART).select(
        *df.columns, (F.col("_offset") + F.row_number().over(within) - 1).alias(name)
    )
