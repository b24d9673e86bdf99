"""Join with a lookup table when a few keys hold much of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from criticlens.session import shuffle_width


def hot_keys(counts: DataFrame, key: str, n_col: str = "n", width: int | None = None) -> list[tuple]:
    """(key, parts) of the keys that hold more rows than one of ``width`` equal shuffle partitions.

    By that definition they are fewer than ``width`` (the shuffle width of the session), and their parts together fewer
    than twice that; each part is at most one partition's share.
    """
    width = width or shuffle_width(counts.sparkSession)
    parts = F.ceil(F.col(n_col) * width / F.col("_total")).cast("int").alias("parts")
    totals = counts.agg(F.sum(n_col)).scalar()
    rows = counts.withColumn("_total", totals).where(F.col(n_col) * width > F.col("_total")).select(key, parts).collect()
    return sorted((row[0], row[1]) for row in rows if row[0] is not None)


def lookup_join(rows: DataFrame, table: DataFrame, key: str, hot: list[tuple]) -> DataFrame:
    """Inner join of ``rows`` with a table unique on ``key``.

    Rows of a hot key are spread over its parts and only those few table rows are repeated; every
    other key joins as usual. ``rows`` should have no exact duplicates of a hot key, or they stay
    together. The list of hot keys is broadcast: it is shorter than the shuffle is wide.
    """
    if not hot:
        return rows.join(table, key)
    schema = f"`{key}` {table.schema[key].dataType.simpleString()}, _parts int"
    split = F.broadcast(rows.sparkSession.createDataFrame(hot, schema))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.coalesce("_parts", F.lit(1))).cast("int")
    left = rows.join(split, key, "left").withColumn("_salt", spread).drop("_parts")
    copies = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    right = table.join(split, key, "left").withColumn("_salt", F.explode(copies)).drop("_parts")
    return left.join(right, [key, "_salt"]).drop("_salt")
