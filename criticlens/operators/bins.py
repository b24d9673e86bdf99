"""Equal-width bins and histograms, empty bins included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _span(df: DataFrame, column: str, n_bins: Column) -> DataFrame:
    """One row: n, lo, hi and width of right-closed bins. A constant column gets a narrow span."""
    least, most = F.min(column).cast("double"), F.max(column).cast("double")
    edges = df.agg(least.alias("least"), most.alias("most")).where(F.col("least").isNotNull())
    margin = F.when(F.col("least") != 0, F.abs("least") * 0.001).otherwise(0.001)
    same = F.col("least") == F.col("most")
    counted = edges.select(
        n_bins.cast("int").alias("n"),
        F.when(same, F.col("least") - margin).otherwise(F.col("least")).alias("lo"),
        F.when(same, F.col("most") + margin).otherwise(F.col("most")).alias("hi"),
        same.alias("same"),
    )
    return counted.withColumn("width", (F.col("hi") - F.col("lo")) / F.col("n"))


def cut(df: DataFrame, column: str, n_bins: int | Column) -> tuple[DataFrame, DataFrame]:
    """(rows with ``bin``, table of bins): ``n_bins`` equal widths over the range, closed on the right.

    ``n_bins`` may be an expression of ``least`` and ``most``. The first edge is lowered by a
    thousandth of the range so that the minimum lies inside.
    """
    count = n_bins if isinstance(n_bins, Column) else F.lit(n_bins)
    span = _span(df, column, count)
    s = span.select(F.struct("*")).scalar()
    place = F.ceil((F.col(column) - s.getField("lo")) / s.getField("width")).cast("int")
    rows = df.where(F.col(column).isNotNull()).withColumn(
        "bin", F.least(s.getField("n"), F.greatest(F.lit(1), place))
    )
    i = F.col("bin")
    lowered = F.when((i == 1) & ~F.col("same"), (F.col("hi") - F.col("lo")) * 0.001).otherwise(0.0)
    table = span.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("bin")).select(
        "bin",
        (F.col("lo") + (i - 1) * F.col("width") - lowered).alias("bin_lo"),
        (F.col("lo") + i * F.col("width")).alias("bin_hi"),
    )
    return rows, table.withColumn("bin_mid", (F.col("bin_lo") + F.col("bin_hi")) / 2)


def cut_counts(df: DataFrame, column: str, n_bins: int | Column) -> DataFrame:
    """Bins with the number of rows in each."""
    rows, table = cut(df.select(column), column, n_bins)
    counts = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n_samples"))
    return table.join(counts, "bin", "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))


def histograms(df: DataFrame, columns: Sequence[str], n_bins: int) -> DataFrame:
    """(variable, bin, bin_lo, bin_hi, n): left-closed bins, the last one closed on both sides.

    One pass for all ranges and one for all counts.
    """

    def edge(name: str, func, shift: float) -> Column:
        value = func(name).cast("double")
        return F.when(F.min(name) == F.max(name), value + shift).otherwise(value)

    ranges = df.agg(
        F.array(
            *[
                F.struct(F.lit(c).alias("variable"), edge(c, F.min, -0.5).alias("lo"), edge(c, F.max, 0.5).alias("hi"))
                for c in columns
            ]
        ).alias("spans")
    )
    spans = ranges.scalar()
    cells = []
    for i, c in enumerate(columns):
        span = F.get(spans, F.lit(i))
        place = F.width_bucket(F.col(c).cast("double"), span.getField("lo"), span.getField("hi"), F.lit(n_bins))
        cells.append(F.struct(F.lit(c).alias("variable"), place.alias("place")))
    counts = (
        df.select(F.inline(F.array(*cells)))
        .where(F.col("place").isNotNull())
        .groupBy("variable", F.least("place", F.lit(n_bins)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("hi") - F.col("lo")) / n_bins
    table = (
        ranges.select(F.inline("spans"))
        .where(F.col("lo").isNotNull())
        .select("variable", "lo", "hi", F.explode(F.expr(f"sequence(1L, {n_bins}L)")).alias("bin"))
        .select(
            "variable",
            "bin",
            (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_lo"),
            (F.col("lo") + F.col("bin") * width).alias("bin_hi"),
        )
    )
    return table.join(counts, ["variable", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
