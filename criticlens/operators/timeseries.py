"""Review volume and rating over calendar time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType


def _review_date(df: DataFrame, time_col: str) -> Column:
    """Timestamps as they are, numbers as epoch seconds, text parsed; bad values are NULL."""
    kind = df.schema[time_col].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        return F.col(time_col).cast("timestamp")
    if isinstance(kind, NumericType):
        return _from_epoch(F.col(time_col))
    return F.coalesce(_from_epoch(F.col(time_col).try_cast("bigint")), F.col(time_col).try_cast("timestamp"))


def _from_epoch(seconds: Column) -> Column:
    """NULL outside the years 1 to 9999, which also bounds every calendar built here."""
    return F.when(seconds.between(-62135596800, 253402300799), F.timestamp_seconds(seconds))


def time_parts(df: DataFrame, time_col: str = "review_time") -> DataFrame:
    """Add review_date, year, month (its first day) and month_num."""
    dated = df.withColumn("review_date", _review_date(df, time_col))
    return dated.withColumns(
        {
            "year": F.year("review_date"),
            "month": F.trunc("review_date", "MM"),
            "month_num": F.month("review_date"),
        }
    )


def _fill(counts: DataFrame, key: str, series) -> DataFrame:
    """Rows for the missing periods between the first and last, with count 0.

    ``counts`` has one row per period. A calendar has few of those (twelve a year), so they are
    put in one array and each entry is extended up to the next.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(key).alias("at"), F.col("review_count").alias("n"))))

    def extend(entry: Column, i: Column) -> Column:
        following = F.get(F.col("periods"), i + 1).getField("at")
        return F.transform(
            series(entry.getField("at"), following),
            lambda p: F.struct(
                p.alias(key),
                F.when(p == entry.getField("at"), entry.getField("n")).otherwise(0).alias("review_count"),
            ),
        )

    return counts.agg(ordered.alias("periods")).select(F.inline(F.flatten(F.transform("periods", extend))))


def monthly_volume(df: DataFrame, time_col: str = "review_time") -> DataFrame:
    """Reviews per month, months without reviews included."""
    counts = (
        time_parts(df, time_col)
        .where(F.col("month").isNotNull())
        .groupBy("month")
        .agg(F.count(F.lit(1)).alias("review_count"))
    )

    def months(start: Column, following: Column) -> Column:
        last = F.coalesce(F.add_months(following, -1), start)
        return F.sequence(start, last, F.expr("interval 1 month"))

    return _fill(counts, "month", months)


def yearly_count(df: DataFrame, time_col: str = "review_time") -> DataFrame:
    """Reviews per year, years without reviews included."""
    counts = (
        time_parts(df, time_col)
        .where(F.col("year").isNotNull())
        .groupBy("year")
        .agg(F.count(F.lit(1)).alias("review_count"))
    )
    return _fill(counts, "year", lambda start, following: F.sequence(start, F.coalesce(following - 1, start)))


def rating_heatmap(df: DataFrame, time_col: str = "review_time") -> DataFrame:
    """Mean score by year (rows) and month (columns m1..m12); NULL where there is none."""
    valid = (
        time_parts(df, time_col)
        .withColumn("_score", F.col("score").try_cast("double"))
        .where(F.col("review_date").isNotNull() & F.col("_score").isNotNull())
    )
    cells = valid.groupBy("year").pivot("month_num", list(range(1, 13))).agg(F.avg("_score"))
    return cells.select("year", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])
