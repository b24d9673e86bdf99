"""Cleaning of raw reviews, keep-first deduplication, and the reports about both."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from criticlens.functions.scores import helpfulness_index
from criticlens.functions.text import drop_words, with_tokens
from criticlens.functions.words import STOP_WORDS

REQUIRED = ("text", "score", "product_id")
REVIEW_KEY = ("product_id", "user_id", "score")


def _ordering(order_cols: Sequence[str]) -> Column:
    """Ascending with NULL last, as one comparable struct."""
    return F.struct(*[c for name in order_cols for c in (F.col(name).isNull(), F.col(name))])


def keep_first(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """First row of each key in ``order_cols`` order; missing keys are equal to each other.

    A partial aggregate, so a key holding a large part of the table is reduced to one row per
    task before the shuffle. ``order_cols`` should end in a unique column.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    first = df.groupBy(*key_cols).agg(F.min_by(row, _ordering(order_cols)).alias("_first"))
    return first.select("_first.*")


def drop_incomplete(df: DataFrame, subset: Sequence[str] = REQUIRED) -> DataFrame:
    """Rows with a value in every listed column; single conditions, which a Parquet scan can use."""
    return df.where(functools.reduce(Column.__and__, [F.col(c).isNotNull() for c in subset]))


def add_text_columns(df: DataFrame, text_col: str = "text", stop_words: Iterable[str] | None = None) -> DataFrame:
    """``text_cleaned`` and ``keywords`` of a text column."""
    words = STOP_WORDS if stop_words is None else stop_words
    tokenized = with_tokens(df, text_col, "text_cleaned", "_tokens")
    return tokenized.withColumn("keywords", drop_words(F.col("_tokens"), words)).drop("_tokens")


def replace_votes(df: DataFrame) -> DataFrame:
    """The two vote columns become ``helpfulness_index``, at the numerator's position."""
    index = helpfulness_index(F.col("helpfulness_numerator"), F.col("helpfulness_denominator"))
    columns = []
    for name in df.columns:
        if name == "helpfulness_numerator":
            columns.append(index.alias("helpfulness_index"))
        elif name != "helpfulness_denominator":
            columns.append(F.col(name))
    return df.select(*columns)


def clean_reviews(
    df: DataFrame,
    key_cols: Sequence[str] = REVIEW_KEY,
    order_cols: Sequence[str] = ("id",),
    stop_words: Iterable[str] | None = None,
) -> DataFrame:
    """Drop incomplete rows, keep the first review per key, and derive the clean columns."""
    first = keep_first(drop_incomplete(df), key_cols, order_cols)
    if "helpfulness_numerator" in first.columns:
        first = replace_votes(first)
    return add_text_columns(first, stop_words=stop_words).drop("text")


def cleaning_report(
    df: DataFrame, key_cols: Sequence[str] = REVIEW_KEY, subset: Sequence[str] = REQUIRED
) -> DataFrame:
    """One row: rows read, rows lost to missing values, rows lost to duplicates, rows left.

    Counted per key first, so one pass over the input is enough.
    """
    complete = F.lit(True)
    for name in subset:
        complete = complete & F.col(name).isNotNull()
    per_key = (
        df.select(complete.alias("_complete"), *key_cols)
        .groupBy("_complete", *key_cols)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total, kept = F.sum("n"), F.count_if(F.col("_complete"))
    complete_rows = F.sum(F.when(F.col("_complete"), F.col("n")).otherwise(0))
    return per_key.agg(
        F.coalesce(total, F.lit(0)).alias("rows_read"),
        F.coalesce(total - complete_rows, F.lit(0)).alias("rows_missing"),
        F.coalesce(complete_rows - kept, F.lit(0)).alias("rows_duplicate"),
        kept.alias("rows_kept"),
    )


def clean_with_report(
    df: DataFrame,
    write: Callable[[DataFrame], DataFrame],
    key_cols: Sequence[str] = REVIEW_KEY,
    order_cols: Sequence[str] = ("id",),
    subset: Sequence[str] = REQUIRED,
) -> tuple[DataFrame, DataFrame]:
    """Clean and write in one pass; what ``write`` returns, and the one-row report of :func:`cleaning_report` with n_<column> counts.

    The counts are metrics observed while the rows flow, so the source is scanned once for both. ``write`` must run the
    job over all rows (write a table, as ``session.stage`` does). A task that runs again counts once.
    """
    complete = functools.reduce(Column.__and__, [F.col(c).isNotNull() for c in subset])
    read, kept = Observation(), Observation()
    present = [F.count(F.col(c)).alias(f"n_{c}") for c in df.columns]
    source = df.observe(read, F.count(F.lit(1)).alias("rows_read"), F.count_if(complete).alias("rows_complete"), *present)
    first = keep_first(drop_incomplete(source, subset), key_cols, order_cols).observe(kept, F.count(F.lit(1)).alias("rows_kept"))
    cleaned = replace_votes(first) if "helpfulness_numerator" in first.columns else first
    written = write(add_text_columns(cleaned).drop("text"))
    seen, n_kept = read.get, kept.get["rows_kept"]
    row = {
        "rows_read": seen["rows_read"], "rows_missing": seen["rows_read"] - seen["rows_complete"],
        "rows_duplicate": seen["rows_complete"] - n_kept, "rows_kept": n_kept, **{f"n_{c}": seen[f"n_{c}"] for c in df.columns},
    }
    return written, df.sparkSession.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in row.items()])


def table_profile(df: DataFrame, distinct_col: str = "product_id") -> DataFrame:
    """One row: row count, non-null count of each column, distinct values of one column.

    The distinct count comes from grouping by that column, which keeps one partial row per value
    and task instead of expanding the input.
    """
    names = df.columns
    per_value = df.groupBy(F.col(distinct_col).alias("_value")).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in names]
    )
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for c in names]
    return per_value.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_rows"), *totals, F.count("_value").alias(f"distinct_{distinct_col}")
    )
