"""Streaming counterparts of the review volume, deduplication and product sums."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from criticlens.operators.scoring import review_weights, weight_sums, with_bayesian_means


def _timed(stream: DataFrame, time_col: str) -> DataFrame:
    """Watermarks need a timestamp with a time zone."""
    return stream.withColumn(time_col, F.col(time_col).cast("timestamp"))


def windowed_volume(stream: DataFrame, time_col: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Rows per tumbling window; rows later than ``delay`` are left out once their window is final."""
    counts = (
        _timed(stream, time_col)
        .withWatermark(time_col, delay)
        .groupBy(F.window(time_col, window))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n")


def deduplicate(stream: DataFrame, key_cols: Sequence[str], time_col: str, delay: str) -> DataFrame:
    """One row per key within the watermark delay, so the kept state stays bounded."""
    return _timed(stream, time_col).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(key_cols))


def incremental_weight_sums(stream: DataFrame) -> DataFrame:
    """Running product sums; for the update output mode."""
    return weight_sums(review_weights(stream))


def windowed_weight_sums(stream: DataFrame, time_col: str, window: str = "30 days", delay: str = "1 day") -> DataFrame:
    """Running product sums per window of event time; for the update output mode.

    The state of a window is dropped once the watermark has passed it, so what is kept is bounded by the products of the
    open windows and not by all products ever seen. Rows later than that are left out.
    """
    weighted = review_weights(_timed(stream, time_col).withWatermark(time_col, delay).where(F.col("product_id").isNotNull()))
    names = ["weight_simple", "wscore_simple", "weight_smooth", "wscore_smooth"]
    sums = weighted.groupBy(F.window(time_col, window).alias("_window"), "product_id").agg(
        F.sum("score").cast("double").alias("score_sum"), F.count("score").alias("score_n"), F.count(F.lit(1)).alias("num_reviews"),
        *[F.coalesce(F.sum(n), F.lit(0.0)).alias(f"sum_{n}") for n in names],
    )
    return sums.withColumn("window_start", F.col("_window.start")).drop("_window")


def merged_weight_sums(updates: DataFrame, batch_col: str = "batch") -> DataFrame:
    """The sums of all windows, per product, from what :func:`windowed_weight_sums` has emitted; the layout of ``scoring.weight_sums``."""
    last = latest(updates, ["window_start", "product_id"], batch_col)
    names = ["sum_weight_simple", "sum_wscore_simple", "sum_weight_smooth", "sum_wscore_smooth"]
    mean = F.try_divide(F.sum("score_sum"), F.sum("score_n")).alias("mean_score")
    return last.groupBy("product_id").agg(mean, F.sum("num_reviews").alias("num_reviews"), *[F.sum(n).alias(n) for n in names])


def with_prior(sums: DataFrame, prior: DataFrame) -> DataFrame:
    """Weighted and Bayesian means of product sums under a prior, the one row of ``scoring.score_prior``."""
    return with_bayesian_means(sums, prior.select(F.struct("*")).scalar())


def latest(updates: DataFrame, key: str | Sequence[str], batch_col: str = "batch") -> DataFrame:
    """The last update of each key: what the update mode has emitted up to now, as one table."""
    keys = [key] if isinstance(key, str) else list(key)
    last = updates.groupBy(*keys).agg(F.max(batch_col).alias(batch_col))
    return updates.join(last, [*keys, batch_col]).drop(batch_col)


def batch_folders(path: str) -> Callable[[DataFrame, int], None]:
    """Writer of one folder per batch id, so that a batch run again replaces its rows instead of doubling them."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(
    result: DataFrame, checkpoint: str, mode: str, on_batch: Callable[[DataFrame, int], None], state_store: str | None = None,
    no_data_batches: bool = True,
) -> list[dict]:
    """Process everything there is and stop; the progress of the batches.

    Run again on the same ``checkpoint`` it goes on behind the last finished batch, with the state of that batch, also
    where a run before it failed. ``state_store`` (:data:`ROCKSDB`) keeps large state outside the heap; a checkpoint stays with the
    store it was started with. Without ``no_data_batches`` state behind the watermark waits for the next rows to be dropped, which
    saves a commit of the whole state where runs on new rows follow each other; the append mode needs them to emit what is final.
    """
    spark = result.sparkSession
    before = {key: spark.conf.get(key) for key in (_PROVIDER, _NO_DATA)}
    if state_store:
        spark.conf.set(_PROVIDER, state_store)
    spark.conf.set(_NO_DATA, str(no_data_batches).lower())
    try:
        query = (
            result.writeStream.outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(on_batch)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return list(query.recentProgress)


def late_rows(progress: Sequence[dict]) -> tuple[int, int]:
    """Rows read, and rows that came too late for the state, over the batches of a run.

    Exact where rows reach the state as they are (deduplication); an aggregate counts its late groups of each task instead.
    """
    dropped = sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])
    return sum(p["numInputRows"] for p in progress), dropped
