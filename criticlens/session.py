"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Batches sent to Python are bounded by bytes too: ten thousand long texts would not fit beside the heap.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}
#: Options that may be set on a running session.
RUNTIME = ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy", "spark.sql.execution.arrow.maxBytesPerBatch")


def build_session(app_name: str = "criticlens", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings the operators expect."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_settings(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options a session built elsewhere may lack."""
    for key in RUNTIME:
        spark.conf.set(key, SETTINGS[key])
    return spark


def like(spark: SparkSession, **settings: str) -> SparkSession:
    """A session of its own with the settings of ``spark``, apart from ``settings``."""
    other = spark.newSession()
    known = other.conf.getAll
    for key, value in {**spark.conf.getAll, **settings}.items():
        if known.get(key) != value:
            other.conf.set(key, value)
    return other


def in_session(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` of another session as one of ``spark``; its files are still read by the settings of the other."""
    name = f"handed_over_{uuid.uuid4().hex}"
    df.createGlobalTempView(name)
    try:
        return spark.table(f"{spark.conf.get('spark.sql.globalTempDatabase', 'global_temp')}.{name}")
    finally:
        spark.catalog.dropGlobalTempView(name)


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` as the cluster names it.

    Only a local master may fall back to a temporary folder, removed when Python ends; on a cluster
    that would lose data with the machine, so a missing setting is an error there. The context's own
    checkpoint directory is left as it is.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        if context.applicationId not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="criticlens-")
            atexit.register(shutil.rmtree, _LOCAL_FOLDERS[context.applicationId], ignore_errors=True)
        folder = _LOCAL_FOLDERS[context.applicationId]
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below one folder per application."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/criticlens/{application}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and return a reader of it.

    Used where several later branches need the same rows: it saves the second pass over the big
    input, lost executors only cost a re-read, and each branch reads only the columns it needs.
    With ``partition_by``, the last columns of ``df``, a branch that filters on them reads only its folders.
    The table stays as long as results derived from it may be computed; :func:`release` drops it.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> bool:
    """Remove everything this application staged. Call it when no lazy result is needed any more."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/criticlens/{context.applicationId}")
    return path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
