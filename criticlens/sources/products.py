"""Product documents: JSON in and out, and the ids still to be loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from criticlens.schemas import PRODUCT_DOCUMENT
from criticlens.session import in_session, like

# Bytes that could be read while a small file is opened. Spark's default of 4 MB is that of a remote store's first byte; it makes
# a task of a few documents, and starting the tasks costs more than their work.
OPEN_COST = "128k"


def read_products(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Product documents; empty ones, left by failed pages, are dropped.

    With ``one_per_file`` each file is one document named by its product id. Otherwise the files
    are JSON lines carrying the id, which is the layout for many products.
    """
    # How files are packed into tasks is a setting of the session that reads them.
    reader = like(spark, **{"spark.sql.files.openCostInBytes": OPEN_COST}) if one_per_file else spark
    raw = reader.read.schema(PRODUCT_DOCUMENT).option("multiLine", one_per_file).json(path)
    if one_per_file:
        from_name = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)
        raw = in_session(spark, raw.withColumn("product_id", from_name))
    return raw.where(F.col("product_title").isNotNull())


def write_products(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Product documents as JSON lines with their id."""
    columns = [f.name for f in PRODUCT_DOCUMENT if f.name in df.columns]
    df.select(*columns).write.mode(mode).option("ignoreNullFields", False).json(path)


def pending_products(reviews: DataFrame, existing: DataFrame, replace: bool = False) -> DataFrame:
    """Distinct product ids of the reviews not loaded yet, or all of them with ``replace``."""
    wanted = reviews.select("product_id").where(F.col("product_id").isNotNull()).distinct()
    return wanted if replace else wanted.join(existing.select("product_id"), "product_id", "left_anti")
