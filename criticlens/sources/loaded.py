"""Table of the product ids already loaded, laid out so that looking up what is pending does not shuffle it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from criticlens.session import shuffle_width


class LoadedProducts:
    """Ids in a bucketed, sorted table: rounds of loading append to it, and it is never shuffled again.

    The number of buckets is fixed when the table is made (the shuffle width, unless given). A look-up with the same
    width shuffles the wanted ids once, for their distinct values and the join together. ``path`` must be a folder
    that all executors reach. An id that is recorded twice does no harm.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int | None = None):
        self.spark, self.name, self.path = spark, name, path
        self.buckets = buckets or shuffle_width(spark)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def record(self, products: DataFrame) -> None:
        """Add the ids of ``products``; NULL ids are left out."""
        ids = products.select("product_id").where(F.col("product_id").isNotNull()).distinct()
        # One task per bucket, so that a round adds one file to each.
        dealt = ids.repartition(self.buckets, "product_id")
        dealt.write.mode("append").bucketBy(self.buckets, "product_id").sortBy("product_id").option("path", self.path).saveAsTable(self.name)

    def pending(self, reviews: DataFrame, replace: bool = False) -> DataFrame:
        """Distinct product ids of the reviews that no round has recorded, or all of them with ``replace``."""
        wanted = reviews.select("product_id").where(F.col("product_id").isNotNull()).distinct()
        if replace or not self.exists():
            return wanted
        return wanted.join(self.spark.table(self.name), "product_id", "left_anti")

    def drop(self) -> None:
        """Forget the table; the files stay in ``path``."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
