"""Review tables: CSV in, Parquet between stages, CSV reports out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, MapType, StringType, StructField, StructType

from criticlens.schemas import CLEANED_REQUIRED, REVIEW_CSV, REVIEW_HEADER
from criticlens.session import stage

_CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
_KEEP_SPACES = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
# A quoted element of a list written as text, in either kind of quotes.
_LISTED = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+\""""


def read_reviews_csv(spark: SparkSession, path: str) -> DataFrame:
    """Reviews from CSV with a header; quoted texts may span lines. Epoch seconds become review_time.

    A file with line breaks inside quotes cannot be split, so a large table should be many files.
    """
    raw = spark.read.schema(REVIEW_CSV).options(**_CSV_OPTIONS).csv(path)
    named = raw.select(*[F.col(old).alias(new) for old, new in REVIEW_HEADER.items()])
    return named.withColumn("review_time", F.timestamp_seconds("time")).drop("time")


def read_reviews_checked(spark: SparkSession, path: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(reviews, quarantine): the rows of a CSV that fit the header and types, and the ``record`` texts of those that do not.

    Too few or too many fields, or a value that is not of its type, send a row to the quarantine, whole as it stands in the file;
    :func:`read_reviews_csv` makes NULLs of such values. The file is parsed once, into a staged table both parts read.
    """
    names = [f"_{k}" for k in range(len(REVIEW_CSV))]
    parsed = spark.read.schema(StructType([*REVIEW_CSV, StructField("_record", StringType())])).options(**{**_CSV_OPTIONS, "header": header, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_record"})
    rows = stage(parsed.csv(path).toDF(*names, "_record"))
    named = rows.where(F.col("_record").isNull()).select(*[F.col(c).alias(REVIEW_HEADER[f.name]) for c, f in zip(names, REVIEW_CSV)])
    reviews = named.withColumn("review_time", F.timestamp_seconds("time")).drop("time")
    return reviews, rows.where(F.col("_record").isNotNull()).select(F.col("_record").alias("record"))


def write_reviews_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The inverse of :func:`read_reviews_csv`; columns the table lacks are empty."""
    columns = []
    for field in REVIEW_CSV:
        name = REVIEW_HEADER[field.name]
        if name == "time":
            value = F.unix_timestamp("review_time")
        else:
            value = F.col(name) if name in df.columns else F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    df.select(*columns).write.mode(mode).options(**_CSV_OPTIONS, **_KEEP_SPACES, emptyValue='""').csv(path)


def parse_listed(text: Column) -> Column:
    """"['a', "it's"]" -> array of its elements; [] when missing. Nothing is evaluated."""
    quoted = F.regexp_extract_all(text, F.lit(_LISTED), F.lit(0))

    def bare(element: Column) -> Column:
        inside = F.substring(element, F.lit(2), F.length(element) - 2)
        return F.when(element.contains("\\"), F.regexp_replace(inside, r"\\(.)", "$1")).otherwise(inside)

    return F.coalesce(F.transform(quoted, bare), F.array().cast("array<string>"))


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"cleaned data is missing the columns {missing}")
    return df


def read_cleaned(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned reviews; keywords stored as list text by an older writer are restored."""
    df = require_columns(spark.read.parquet(path), CLEANED_REQUIRED)
    if not isinstance(df.schema["keywords"].dataType, ArrayType):
        df = df.withColumn("keywords", parse_listed(F.col("keywords")))
    return df


def read_cleaned_csv(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned reviews from CSV, headers in either naming."""
    raw = spark.read.options(**_CSV_OPTIONS).csv(path)
    plain = {c: _plain_name(c) for c in raw.columns}
    df = require_columns(raw.select(*[F.col(f"`{old}`").alias(new) for old, new in plain.items()]), CLEANED_REQUIRED)
    return df.withColumns(
        {
            "score": F.col("score").try_cast("int"),
            "sentiment_score": F.col("sentiment_score").try_cast("double"),
            "keywords": parse_listed(F.col("keywords")),
        }
    )


def _plain_name(header: str) -> str:
    return re.sub(r"(?<=[a-z])(?=[A-Z])|\s+", "_", header).lower()


def write_cleaned(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Cleaned reviews as Parquet; existing output is kept unless ``overwrite``."""
    df.write.mode("overwrite" if overwrite else "ignore").parquet(path)


def partition_marks(df: DataFrame, by: str) -> DataFrame:
    """(``by``, n, mark): the rows of each partition and a sum of their hashes, whatever their order."""
    row_hash = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(row_hash).alias("mark"))


def write_changed(df: DataFrame, path: str, by: str) -> DataFrame:
    """Write the partitions (values of ``by``) whose rows differ from what ``path`` holds; their ``by``, n and mark.

    Marks of the finished partitions are kept beside the table, in ``path`` + "-marks", and written after the rows: a run that
    fails in between writes the same partitions again. Others stay as they are, also those that ``df`` no longer has.
    """
    spark = df.sparkSession
    marks = stage(partition_marks(df, by))
    finished = marks.limit(0)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-marks")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        rounds = spark.read.schema(StructType([*marks.schema, StructField("round", LongType())])).parquet(f"{path}-marks")
        finished = rounds.groupBy(by).agg(F.max_by(F.struct("n", "mark"), "round").alias("m")).select(by, "m.*")
        number = rounds.agg(F.max("round")).first()[0] + 1
    else:
        number = 0
    same = F.col("new.n").eqNullSafe(F.col("old.n")) & F.col("new.mark").eqNullSafe(F.col("old.mark"))
    joined = marks.alias("new").join(finished.alias("old"), F.col(f"new.{by}").eqNullSafe(F.col(f"old.{by}")) & same, "left_anti")
    changed = stage(joined)
    only = changed.select(F.col(by).alias("_by"))
    rows = df.join(only, F.col(by).eqNullSafe(F.col("_by")), "left_semi")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    changed.withColumn("round", F.lit(number).cast("long")).write.mode("append").parquet(f"{path}-marks")
    return changed


def write_analysis(
    keywords: DataFrame, insights: DataFrame, out_dir: str, product_keywords: DataFrame | None = None
) -> None:
    """The report tables as CSV, nested columns as JSON text."""
    tables = {"negative_keywords_categorized": keywords, "top_negative_products": insights}
    if product_keywords is not None:
        tables["top_negative_product_keywords"] = product_keywords
    for name, table in tables.items():
        flat = [
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f.name)
            for f in table.schema
        ]
        table.select(*flat).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(f"{out_dir}/{name}")
