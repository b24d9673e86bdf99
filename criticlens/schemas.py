"""Column names and types of the tables read and written. JSON is never inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
)

TEXT_MAP = MapType(StringType(), StringType())

# CSV header name -> column name here.
REVIEW_HEADER = {
    "Id": "id",
    "ProductId": "product_id",
    "UserId": "user_id",
    "ProfileName": "profile_name",
    "HelpfulnessNumerator": "helpfulness_numerator",
    "HelpfulnessDenominator": "helpfulness_denominator",
    "Score": "score",
    "Time": "time",
    "Summary": "summary",
    "Text": "text",
}

REVIEW_CSV = StructType(
    [
        StructField("Id", LongType()),
        StructField("ProductId", StringType()),
        StructField("UserId", StringType()),
        StructField("ProfileName", StringType()),
        StructField("HelpfulnessNumerator", IntegerType()),
        StructField("HelpfulnessDenominator", IntegerType()),
        StructField("Score", IntegerType()),
        StructField("Time", LongType()),
        StructField("Summary", StringType()),
        StructField("Text", StringType()),
    ]
)

CLEANED_REQUIRED = ["product_id", "score", "keywords", "sentiment_score", "text_cleaned"]

RATING = StructType([StructField("score", StringType()), StructField("dist", TEXT_MAP)])

COMMENT = StructType([StructField(n, StringType()) for n in ("date", "title", "score", "text", "helpfulness")])

PRODUCT_DOCUMENT = StructType(
    [
        StructField("product_id", StringType()),
        StructField("product_title", StringType()),
        StructField("byline_info", StringType()),
        StructField("product_description", StringType()),
        StructField("category", ArrayType(StringType())),
        StructField("alt_images", ArrayType(StringType())),
        StructField("product_detail", TEXT_MAP),
        StructField("important_information", TEXT_MAP),
        StructField("rating", RATING),
        StructField("top_comments", ArrayType(COMMENT)),
    ]
)
