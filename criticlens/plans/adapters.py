"""Views that give the shared test tables the shape of reviews and products.

Plain SQL both engines read, so the Spark queries and their SQL twins start from one text. Every
view covers its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from criticlens.functions.scores import polarization
from criticlens.schemas import COMMENT
from criticlens.session import ensure_settings, shuffle_width, stage

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def _ratings(product: str, extra: str = "", source: str = "") -> str:
    return f"""
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING),
                 CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS id,
       {product} AS product_id,
       CAST(o_custkey AS STRING) AS user_id,
       CAST(round(l_discount * 100) AS INT) AS helpfulness_numerator,
       CASE WHEN l_returnflag = 'N' THEN NULL
            ELSE CAST(round(l_tax * 100) AS INT) * l_linenumber END AS helpfulness_denominator,
       CASE WHEN l_suppkey % 50 = 0 THEN NULL
            ELSE 1 + CAST(floor((l_quantity - 1) / 10) AS INT) END AS score,
       l_shipdate AS review_time,
       concat(l_returnflag, l_linestatus) AS summary,
       CAST((l_partkey * 7919 + l_orderkey * 104729 + l_linenumber) % 1000 AS DOUBLE) / 1000 AS sentiment_score{extra}
FROM lineitem JOIN orders ON l_orderkey = o_orderkey{source}"""


# Reviews of parts: missing scores, missing and zero denominators, more helpful votes than votes.
RATINGS = _ratings("CAST(l_partkey AS STRING)")

# The same reviews per part and supplier: mostly one review a product.
OFFERS = _ratings("concat(CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING))")

# The same reviews with a short text each.
SPOKEN_RATINGS = _ratings(
    "CAST(l_partkey AS STRING)",
    ",\n       concat_ws(' ', p_name, p_type, substr(o_orderpriority, 3)) AS text",
    " JOIN part ON l_partkey = p_partkey",
)

# Reviews with long texts, and one without a text per label; times have gaps, keys repeat.
TEXT_REVIEWS = """
SELECT doc_id AS id, source AS product_id, concat(lang, '-', CAST(n_chars % 7 AS STRING)) AS user_id,
       CAST(doc_id % 7 AS INT) AS helpfulness_numerator,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id % 11 AS INT) END AS helpfulness_denominator,
       CAST(1 + (doc_id * 7 + n_chars) % 5 AS INT) AS score,
       text,
       split_part(text, chr(10), 1) AS summary,
       1104537600 + n_chars * 43200 AS time,
       CAST((doc_id * 7919) % 1000 AS DOUBLE) / 1000 AS sentiment_score
FROM documents
UNION ALL
SELECT -1 - doc_id, concat('label-', CAST(toxic AS STRING)), 'reader', 0, NULL, CAST(1 + doc_id % 5 AS INT), NULL, 'no text',
       1104537600 + doc_id * 43200, 0.5E0
FROM labels"""

# Products: parts with their star counts and the document that describes them.
PRODUCT_ROWS = f"""
SELECT product_id, product_title, byline_info, p_type, p_size, doc_key,
       p_size % 8 AS count_alt_images, num_ratings, score, n1, n2, n3, n4, n5
FROM (SELECT CAST(p_partkey AS STRING) AS product_id, p_name AS product_title, p_brand AS byline_info, p_type, p_size,
             p_partkey % (SELECT count(*) FROM documents) AS doc_key FROM part) p
JOIN (SELECT product_id AS pid, count(score) AS num_ratings, avg(score) AS score,
             count(CASE WHEN score = 1 THEN 1 END) AS n1, count(CASE WHEN score = 2 THEN 1 END) AS n2,
             count(CASE WHEN score = 3 THEN 1 END) AS n3, count(CASE WHEN score = 4 THEN 1 END) AS n4,
             count(CASE WHEN score = 5 THEN 1 END) AS n5
      FROM ({RATINGS}) r GROUP BY product_id) h ON pid = product_id"""

# The same with the description itself.
PRODUCT_INFO = f"""
SELECT p.* EXCLUDE (doc_key), text AS product_description
FROM ({PRODUCT_ROWS}) p LEFT JOIN documents ON doc_id = doc_key"""

_VOTES = "num_ratings * 97"
_VOTES_TEXT = f"""CASE WHEN {_VOTES} >= 1000
 THEN concat(CAST(CAST(floor({_VOTES} / 1000) AS INT) AS STRING), ',', lpad(CAST({_VOTES} % 1000 AS STRING), 3, '0'))
 ELSE CAST({_VOTES} AS STRING) END"""

# (section, item, condition, value) over the columns of PRODUCT_INFO.
ITEMS = [
    ("product_detail", "Item model number", "p_size <= 20", "byline_info"),
    ("product_detail", "Package Dimensions", "p_type IN ('SMALL', 'MEDIUM')", "CAST(p_size AS STRING)"),
    ("product_detail", "Is Discontinued By Manufacturer", "p_size > 40", "'No'"),
    ("product_detail", "#rank", "p_type = 'PROMO'", "'1'"),
    ("product_detail", "Best Sellers Rank", "score > 3.1", "p_type"),
    ("product_detail", "Special Edition", "p_size = 50 AND n5 > n1 * 3", "'Yes'"),
    ("product_detail", "Customer Reviews", "num_ratings > 0", f"concat('4.0 out of 5 stars ', {_VOTES_TEXT}, ' ratings')"),
    ("important_information", "Directions", "p_size BETWEEN 5 AND 30", "CASE WHEN p_type = 'LARGE' THEN '' ELSE p_type END"),
    ("important_information", "Safety Information", "n1 > 6", "'Keep dry'"),
    ("important_information", "Ingredients", "p_type = 'ECONOMY'", "product_title"),
    ("important_information", "Legal Disclaimer", "p_size > 20", "'None'"),
    ("important_information", "Indications", "n2 < n4", "'Any'"),
    ("important_information", "Allergens", "p_size = 7 AND p_type = 'PROMO'", "'Nuts'"),
    ("important_information", "#note", "p_size > 25", "'x'"),
]

# Long form of the two maps, read by the SQL twins only.
PRODUCT_ITEMS = "\nUNION ALL ".join(
    f"SELECT product_id, '{s}' AS section, '{i}' AS item, {v} AS value, score, score_polarization_index "
    f"FROM product_info WHERE {c}"
    for s, i, c, v in ITEMS
)

# Comments on product pages, two to a row; dates, titles and scores repeat across products.
COMMENTS = """
SELECT CAST(conv_id AS STRING) AS product_id, text, split_part(text, ' ', 1) AS title,
       1 + (conv_id + turn) % 5 AS stars, (conv_id * 7 + turn * 3) % 28 AS day,
       CASE WHEN turn = 0 THEN 'One' WHEN turn = 1 THEN concat('1,', lpad(CAST(conv_id % 1000 AS STRING), 3, '0'))
            ELSE '0' END AS votes
FROM conversations"""


def load(spark: SparkSession, sf_dir: str, sql: str, spread: bool = False) -> DataFrame:
    """A view over the Parquet tables of ``sf_dir``; with ``spread`` their rows are dealt evenly over the shuffle's width first."""
    ensure_settings(spark)
    for name in TABLES:
        if f" {name}" in sql:
            table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            (table.repartition(shuffle_width(spark)) if spread else table).createOrReplaceTempView(name)
    return spark.sql(sql)


def star_counts(spark: SparkSession, sf_dir: str, reviews: DataFrame | None = None) -> DataFrame:
    """The view ``PRODUCT_ROWS``; over ``reviews``, rows of ``RATINGS`` that are stored already, it does not join them again."""
    if reviews is None:
        return load(spark, sf_dir, PRODUCT_ROWS)
    reviews.createOrReplaceTempView("stored_reviews")
    return load(spark, sf_dir, PRODUCT_ROWS.replace(f"({RATINGS}) r", "stored_reviews r"))


def product_rows(spark: SparkSession, sf_dir: str, reviews: DataFrame | None = None) -> DataFrame:
    """Products without their descriptions."""
    shares = F.array(*[F.col(f"n{i}").cast("double") for i in range(1, 6)])
    index = F.round(polarization(shares), 9)
    return star_counts(spark, sf_dir, reviews).withColumn("score_polarization_index", index)


def product_info(spark: SparkSession, sf_dir: str, reviews: DataFrame | None = None) -> DataFrame:
    """Products with their descriptions.

    The product rows are few bytes each, so after their aggregation they sit in few partitions.
    They are spread before the texts join them, since the work on the texts is the costly part.
    """
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("doc_key"), F.col("text").alias("product_description")
    )
    rows = product_rows(spark, sf_dir, reviews).repartition(shuffle_width(spark), "doc_key")
    return rows.join(texts, "doc_key", "left").drop("doc_key")


def measured_products(spark: SparkSession, sf_dir: str, measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Described products with what ``measure`` adds to ``product_description``, and without the texts.

    A document describes many products. It is measured once, and only if it describes one; the products join the measures.
    """
    rows = stage(product_rows(spark, sf_dir).select("doc_key", "num_ratings", "score", "score_polarization_index"))
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("doc_key"), F.col("text").alias("product_description")
    )
    used = texts.where(F.col("product_description").isNotNull()).join(rows.select("doc_key").distinct(), "doc_key", "left_semi")
    # Spread by the key of the join: the texts may come in few splits, and the work on them is the costly part.
    measured = measure(used.repartition(shuffle_width(spark), "doc_key")).drop("product_description")
    return rows.join(measured, "doc_key").drop("doc_key")


def with_item_maps(info: DataFrame) -> DataFrame:
    """The two description maps of each product, built row by row."""

    def section(name: str):
        entries = F.array(
            *[
                F.when(F.expr(c), F.struct(F.lit(i).alias("k"), F.expr(v).cast("string").alias("v")))
                for s, i, c, v in ITEMS
                if s == name
            ]
        )
        return F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))

    return info.withColumns({s: section(s) for s in ("product_detail", "important_information")})


def product_documents(spark: SparkSession, sf_dir: str, reviews: DataFrame | None = None) -> DataFrame:
    """Products as loaded from pages: nested columns and display texts."""
    info = with_item_maps(product_info(spark, sf_dir, reviews))
    tenths = F.floor(F.col("score") * 10).cast("int")
    stars = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" out of 5 stars"))
    entries = []
    for i in range(1, 6):
        percent = F.floor(F.col(f"n{i}") * 100.0 / F.col("num_ratings")).cast("int").cast("string")
        entries += [F.lit(f"{i} star"), F.concat(percent, F.lit("%"))]
    rating = F.struct(stars.alias("score"), F.create_map(*entries).alias("dist"))
    aisle = F.when(F.col("p_type") == "PROMO", "Grocery & Gourmet Food").otherwise("Home")
    return info.select(
        "product_id",
        "product_title",
        "byline_info",
        "product_description",
        F.array(aisle, F.col("p_type")).alias("category"),
        F.array_repeat(F.lit("https://example.org/a.jpg"), F.col("count_alt_images")).alias("alt_images"),
        "product_detail",
        "important_information",
        F.when(F.col("num_ratings") > 0, rating).alias("rating"),
        F.array().cast(f"array<{COMMENT.simpleString()}>").alias("top_comments"),
    )


def commented_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product documents holding two comments each."""
    rows = load(spark, sf_dir, COMMENTS)
    day = F.date_add(F.lit("2025-08-01").cast("date"), F.col("day").cast("int"))

    def comment(text, votes):
        return F.struct(
            F.date_format(day, "MMMM d, yyyy").alias("date"),
            F.col("title").alias("title"),
            F.concat(F.col("stars").cast("string"), F.lit(".0 out of 5 stars")).alias("score"),
            text.alias("text"),
            votes.alias("helpfulness"),
        )

    both = F.array(comment(F.col("text"), F.col("votes")), comment(F.lit("Same again"), F.lit("0")))
    return rows.select("product_id", both.alias("top_comments"))


# Parts of the shared pages, by patterns both engines read.
PAGE_PARTS = """
SELECT page_id, regexp_extract(html, '<h1>([^<]*)', 1) AS title,
       regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a></li>', 1) AS addresses,
       regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS labels,
       regexp_extract_all(html, '<p>([^<]+)', 1) AS paragraphs
FROM pages"""

# Product pages made of those parts: well-formed ones, ones that leave list items, paragraphs and other elements open, and
# ones with more elements inside; on every seventh a part of the rating is missing.
_OPEN, _MORE = "page_id % 3 = 1", "page_id % 3 = 2"
_END = f"CASE WHEN {_OPEN} THEN '' ELSE '</li>' END"
_SHARE = "a-section a-spacing-none a-text-right aok-nowrap"
PRODUCT_PAGES = f"""
SELECT page_id, concat(
  '<html><body><!-- <span id="productTitle">no</span> -->', CASE WHEN {_OPEN} THEN '<b><p>' WHEN {_MORE} THEN '<div><div></div>' ELSE '' END,
  '<span class="big" id="productTitle"> ', title, ' </span><a id="bylineInfo" href="#">Visit ', coalesce(get(labels, 0), ''), '</a>',
  '<div id="wayfinding-breadcrumbs_feature_div"><ul>',
  array_join(transform(labels, x -> concat('<li><a href="#">', x, '</a>', {_END})), ' › '), '</ul>',
  CASE WHEN {_MORE} THEN '<div><div></div></div>' ELSE '' END, '</div><div>none</div>',
  '<div id="altImages">', array_join(transform(labels, (x, i) -> concat('<img alt="a" src="https://m.media-amazon.com/images/I/',
    CAST(page_id * 100 + i AS STRING), CASE WHEN i % 3 = 2 THEN '._SS40_.png' ELSE '._AC_US40_.jpg' END, '">')), ''), '</div><img src="x.jpg">',
  '<div id="detailBullets_feature_div"><ul>', array_join(transform(labels, (x, i) -> concat('<li><span>', x, '</span> \n : <b>', get(addresses, i),
    CASE WHEN {_OPEN} THEN '' ELSE '</b>' END, {_END})), ''), '</ul></div>',
  '<div id="cm_cr_dp_d_rating_histogram"><span class="a-size-medium a-color-base">', CAST(1 + page_id % 5 AS STRING), ' out of 5</span><ul id="histogramTable">',
  array_join(transform(sequence(1, 5), k -> concat('<li><div class="a-section a-spacing-none a-text-left aok-nowrap"> ', CAST(k AS STRING), ' star<span>x</span></div>',
    '<div class="', CASE WHEN page_id % 7 = 0 AND k = 3 THEN 'other' ELSE '{_SHARE}' END, '"><i>y</i>', CAST((page_id + k) % 100 AS STRING), '%</div>', {_END})), ''),
  '</ul></div><ul id="cm-cr-dp-review-list">',
  array_join(transform(paragraphs, (p, i) -> concat('<li><a class="a-link review-title-content"><span class="a-icon-alt">', CAST(1 + i % 5 AS STRING), '.0 out of 5 stars</span><span> ',
    title, ' </span></a>', CASE WHEN i % 4 = 3 THEN '' ELSE concat('<span class="review-date a-color">Reviewed on August ', CAST(1 + i % 28 AS STRING), ', 2025</span>') END,
    '<div class="a-expander review-text-content"><span>', p, CASE WHEN {_OPEN} THEN '' ELSE '</span>' END, '</div>',
    CASE WHEN i % 2 = 0 THEN concat('<span class="cr-vote-text"> ', CAST(i AS STRING), ' people found this helpful</span>') ELSE '' END, {_END})), ''),
  '</ul></body></html>') AS html
FROM ({PAGE_PARTS})"""
