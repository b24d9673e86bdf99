"""Why reviews are negative: keywords, categories, and issues per product."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from criticlens.functions.words import DOMAIN_STOP_WORDS, REASON_CATEGORIES, STOP_WORDS
from criticlens.operators.joins import hot_keys, lookup_join
from criticlens.session import stage

# Published noun endings and what they become in the base form.
NOUN_ENDINGS = {
    "s": "",
    "ses": "s",
    "ves": "f",
    "xes": "x",
    "zes": "z",
    "ches": "ch",
    "shes": "sh",
    "men": "man",
    "ies": "y",
}


def negative_reviews(df: DataFrame, score_threshold: int = 2, sentiment_threshold: float = 0.4) -> DataFrame:
    """Low rating and low sentiment, both known."""
    return df.where((F.col("score") <= score_threshold) & (F.col("sentiment_score") < sentiment_threshold))


def _base_forms(word: Column) -> Column:
    """Every form the noun endings allow for a word."""
    forms = [
        F.when(word.endswith(old), F.concat(F.left(word, F.length(word) - len(old)), F.lit(new)))
        for old, new in NOUN_ENDINGS.items()
    ]
    return F.array_distinct(F.filter(F.array(*forms), lambda f: f.isNotNull() & (f != "") & (f != word)))


def _has_ending(word: Column) -> Column:
    return F.size(_base_forms(word)) > 0


def vocabulary(df: DataFrame, keywords_col: str = "keywords") -> DataFrame:
    """(word, n): distinct lower-case words and the number of rows with them."""
    words = F.array_distinct(F.transform(F.col(keywords_col), F.lower))
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def lemma_table(words: DataFrame) -> DataFrame:
    """(word, lemma): words whose shortest known base form is another word of the vocabulary."""
    forms = words.select("word", F.explode(_base_forms(F.col("word"))).alias("lemma"))
    known = forms.join(words.select(F.col("word").alias("lemma")), "lemma", "left_semi")
    best = F.min(F.struct(F.length("lemma").alias("size"), F.col("lemma")))
    return (
        known.groupBy("word")
        .agg(best.alias("best"))
        .select("word", F.col("best.lemma").alias("lemma"))
    )


def clean_keywords(
    df: DataFrame,
    extra_stop_words: Iterable[str] = DOMAIN_STOP_WORDS,
    min_len: int = 3,
    keywords_col: str = "keywords",
) -> DataFrame:
    """Add ``cleaned_keywords``: base forms without stop words and short words, in order.

    The input is staged with a row number, since the vocabulary, the lookup and the result all
    read it. Only words with a noun ending are looked up, by position and with frequent words
    spread over several tasks; sorting the positions of a row puts both kinds together again.
    """
    rows = stage(df.withColumn("_row", F.monotonically_increasing_id()))
    words = stage(vocabulary(rows, keywords_col))
    inflected = words.where(_has_ending(F.col("word")))
    lemmas = inflected.join(lemma_table(words), "word", "left").select("word", F.coalesce("lemma", "word").alias("lemma"))
    stop = sorted(set(STOP_WORDS) | set(extra_stop_words))

    def stays(word: Column) -> Column:
        return ~word.isin(stop) & (F.length(word) >= min_len)

    lowered = F.transform(F.col(keywords_col), F.lower)
    asked = rows.select("_row", F.posexplode(lowered).alias("pos", "word")).where(_has_ending(F.col("word")))
    found = lookup_join(asked, lemmas, "word", hot_keys(inflected, "word")).where(stays(F.col("lemma")))
    based = found.groupBy("_row").agg(F.collect_list(F.struct("pos", F.col("lemma").alias("word"))).alias("_based"))
    placed = F.transform(lowered, lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    plain = F.filter(placed, lambda p: ~_has_ending(p["word"]) & stays(p["word"]))
    both = F.when(F.col("_based").isNull(), plain).otherwise(F.concat(plain, F.col("_based")))
    kept = F.transform(F.sort_array(both), lambda p: p["word"])
    return rows.join(based, "_row", "left").withColumn("cleaned_keywords", kept).drop("_row", "_based")


def keyword_counts(df: DataFrame, keywords_col: str = "cleaned_keywords") -> DataFrame:
    return (
        df.select(F.explode(keywords_col).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("frequency"))
    )


def top_keywords(df: DataFrame, top_n: int = 30, keywords_col: str = "cleaned_keywords") -> DataFrame:
    """Most frequent keywords; ties in alphabetical order."""
    return keyword_counts(df, keywords_col).orderBy(F.desc("frequency"), "keyword").limit(top_n)


def reason_category(keyword: Column, mapping: Mapping[str, Sequence[str]] = REASON_CATEGORIES) -> Column:
    """Category listing the keyword; the last one wins, and "other" is the rest."""
    category = F.lit("other")
    for name, terms in mapping.items():
        category = F.when(keyword.isin(list(terms)), F.lit(name)).otherwise(category)
    return category


def categorize(df: DataFrame, mapping: Mapping[str, Sequence[str]] = REASON_CATEGORIES) -> DataFrame:
    return df.withColumn("category", reason_category(F.col("keyword"), mapping))


def category_share(df: DataFrame) -> DataFrame:
    """Keyword frequency per category and its percentage of all, largest first.

    The categories are those of the mapping plus "other", so they fit one array; that gives the
    total without a second pass.
    """
    totals = df.groupBy("category").agg(F.sum("frequency").alias("frequency"))
    packed = totals.agg(
        F.collect_list(F.struct("category", "frequency")).alias("rows"), F.sum("frequency").alias("total")
    )
    share = F.try_divide(F.col("frequency") * 100.0, F.col("total"))
    return (
        packed.select("total", F.inline("rows"))
        .select("category", "frequency", share.alias("share_percent"))
        .orderBy(F.desc("frequency"), "category")
    )


def top_products(df: DataFrame, top_n_products: int = 10) -> DataFrame:
    """Products with the most negative reviews that have a score."""
    return (
        df.where(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(F.count("score").alias("negative_review_count"))
        .orderBy(F.desc("negative_review_count"), "product_id")
        .limit(top_n_products)
    )


def product_keywords(df: DataFrame, products: DataFrame, keywords_col: str = "cleaned_keywords") -> DataFrame:
    """(product_id, keyword, frequency) of the given few products.

    The long form of a per-product keyword list: a product with very many reviews stays many rows.
    """
    chosen = df.join(F.broadcast(products.select("product_id")), "product_id")
    return (
        chosen.select("product_id", F.explode(keywords_col).alias("keyword"))
        .groupBy("product_id", "keyword")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )


def product_issues(
    df: DataFrame, top_n_products: int = 10, top_k: int = 5, keywords_col: str = "cleaned_keywords"
) -> DataFrame:
    """The products with most negative reviews and their most frequent keywords."""
    products = top_products(df, top_n_products)
    order = Window.partitionBy("product_id").orderBy(F.desc("frequency"), "keyword")
    best = (
        product_keywords(df, products, keywords_col)
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= top_k)
        .groupBy("product_id")
        .agg(F.array_sort(F.collect_list(F.struct("position", "keyword"))).getField("keyword").alias("top_issues"))
    )
    nothing = F.array().cast("array<string>")
    return (
        products.join(best, "product_id", "left")
        .withColumn("top_issues", F.coalesce("top_issues", nothing))
        .orderBy(F.desc("negative_review_count"), "product_id")
    )
