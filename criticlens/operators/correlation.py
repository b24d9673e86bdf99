"""Rank correlation of product ratings with the features of their descriptions."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from criticlens.functions import stats, text
from criticlens.functions.words import MARKETING_WORDS, MISLEADING_ITEMS
from criticlens.operators.bins import cut, cut_counts, histograms
from criticlens.operators.cleaning import drop_incomplete
from criticlens.operators.joins import hot_keys, lookup_join
from criticlens.operators.ranks import average_ranks
from criticlens.session import stage

TARGETS = ["score", "score_polarization_index"]
READING_MEASURES = ["flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog"]


def _bounded(corr: Column) -> Column:
    """Rounding may carry a perfect correlation past one."""
    return F.when(corr > 1.0, F.lit(1.0)).when(corr < -1.0, F.lit(-1.0)).otherwise(corr)


def with_conclusion(df: DataFrame, with_p_value: bool = False) -> DataFrame:
    """Add t and the label of each correlation (columns ``corr`` and ``n``); optionally the p behind the label.

    A perfect correlation has no finite t; its p is 0.
    """
    perfect = F.coalesce(F.abs("corr") >= 1.0, F.lit(False))
    tested = df.withColumn("t", stats.t_statistic(F.col("corr"), F.col("n")))
    tested = tested.withColumn("p_value", F.when(perfect, 0.0).otherwise(stats.p_value(F.col("t"), F.col("n"))))
    labelled = tested.withColumn("conclusion", stats.conclusion(F.col("corr"), F.col("p_value")))
    return labelled if with_p_value else labelled.drop("p_value")


def complete_tuples(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct combinations of the columns without missing values, with their row count ``n``."""
    missing = F.lit(None).cast("double")
    numbers = df.select(*[F.nanvl(F.col(c).cast("double"), missing).alias(c) for c in columns])
    return drop_incomplete(numbers, columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def _tuple_counts(tuples: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("value")) for c in columns])
    return (
        tuples.select("n", F.inline(pairs))
        .groupBy("variable", "value")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_tuples"))
    )


def _hot_values(counts: DataFrame) -> dict[str, list[tuple[float, int]]]:
    """Per variable, its hot values in ``counts`` (variable, value, n) and their parts."""
    names = [row[0] for row in counts.select("variable").distinct().collect()]
    return {name: hot_keys(counts.where(F.col("variable") == name), "value") for name in names}


def _centred(ranks: DataFrame) -> DataFrame:
    """Ranks minus their mean, which is always (total + 1) / 2."""
    return ranks.withColumn("centred", F.col("rank") - (F.col("total") + 1) / 2)


def spearman(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(feature, compare_with, n, corr) for (feature, target) pairs over their common complete rows.

    Equal rows are merged first. Every column is ranked once, the ranks are looked up by value
    with frequent values spread, and all pairs are summed in one aggregate. A constant column
    has no correlation: NULL.
    """
    columns = sorted({c for pair in pairs for c in pair})
    tuples = stage(complete_tuples(df, columns))
    counts = stage(_tuple_counts(tuples, columns))
    ranks = _centred(average_ranks(counts))
    hot = _hot_values(counts.select("variable", "value", F.col("n_tuples").alias("n")))
    ranked = tuples
    for c in columns:
        table = ranks.where(F.col("variable") == c).select(
            F.col("value").alias(c), F.col("centred").alias(f"rank_{c}")
        )
        ranked = lookup_join(ranked, table, c, hot.get(c, []))
    n = F.col("n").cast("double")
    sums = ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        *[F.sum(n * F.col(f"rank_{c}") * F.col(f"rank_{c}")).alias(f"ss_{c}") for c in columns],
        *[F.sum(n * F.col(f"rank_{a}") * F.col(f"rank_{b}")).alias(f"sp_{i}") for i, (a, b) in enumerate(pairs)],
    )
    rows = []
    for i, (a, b) in enumerate(pairs):
        corr = F.try_divide(F.col(f"sp_{i}"), F.sqrt(F.col(f"ss_{a}")) * F.sqrt(F.col(f"ss_{b}")))
        rows.append(
            F.struct(
                F.lit(a).alias("feature"),
                F.lit(b).alias("compare_with"),
                F.col("n").alias("n"),
                _bounded(corr).alias("corr"),
            )
        )
    return sums.select(F.inline(F.array(*rows)))


def _quality(score: str, polarization: str, good_score: float, low_polarity: float) -> list[Column]:
    def share(condition: Column) -> Column:
        return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))

    return [
        F.count(score).alias("n_samples"),
        share(F.col(score) > good_score).alias("good_score_proportion"),
        share(F.col(polarization) < low_polarity).alias("low_polarity_proportion"),
    ]


def score_bins(df: DataFrame, column: str = "score", bins: int | None = None, min_ratings: int = 20) -> DataFrame:
    """Rated products per bin: a tenth of a point each, or ``bins`` equal widths."""
    kept = df.where(F.col("num_ratings") > min_ratings)
    count = F.lit(bins) if bins else F.floor((F.col("most") - F.col("least")) * 10 + 1)
    return cut_counts(kept, column, count)


def _described(df: DataFrame, min_ratings: int) -> DataFrame:
    rated = df.where(F.col("num_ratings") > min_ratings).select(*TARGETS, "product_description")
    rated = drop_incomplete(rated, rated.columns)
    length = text.description_length(F.col("product_description"))
    return text.add_once(rated, {"count_desc_length": length}).drop("product_description")


def length_bins(
    df: DataFrame, bins: int = 15, good_score: float = 4.5, low_polarity: float = 0.25, min_ratings: int = 10
) -> DataFrame:
    """Products, share of good scores and share of low polarization by description length."""
    described = stage(_described(df, min_ratings))  # the range and the counts are two passes
    rows, table = cut(described, "count_desc_length", bins)
    measures = rows.groupBy("bin").agg(*_quality(*TARGETS, good_score, low_polarity))
    joined = table.join(measures, "bin", "left")
    return joined.withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))


def length_correlation(df: DataFrame, min_ratings: int = 10, with_p_value: bool = False) -> DataFrame:
    pairs = [("count_desc_length", t) for t in TARGETS]
    return with_conclusion(spearman(_described(df, min_ratings), pairs), with_p_value)


def image_count_quality(
    df: DataFrame, good_score: float = 4.5, low_polarity: float = 0.25, min_ratings: int = 10
) -> DataFrame:
    """The same measures by number of images."""
    kept = df.where((F.col("num_ratings") > min_ratings) & F.col("count_alt_images").isNotNull())
    return kept.groupBy("count_alt_images").agg(*_quality(*TARGETS, good_score, low_polarity))


def image_correlation(df: DataFrame, with_p_value: bool = False) -> DataFrame:
    return with_conclusion(spearman(df, [("count_alt_images", t) for t in TARGETS]), with_p_value)


def marketed(df: DataFrame, words: Sequence[str] = MARKETING_WORDS) -> tuple[DataFrame, list[str]]:
    """Complete products with their marketing tone, and the names of the features present.

    A tone that ``df`` has already, measured once per distinct text, is taken instead of the texts.
    """
    features = ["sentiment_score"] if "sentiment_score" in df.columns else []
    measured = "marketing_tone_score" in df.columns
    kept = df.select(*TARGETS, *features, "marketing_tone_score" if measured else "product_description")
    kept = drop_incomplete(kept, kept.columns)
    if measured:
        return kept, [*features, "marketing_tone_score"]
    toned = text.marketing_tone(kept, "product_description", words).drop("product_description")
    return toned, [*features, "marketing_tone_score"]


def marketing_correlation(
    df: DataFrame, words: Sequence[str] = MARKETING_WORDS, with_p_value: bool = False
) -> DataFrame:
    """Correlation table of marketing tone and, where present, description sentiment."""
    toned, features = marketed(df, words)
    pairs = [(f, t) for t in TARGETS for f in features]
    table = with_conclusion(spearman(toned, pairs), with_p_value)
    return table.withColumnRenamed("feature", "sentiment_type").orderBy("sentiment_type", "compare_with", "corr")


def marketing_histograms(df: DataFrame, words: Sequence[str] = MARKETING_WORDS, n_bins: int = 25) -> DataFrame:
    """Distribution of the marketing features; staged, since ranges and counts are two passes."""
    toned, features = marketed(df, words)
    return histograms(stage(toned.select(*features)), features, n_bins)


def readable(df: DataFrame) -> DataFrame:
    """Complete products whose reading ease could be computed, with the measures.

    Measures that ``df`` has already, taken once per distinct text, are used instead of the texts.
    """
    present = set(READING_MEASURES) <= set(df.columns)
    columns = [*TARGETS, *(READING_MEASURES if present else ["product_description"])]
    kept = drop_incomplete(df, columns).select(*columns)
    measured = kept if present else text.reading_ease(kept, "product_description")
    return measured.where(F.col("flesch_reading_ease") != 0).drop("product_description")


def reading_histograms(df: DataFrame, n_bins: int = 25) -> DataFrame:
    """Distribution of the reading measures; staged, since ranges and counts are two passes."""
    return histograms(stage(readable(df).select(*READING_MEASURES)), READING_MEASURES, n_bins)


def reading_correlation(df: DataFrame, with_p_value: bool = False) -> DataFrame:
    pairs = [(m, t) for m in READING_MEASURES for t in TARGETS]
    table = with_conclusion(spearman(readable(df), pairs), with_p_value)
    return table.withColumnRenamed("feature", "ease_index")


def description_items(products: DataFrame, *keep: str) -> DataFrame:
    """(section, item, value, ...): one row per entry of the two description maps, in one pass."""
    nothing = F.array().cast("array<struct<section:string,item:string,value:string>>")

    def entries(section: str) -> Column:
        labelled = F.transform(
            F.map_entries(section),
            lambda e: F.struct(F.lit(section).alias("section"), e["key"].alias("item"), e["value"].alias("value")),
        )
        return F.coalesce(labelled, nothing)

    both = F.inline(F.concat(entries("product_detail"), entries("important_information")))
    return products.select(*keep, both).where(~F.col("item").startswith("#"))


def item_counts(products: DataFrame) -> DataFrame:
    """Products per description item."""
    return description_items(products).groupBy("section", "item").agg(F.count(F.lit(1)).alias("num_samples"))


def compared_items(counts: DataFrame, min_count: int = 10, exclude: Sequence[str] = MISLEADING_ITEMS) -> DataFrame:
    """Items to correlate: all of both sections that more than ``min_count`` products have."""
    return counts.where((F.col("num_samples") > min_count) & ~F.col("item").isin(list(exclude)))


def item_correlation(
    products: DataFrame, min_count: int = 10, exclude: Sequence[str] = MISLEADING_ITEMS, with_p_value: bool = False
) -> DataFrame:
    """Correlation of having a description item with the ratings.

    Ratings are ranked once. Having an item is yes or no, so its correlation needs only the
    number of products with it and the sum of their centred ranks: each product contributes the
    compared items it has, never the ones it lacks, and frequent ratings are spread.
    """
    items = stage(compared_items(item_counts(products), min_count, exclude))
    complete = drop_incomplete(products, TARGETS)
    pairs = F.array(
        *[F.struct(F.lit(t).alias("variable"), F.col(t).cast("double").alias("value")) for t in TARGETS]
    )
    counts = stage(
        complete.select(F.inline(pairs)).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    ranks = _centred(average_ranks(counts))
    present = stage(
        description_items(complete, *TARGETS)
        .where(F.col("value") != "")
        .join(items.select("section", "item"), ["section", "item"], "left_semi")
        .select("section", "item", F.inline(pairs))
        .groupBy("section", "item", "variable", "value")
        .agg(F.count(F.lit(1)).alias("k"))
    )
    hot = _hot_values(present.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n")))
    ranked = [
        lookup_join(
            present.where(F.col("variable") == t),
            ranks.where(F.col("variable") == t).select("value", "centred"),
            "value",
            hot.get(t, []),
        )
        for t in TARGETS
    ]
    sums = (
        functools.reduce(DataFrame.unionByName, ranked)
        .groupBy("section", "item", "variable")
        .agg(F.sum("k").alias("n_with"), F.sum(F.col("k") * F.col("centred")).alias("rank_sum"))
    )
    totals = ranks.groupBy("variable").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("centred") * F.col("centred")).alias("ss")
    )
    with_item, n = F.coalesce("n_with", F.lit(0)), F.col("n")
    spread = F.sqrt(F.col("ss") * with_item * (n - with_item) / n)
    targets = F.explode(F.array(*[F.lit(t) for t in TARGETS])).alias("variable")
    table = (
        items.select("section", "item", "num_samples", targets)
        .join(F.broadcast(totals), "variable")
        .join(sums, ["section", "item", "variable"], "left")
        .select(
            "item",
            F.element_at(F.split("section", "_"), -1).alias("category"),
            "num_samples",
            F.col("variable").alias("compare_with"),
            "n",
            _bounded(F.try_divide(F.col("rank_sum"), spread)).alias("corr"),
        )
    )
    return with_conclusion(table, with_p_value).orderBy("item", "compare_with", "corr")


def correlated_items(table: DataFrame) -> DataFrame:
    """The significant rows of an item correlation."""
    return table.where(F.col("conclusion") != stats.NOT_SIGNIFICANT)


def correlated_item_summary(table: DataFrame) -> DataFrame:
    """One row: correlated items and all items."""
    per_item = table.groupBy("item").agg(F.max(F.col("conclusion") != stats.NOT_SIGNIFICANT).alias("correlated"))
    return per_item.agg(F.count_if("correlated").alias("n_correlated"), F.count(F.lit(1)).alias("n_items"))


def score_density(products: DataFrame, items: Sequence[str], points: int = 200, cut_widths: float = 3.0) -> DataFrame:
    """(item, point, x, density): Gaussian kernel density of the score, of all products and by item.

    An item counts where a product detail has it; only items no detail has are looked up in the
    information section. Equal scores are one row before the grid is laid over them, and the sums
    per grid point are partial aggregates.
    """
    scored = products.where(F.col("score").isNotNull()).withColumn("score", F.col("score").cast("double"))
    named = description_items(products, "score").where(F.col("item").isin(list(items)))
    per_section = stage(
        named.groupBy("section", "item", F.col("score").cast("double").alias("score")).agg(
            F.count(F.lit(1)).alias("n")
        )
    )
    in_detail = per_section.where(F.col("section") == "product_detail").select("item").distinct()
    detail = per_section.where(F.col("section") == "product_detail")
    elsewhere = per_section.where(F.col("section") != "product_detail").join(in_detail, "item", "left_anti")
    everything = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("item", F.lit("All"))
    curves = stage(
        detail.unionByName(elsewhere)
        .where(F.col("score").isNotNull())
        .select("item", "score", "n")
        .unionByName(everything.select("item", "score", "n"))
    )
    mean = F.sum(F.col("score") * F.col("n")) / F.sum("n")
    centre = curves.groupBy("item").agg(
        F.sum("n").alias("total"), mean.alias("mean"), F.min("score").alias("least"), F.max("score").alias("most")
    )
    deviation = F.col("score") - F.col("mean")
    small = F.broadcast(centre)  # one row per listed item
    spread = curves.join(small, "item").groupBy("item", "total", "least", "most").agg(
        F.sqrt(F.try_divide(F.sum(F.col("n") * deviation * deviation), F.max("total") - 1)).alias("std")
    )
    width = F.col("std") * F.pow(F.col("total").cast("double"), F.lit(-0.2))
    shape = spread.select("item", "total", "least", "most", width.alias("h")).where(F.col("h") > 0)
    lo, hi = F.col("least") - cut_widths * F.col("h"), F.col("most") + cut_widths * F.col("h")
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    laid = curves.join(F.broadcast(shape), "item").select(
        "item", "score", "n", "total", "h", lo.alias("lo"), hi.alias("hi"), grid
    )
    x = F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / (points - 1)
    offset = (F.col("x") - F.col("score")) / F.col("h")
    kernel = F.col("n") * F.exp(-0.5 * offset * offset)
    root_two_pi = 2.5066282746310002
    return (
        laid.withColumn("x", x)
        .groupBy("item", "point", "x", "total", "h")
        .agg(F.sum(kernel).alias("mass"))
        .select("item", "point", "x", (F.col("mass") / (F.col("total") * F.col("h") * root_two_pi)).alias("density"))
    )


def binned_density(df: DataFrame, column: str, by: str, points: int = 200, cut_widths: float = 3.0, bins_per_width: int = 32) -> DataFrame:
    """(``by``, point, x, density): Gaussian kernel density of a continuous column, per value of ``by``.

    The values are dealt out linearly between the knots of a grid, ``bins_per_width`` to the kernel width h, so that the rows
    collapse in a partial aggregate; the kernel is then laid over knots instead of values. A group costs its rows plus
    knots times points. With knots d apart the result differs from the exact density by at most
    d^2 / (8 h^3 sqrt(2 pi)), the error of linear interpolation. NULL and NaN values and NULL groups are left out; a group with
    one distinct value has no width and no curve. ``by`` should have few values: its groups are joined by broadcast where Spark finds them small.
    """
    value = F.col(column).cast("double")
    rows = df.select(F.col(by).alias("_by"), value.alias("_v")).where(F.col("_by").isNotNull() & F.col("_v").isNotNull() & ~F.isnan("_v"))
    shape = rows.groupBy("_by").agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp("_v").alias("_std"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
    )
    width = F.col("_std") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    shape = shape.select("_by", "_n", width.alias("_h"), "_least", "_most").where(F.col("_h") > 0)
    low, high = F.col("_least") - cut_widths * F.col("_h"), F.col("_most") + cut_widths * F.col("_h")
    knots = F.ceil(bins_per_width * (high - low) / F.col("_h"))
    shape = stage(shape.select("_by", "_n", "_h", low.alias("_lo"), high.alias("_hi"), knots.alias("_m")))
    step = (F.col("_hi") - F.col("_lo")) / F.col("_m")

    at = (F.col("_v") - F.col("_lo")) / step
    dealt = rows.join(shape, "_by").select("_by", F.floor(at).alias("_k"), (at - F.floor(at)).alias("_f"))
    cells = dealt.groupBy("_by", "_k").agg(F.sum(1 - F.col("_f")).alias("_here"), F.sum("_f").alias("_next"))
    halves = F.array(F.struct(F.col("_k").alias("_k"), F.col("_here").alias("_w")), F.struct((F.col("_k") + 1).alias("_k"), F.col("_next").alias("_w")))
    weights = cells.select("_by", F.inline(halves)).groupBy("_by", "_k").agg(F.sum("_w").alias("_w"))

    laid = weights.join(shape, "_by").select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    x = F.col("_lo") + F.col("point") * (F.col("_hi") - F.col("_lo")) / (points - 1)
    offset = (x - F.col("_lo") - F.col("_k") * step) / F.col("_h")
    mass = F.sum(F.col("_w") * F.exp(-0.5 * offset * offset))
    root_two_pi = 2.5066282746310002
    return laid.groupBy("_by", "point", x.alias("x"), "_n", "_h").agg(mass.alias("_mass")).select(
        F.col("_by").alias(by), "point", "x", (F.col("_mass") / (F.col("_n") * F.col("_h") * root_two_pi)).alias("density")
    )
