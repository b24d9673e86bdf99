"""Target-distribution importance resampling: documents drawn towards the distribution of a target table.

Each text becomes one array of feature buckets, written once: lower-case A-Z, words, runs of ``LENGTHS`` words, and of
each run the CRC-32 of its UTF-8 bytes modulo ``BUCKETS``. The counts per bucket of both tables give one gain per bucket,
an array of exactly ``BUCKETS`` numbers (the only thing that passes through the driver), and the weight of a document is
the sum of the gains at its buckets. Its score adds a Gumbel draw that depends on ``SEED`` and doc_id alone, so the
highest scores are a sample without replacement by importance.

The cutoff comes from bisection, one exact count job over the written scores per step: first the score, then doc_id among
the rows tied at that score. The rows above it are dealt out by range of (score, doc_id) and numbered inside their ranges;
all others pass without any order.

Defined results: a NULL or empty text has no features, weight 0 and is never drawn; a NULL doc_id counts as the empty
string in the draw and comes last among ties; rows that agree in score and doc_id are ordered by n_features, and beyond that
their order is free, for they are alike; an empty target gives gains from the documents alone; empty documents give an empty
result. Only doc_id (an integer) and text are read.
"""

from __future__ import annotations

from collections.abc import Callable
from math import floor, log
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from criticlens.llm.ordered import with_position
from criticlens.session import stage

BUCKETS = 10000
LENGTHS = (1, 1)
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: What stands between words, once A-Z are lower-case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z only; none for NULL."""
    whole = F.coalesce(text, F.lit(""))
    # lower() is the same as translating A-Z where every character takes one byte, and much faster.
    ascii_only = F.octet_length(whole) == F.length(whole)
    lower = F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, ascii_uppercase, ascii_lowercase))
    return F.filter(F.split(lower, GAP), lambda w: w != "")


def runs(words: Column, lengths: tuple[int, int] = LENGTHS) -> Column:
    """All runs of ``lengths[0]`` to ``lengths[1]`` consecutive words, each joined by one space."""
    parts = [words] if lengths[0] == 1 else []
    for n in range(max(lengths[0], 2), lengths[1] + 1):
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")))  # noqa: B023
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def with_buckets(docs: DataFrame, keep: list[str], buckets: int = BUCKETS, lengths: tuple[int, int] = LENGTHS) -> DataFrame:
    """``keep``, n_words and the array of feature buckets per row, written once."""
    split = docs.select(*keep, words_of(F.col("text")).alias("_words"))
    places = F.transform(runs(F.col("_words"), lengths), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(buckets)).cast("int"))
    return stage(split.select(*keep, F.size("_words").cast("long").alias("n_words"), places.alias("buckets")))


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features per bucket, as a list of ``buckets`` numbers."""
    found = features.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = [0] * buckets
    for b, n in found:
        counts[b] = n
    return counts


def gains(source: list[int], target: list[int], buckets: int = BUCKETS) -> list[int]:
    """Thousandths of the log ratio of smoothed target and source shares, rounded down, per bucket."""
    s_all, t_all = float(sum(source) + buckets), float(sum(target) + buckets)
    return [floor(1000 * log(float(t + 1) * s_all / (float(s + 1) * t_all))) for s, t in zip(source, target)]


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw per id, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _least(low: int, high: int, enough: Callable[[int], bool]) -> int:
    """The smallest number of low..high that is ``enough``; ``high`` is taken to be."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle + 1, high)
    return low


def drawn(scored: DataFrame, n: int) -> Column:
    """Condition on (score, doc_id) that holds for the ``n`` first rows of a written table, and for rows that tie with the last in both."""
    score, doc = F.col("score"), F.col("doc_id")
    if n <= 0:
        return F.lit(False)
    low, high = scored.agg(F.min(score), F.max(score)).first()
    # The highest cutoff that leaves at least n rows: bisection over falling scores.
    cut = -_least(-high, -low, lambda x: scored.where(score >= -x).count() >= n)
    missing = n - scored.where(score > cut).count()
    tied = scored.where(score == cut)
    rows, first, last, known = tied.agg(F.count(F.lit(1)), F.min(doc), F.max(doc), F.count(doc)).first()
    if missing >= rows or missing > known:
        return score >= cut
    upto = _least(first, last, lambda x: tied.where(doc <= x).count() >= missing)
    return (score > cut) | ((score == cut) & F.coalesce(doc <= upto, F.lit(False)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (NULL when not drawn) of every row of ``docs``."""
    features = with_buckets(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"])
    by_bucket = gains(bucket_counts(features), bucket_counts(with_buckets(target.select("text"), [])))
    table = F.expr(f"cast(split('{','.join(map(str, by_bucket))}', ',') as array<bigint>)")
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.get(table, b))
    scored = features.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    scored = stage(
        scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("_row", F.monotonically_increasing_id())
    )
    long_enough = scored.where(F.col("n_words") >= min_words)
    n = long_enough.count() * percent // 100
    chosen = (F.col("n_words") >= min_words) & drawn(long_enough, n)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("_row")]
    placed = with_position(scored.where(chosen), order, "_at")
    rank = F.when(F.col("_at") < n, F.col("_at") + 1).cast("long")
    names = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(~chosen).select(*names, F.lit(None).cast("long").alias("rank"))
    return placed.select(*names, rank.alias("rank")).unionByName(rest)
