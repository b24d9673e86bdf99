"""Quality rules with thresholds learned per language and source.

The measures of a text are counted in the JVM. For every measure, each (lang, source) group and each
language gets its quartiles from a mergeable quantile sketch (``percentile_approx`` merges partial
sketches, so a group with a third of all rows is summed up where it lies). A document is dropped
when a measure lies beyond the fences of both its group and its language: Tukey's fences, widened
for short texts, whose rates vary by chance. The fixed base rule is applied besides.

Defined results: a NULL or blank text has no words and fails the base rule; NULL languages and
sources are groups of their own; a group whose documents all fail the base rule has no fences and
its language decides; repeated rows count as often as they occur; an empty table gives an empty
result. Only doc_id, text, lang and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from criticlens.session import stage

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
FENCE = 3.0
ACCURACY = 1000
#: How far a rate may move by chance in a text of one word; it shrinks with the root of the words.
SLACK = {"chars_per_word": 9.0, "symbol_rate": 1.0, "dup_line_rate": 6.0, "repeat_rate": 3.0, "capital_rate": 3.0}
#: Measures of which a low value is a fault too.
TWO_SIDED = {"chars_per_word"}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text; an empty array for NULL and blank texts."""
    plain = F.regexp_replace(text, f"^{GAP}|{GAP}$", "")
    return F.when(F.coalesce(plain, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(plain, GAP))


def _repeat_words(words: Column) -> Column:
    """Words covered by windows that occur twice or more, in time n log n."""

    def hashed(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[w[i + j] for j in range(WINDOW)]))

    def covered(at: Column) -> Column:
        last = F.size(at) - 1
        step = F.transform(at, lambda p, j: F.when(j == last, WINDOW).otherwise(F.least(F.lit(WINDOW), at[F.least(j + 1, last)] - p)))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, b: a + b)

    def repeated(hashes: Column) -> Column:
        def positions(pairs: Column) -> Column:
            last = F.size(pairs) - 1
            same = lambda s, j: (
                ((j > 0) & (pairs[F.greatest(j - 1, F.lit(0))]["h"] == s["h"]))
                | ((j < last) & (pairs[F.least(j + 1, last)]["h"] == s["h"]))
            )
            return F.array_sort(F.transform(F.filter(pairs, same), lambda s: s["i"]))

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(found, let(let(pairs, positions), covered)).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(hashed(words), repeated))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and the measures that thresholds are learned for."""
    text = F.coalesce("text", F.lit(""))
    symbols = F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", ""))
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}!]+", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    word_counts = let(
        words_of(F.col("text")),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("repeat")),
    )
    counted = docs.select(
        "doc_id",
        "lang",
        "source",
        F.length(F.regexp_replace(text, GAP, "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        capitals.alias("n_capitals"),
        line_counts.alias("lines"),
        word_counts.alias("words"),
    )
    n = F.col("words.n")
    return stage(
        counted.select(
            "doc_id",
            "lang",
            "source",
            n.alias("n_words"),
            "word_chars",
            "n_symbols",
            F.col("lines.dup").cast("long").alias("n_dup_lines"),
            F.col("words.repeat").alias("n_repeat_words"),
            ((n < MIN_WORDS) | (F.col("words.repeat") * 100 > n * MAX_REPEAT_PERCENT)).alias("base_failed"),
            (F.col("word_chars") / F.greatest(n, F.lit(1))).alias("chars_per_word"),
            (F.col("n_symbols") / F.greatest(n, F.lit(1))).alias("symbol_rate"),
            (F.col("lines.dup") / F.greatest(F.col("lines.n"), F.lit(1))).alias("dup_line_rate"),
            (F.col("words.repeat") / F.greatest(n, F.lit(1))).alias("repeat_rate"),
            (F.col("n_capitals") / F.greatest(n, F.lit(1))).alias("capital_rate"),
        )
    )


def fences(measured: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """Quartiles of every measure over the documents that pass the base rule, one row per group."""
    quartiles = [
        F.percentile_approx(m, [0.25, 0.75], ACCURACY).alias(f"{prefix}{m}") for m in SLACK
    ]
    return measured.where(~F.col("base_failed")).groupBy(*[F.col(c).alias(f"{prefix}{c}") for c in by]).agg(*quartiles)


def outside(measure: str, prefix: str) -> Column:
    """Whether the measure lies beyond the fences of this group; NULL where the group has none."""
    low, high = F.col(f"{prefix}{measure}")[0], F.col(f"{prefix}{measure}")[1]
    room = FENCE * (high - low) + SLACK[measure] / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    above = F.col(measure) > high + room
    return above | (F.col(measure) < low - room) if measure in TWO_SIDED else above


def judge_quality(docs: DataFrame) -> DataFrame:
    """The base counts, base_failed and kept for every row of ``docs``."""
    measured = measures(docs)
    group = fences(measured, ["lang", "source"], "_g_")
    language = fences(measured, ["lang"], "_l_")
    joined = measured.join(
        group, F.col("lang").eqNullSafe(F.col("_g_lang")) & F.col("source").eqNullSafe(F.col("_g_source")), "left"
    ).join(language, F.col("lang").eqNullSafe(F.col("_l_lang")), "left")
    faults = F.lit(False)
    for m in SLACK:
        by_language = F.coalesce(outside(m, "_l_"), F.lit(False))
        faults = faults | (F.coalesce(outside(m, "_g_"), by_language) & by_language)
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~faults).alias("kept"),
    )
