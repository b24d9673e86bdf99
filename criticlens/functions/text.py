"""Text expressions. All run inside the JVM on whole texts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from criticlens.functions.words import MARKETING_WORDS, SPLIT_WORDS, STOP_WORDS

# Every Unicode space, including the ones Java's \s leaves out.
_SPACES = r"[ \s\x1c-\x1f\x85\p{Z}]+"
_WORD_CHAR = r"[\p{L}\p{N}]"
_VOWEL = "[aeiouy]"
_CONSONANT = r"[\p{L}\p{N}&&[^aeiouy]]"
# A word of three or more vowel groups; it may only start where a word starts, so each word is
# scanned once however long it is.
_COMPLEX_WORD = (
    rf"(?<!{_WORD_CHAR}){_CONSONANT}*+{_VOWEL}++{_CONSONANT}++{_VOWEL}++{_CONSONANT}++{_VOWEL}++{_WORD_CHAR}*+"
)


def clean_text(text: Column) -> Column:
    """Lower case, punctuation removed, spaces collapsed and trimmed; NULL stays NULL."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85]+", "")
    return F.trim(F.regexp_replace(bare, _SPACES, " "))


def tokenize(cleaned: Column) -> Column:
    """Words of a cleaned text; [] for an empty or missing text.

    Pass a stored column: the text is looked at several times. The pattern that splits words like
    "cannot" only runs on the texts that contain one.
    """
    starts = "|".join(f"{w[:n]}(?={w[n:]}(?![^ ]))" for w, n in SPLIT_WORDS.items())
    concerned = F.lit(False)
    for word in SPLIT_WORDS:
        concerned = concerned | cleaned.contains(word)
    parted = F.when(concerned, F.regexp_replace(cleaned, f"(?<![^ ])({starts})", "$1 ")).otherwise(cleaned)
    nothing = F.array().cast("array<string>")
    return F.when(cleaned != "", F.split(parted, " ")).otherwise(nothing)


def with_tokens(df: DataFrame, text_col: str, cleaned_col: str = "_cleaned", tokens_col: str = "_tokens") -> DataFrame:
    """Add the cleaned text and its words, each computed once."""
    cleaned = df.withColumn(cleaned_col, clean_text(F.col(text_col)))
    return cleaned.withColumn(tokens_col, tokenize(F.col(cleaned_col)))


def drop_words(tokens: Column, words: Iterable[str] = STOP_WORDS) -> Column:
    """Tokens that are not in ``words``, in order."""
    listed = sorted(set(words))
    return F.filter(tokens, lambda w: ~w.isin(listed))


def count_words(tokens: Column, words: Iterable[str]) -> Column:
    """How many tokens are in ``words``."""
    listed = sorted(set(words))
    return F.size(F.filter(tokens, lambda w: w.isin(listed)))


def add_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns, with later filters on them kept above their computation.

    A filter on a computed column is normally moved below the projection and computes it again,
    which doubles the work where the column comes from whole texts.
    """
    kept = [F.col(f"`{name}`") for name in df.columns if name not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def lexicon_sentiment(df: DataFrame, text_col: str, polarity: Mapping[str, int]) -> DataFrame:
    """Add ``sentiment_score``: share of positive words among the listed ones, smoothed towards one half.

    ``polarity`` maps a word to a positive or negative number. The texts are searched once; what
    is counted afterwards are the few hits.
    """
    hits = F.filter(F.col("_tokens"), lambda w: w.isin(sorted(polarity)))
    positive = count_words(F.col("_hits"), [w for w, p in polarity.items() if p > 0])
    negative = count_words(F.col("_hits"), [w for w, p in polarity.items() if p < 0])
    score = (positive + 1) / (positive + negative + 2).cast("double")
    searched = with_tokens(df, text_col).withColumn("_hits", hits)
    return add_once(searched, {"sentiment_score": score}).drop("_cleaned", "_tokens", "_hits")


def marketing_tone(df: DataFrame, text_col: str, words: Iterable[str] = MARKETING_WORDS) -> DataFrame:
    """Add ``marketing_tone_score``: hits per hundred words. Punctuation is kept, so "best," is no hit."""
    parts = F.array_remove(F.split(F.regexp_replace(F.lower(F.col(text_col)), _SPACES, " "), " "), "")
    score = count_words(F.col("_words"), words) / (F.size("_words") + 1) * 100
    return add_once(df.withColumn("_words", parts), {"marketing_tone_score": score}).drop("_words")


def description_length(text: Column) -> Column:
    """log2 of the number of words split on single spaces; an empty text counts one word."""
    return F.log2(F.size(F.split(text, " ", -1)))


def reading_ease(df: DataFrame, text_col: str) -> DataFrame:
    """Add the three published readability measures; 0 for a text without words.

    Syllables are vowel groups, and a complex word has three or more of them.
    """
    text, lowered = F.col(text_col), F.lower(F.col(text_col))
    counts = {
        "_words": F.regexp_count(text, F.lit(rf"{_WORD_CHAR}+")).cast("double"),
        "_sentences": F.greatest(F.regexp_count(text, F.lit("[.!?]+")), F.lit(1)).cast("double"),
        "_syllables": F.regexp_count(lowered, F.lit(f"{_VOWEL}+")).cast("double"),
        "_complex": F.regexp_count(lowered, F.lit(_COMPLEX_WORD)).cast("double"),
    }
    per_sentence = F.try_divide(F.col("_words"), F.col("_sentences"))
    per_word = F.try_divide(F.col("_syllables"), F.col("_words"))
    complex_share = F.try_divide(F.col("_complex"), F.col("_words"))
    measures = {
        "flesch_reading_ease": 206.835 - 1.015 * per_sentence - 84.6 * per_word,
        "flesch_kincaid_grade": 0.39 * per_sentence + 11.8 * per_word - 15.59,
        "gunning_fog": 0.4 * (per_sentence + 100 * complex_share),
    }
    measured = add_once(df.withColumns(counts), {n: F.coalesce(m, F.lit(0.0)) for n, m in measures.items()})
    return measured.drop(*counts)
