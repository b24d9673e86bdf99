"""Score, weight and vote expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STARS = 5


def helpfulness_index(numerator: Column, denominator: Column) -> Column:
    """votes / total to two places; 0 without votes, NULL when the total is unknown."""
    ratio = F.bround(F.try_divide(numerator.cast("double"), denominator.cast("double")), 2)
    return F.when(denominator == 0, F.lit(0.0)).otherwise(ratio)


def weight_simple(numerator: Column) -> Column:
    """Helpful votes, at least one."""
    votes = F.greatest(F.coalesce(numerator, F.lit(0)), F.lit(0)).cast("double")
    return F.when(votes == 0, F.lit(1.0)).otherwise(votes)


def weight_smooth(
    numerator: Column, denominator: Column, a: float = 1.0, b: float = 1.0, lo: float = 0.05, hi: float = 10.0
) -> Column:
    """Smoothed helpful share times a log of the votes, clipped; NULL without a denominator."""
    share = F.try_divide(numerator + F.lit(a), denominator + F.lit(a + b))
    weight = share * (1 + F.log1p(denominator.cast("double")))
    return F.when(weight.isNotNull(), F.least(F.greatest(weight, F.lit(lo)), F.lit(hi)))


def polarization(shares: Column, alpha: float = 1.3, size: int = STARS) -> Column:
    """Esteban-Ray polarization of a distribution over 1..size; NULL in, NULL out."""
    n = [F.get(shares, F.lit(i)).cast("double") for i in range(size)]
    p = [F.try_divide(x, sum(n[1:], n[0])) for x in n]
    terms = []
    for i in range(size):
        distances = [p[j] * float(abs(i - j)) for j in range(size) if i != j]
        terms.append(F.pow(p[i], F.lit(1 + alpha)) * sum(distances[1:], distances[0]))
    return sum(terms[1:], terms[0])


def percent_distribution(dist: Column, size: int = STARS) -> Column:
    """{"1 star": "62%", ...} -> [62.0, ...] in star order; NULL when there is no histogram."""
    keys = F.array(*[F.lit(f"{i} star") for i in range(1, size + 1)])
    values = F.transform(keys, lambda k: F.rtrim(F.try_element_at(dist, k), F.lit("%")).try_cast("double"))
    return F.when(dist.isNotNull(), values)


def first_number(text: Column) -> Column:
    """4.5 from "4.5 out of 5 stars"."""
    return F.split_part(text, F.lit(" "), F.lit(1)).try_cast("double")


def rating_count(reviews_text: Column) -> Column:
    """Second to last word of the review line without commas; -1 when absent."""
    word = F.try_element_at(F.split(reviews_text, " "), F.lit(-2))
    return F.coalesce(F.replace(word, F.lit(","), F.lit("")).try_cast("bigint"), F.lit(-1).cast("bigint"))


def vote_count(text: Column) -> Column:
    """"One" -> 1, "1,234" -> 1234."""
    return F.when(text == "One", F.lit(1)).otherwise(F.replace(text, F.lit(","), F.lit("")).try_cast("int"))
