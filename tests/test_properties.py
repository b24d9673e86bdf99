"""Properties over random inputs."""

from __future__ import annotations

import math
import re
from random import Random

import pytest
from pyspark.sql import functions as F

from criticlens.functions import stats
from criticlens.operators.pages import element



@pytest.fixture(scope="module")
def tails(spark):
    """(t, n, p of t, p of -t, p of 1.1 t) of random t and n, by the column expression."""
    random = Random(1)
    rows = [(random.choice([0.0, random.uniform(0, 5), random.uniform(0, 100)]), int(10 ** random.uniform(0.5, 9))) for _ in range(300)]
    df = spark.createDataFrame([*rows, (0.0, 3), (2.0, 2), (2.0, 0)], "t double, n long")
    t, n = F.col("t"), F.col("n")
    found = df.select("t", "n", stats.p_value(t, n).alias("p"), stats.p_value(-t, n).alias("q"), stats.p_value(1.1 * t, n).alias("r"))
    return found.collect()


def test_p_is_a_probability_and_symmetric(tails):
    assert all(r["p"] is None for r in tails if r["n"] < 3)
    assert all(0 <= r["p"] <= 1 and math.isclose(r["p"], r["q"], rel_tol=1e-12) for r in tails if r["n"] >= 3)
    assert all(math.isclose(r["p"], 1, rel_tol=1e-6) for r in tails if r["n"] >= 3 and r["t"] == 0)


def test_p_falls_with_t(tails):
    assert all(r["r"] < r["p"] for r in tails if r["n"] >= 3 and r["t"] > 0 and r["p"] > 1e-300)


def test_p_approaches_the_normal_tail(tails):
    for r in tails:
        if r["n"] > 10**7 and r["t"] <= 5:
            assert math.isclose(r["p"], math.erfc(r["t"] / math.sqrt(2)), rel_tol=1e-4)


@pytest.fixture(scope="module")
def cut(spark):
    """The inside of the first div of many random pages."""
    random = Random(2)
    pieces = ["<div>", "</div>", '<div id="x" class="a b">', "<p>", "</p>", "<li>", "<br>", "</ul>", "a ", "<", "&amp;", "b>"]
    pages = ["".join(random.choices(pieces, k=random.randint(0, 25))) for _ in range(400)]
    html = F.col("html")
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    return df.select("html", element(html, ("div", None, None)).alias("first"), element(html, ("div", "class", "b")).alias("named")).collect()


def inside(page, tag):
    """Up to the balancing end tag, by counting."""
    start = re.search(tag, page)
    if not start:
        return None
    depth = 1
    for m in re.finditer(r"</?div[^<>]*>", page[start.end() :]):
        depth += -1 if m[0][1] == "/" else 1
        if not depth:
            return page[start.end() : start.end() + m.start()]
    return page[start.end() :]


def test_sections_end_where_their_tags_balance(cut):
    for r in cut:
        assert r["first"] == inside(r["html"], r"<div[^<>]*>") and r["named"] == inside(r["html"], r'<div id="x"[^<>]*>')
