"""Rounds of loading against a bucketed table of known ids, and binned densities against exact ones."""

from __future__ import annotations

import math
import re
from random import Random

from pyspark.sql import functions as F

from criticlens.operators.correlation import binned_density
from criticlens.sources.loaded import LoadedProducts


def pids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "product_id string")


def test_rounds(spark, tmp_path):
    known = LoadedProducts(spark, "known_rounds", f"{tmp_path}/known")
    wanted = pids(spark, ["a", "b", "b", "c", None, "d"])
    left = lambda **k: sorted(r[0] for r in known.pending(wanted, **k).collect())
    try:
        assert not known.exists() and left() == ["a", "b", "c", "d"]
        known.record(pids(spark, ["b", "x", None, "b"]))
        assert left() == ["a", "c", "d"]
        known.record(known.pending(pids(spark, ["b", "d"])))
        assert left() == ["a", "c"] and left(replace=True) == ["a", "b", "c", "d"]
        known.record(pids(spark, []))
        assert left() == ["a", "c"] and known.pending(wanted.limit(0)).count() == 0
    finally:
        known.drop()


def test_known_ids_are_not_shuffled(spark, tmp_path):
    """With the table too large to broadcast, the only exchange is that of the wanted ids, one for all."""
    known = LoadedProducts(spark, "known_plan", f"{tmp_path}/known")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")if spark.conf.get(k, None)}
    try:
        for part in range(2):
            known.record(spark.range(1000).select((F.col("id") * 2 + part).cast("string").alias("product_id")))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        pending = known.pending(spark.range(4000).select((F.col("id") % 3000).cast("string").alias("product_id")))
        plan = pending._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"\bExchange\b", plan)) == 1 and "Bucketed: true" in plan
        assert "hashpartitioning" in plan and pending.count() == 1000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        known.drop()


def test_binned_density_is_within_its_bound(spark):
    random = Random(4)
    rows = [("a", random.gauss(10, 3)) for _ in range(400)] + [("b", random.expovariate(0.1)) for _ in range(300)]
    rows += [("c", 5.0), ("c", 5.0), ("d", 1.0), ("e", None), ("e", float("nan")), (None, 1.0)]
    df = spark.createDataFrame(rows, "item string, v double")
    found = binned_density(df, "v", "item", points=50).collect()
    assert {r["item"] for r in found} == {"a", "b"} and len(found) == 100
    for item in "ab":
        values = [v for i, v in rows if i == item]
        n, mean = len(values), sum(values) / len(values)
        h = math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1)) * n**-0.2
        low, high = min(values) - 3 * h, max(values) + 3 * h
        knots = math.ceil(32 * (high - low) / h)
        bound = ((high - low) / knots) ** 2 / (8 * h**3 * math.sqrt(2 * math.pi))
        for r in (r for r in found if r["item"] == item):
            assert math.isclose(r["x"], low + r["point"] * (high - low) / 49, rel_tol=1e-9)
            exact = sum(math.exp(-0.5 * ((r["x"] - v) / h) ** 2) for v in values) / (n * h * math.sqrt(2 * math.pi))
            assert abs(r["density"] - exact) <= bound + 1e-12
    assert binned_density(df.limit(0), "v", "item").count() == 0
