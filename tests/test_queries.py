"""Every registered query against its SQL twin, and the shape of its plan."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from compare import differences, duck

import __spark_entry__ as entry_point
from criticlens.plans.oracle import ORACLE
from criticlens.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="shared tables are not here")

NAMES = sorted(QUERIES)
WITHOUT_TWIN = {"sentiment_model_score"}
#: The one query whose purpose is a model of the user's own, in Arrow batches.
OWN_MODEL = {"sentiment_batch_score"}


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


def test_every_query_has_a_twin():
    assert set(NAMES) - set(ORACLE) == WITHOUT_TWIN
    assert set(ORACLE) <= set(NAMES)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connection, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert unwanted not in plan.replace("ArrowEvalPython" if name in OWN_MODEL else "-", "-")
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line):
            assert not any("SinglePartition" in below for below in lines[i + 1 : i + 4])
    if name in WITHOUT_TWIN:
        scores = [r["sentiment_score"] for r in df.collect()]
        assert scores and all(0 <= s <= 1 for s in scores)
    else:
        assert differences(df, ORACLE[name], connection) == []


@pytest.mark.parametrize("name", NAMES)
def test_no_row_selection_by_id(name):
    """The SQL twins read whole tables: no sampling and no modulo filter on an id."""
    sql = ORACLE.get(name, "")
    assert "SAMPLE" not in sql.upper().split()
    assert not re.search(r"WHERE[^)]*key % ", sql)


def test_views_keep_every_text():
    from criticlens.plans import adapters

    for name, view in vars(adapters).items():
        if isinstance(view, str) and name.isupper():
            assert not re.search(r"CASE WHEN [^']*% \d+ = \d+ THEN NULL ELSE (text|html)", view), name
