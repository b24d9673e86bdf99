from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

from criticlens import session


def test_stage_keeps_rows_and_types(spark):
    df = spark.createDataFrame(
        [(1, ["a"], {"k": "v"}, None), (2, [], {}, 0.5)], "id int, words array<string>, m map<string,string>, x double"
    )
    staged = session.stage(df)
    assert staged.schema == df.schema
    assert sorted(staged.collect(), key=lambda r: r.id) == df.collect()
    assert session.stage(df.limit(0)).count() == 0


def test_cluster_without_shared_folder_is_an_error(spark):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


SCRIPT = """
from criticlens import session
spark = session.build_session("t", "local[2]", **{"spark.ui.enabled": "false", "spark.checkpoint.dir": "file:%s"})
staged = session.stage(spark.range(5))
assert staged.count() == 5 and "%s" in staged.inputFiles()[0], staged.inputFiles()
assert session.release(spark)
"""


def test_configured_folder_is_used_and_released(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    script = SCRIPT % (tmp_path, tmp_path)
    done = subprocess.run(
        [sys.executable, "-c", script], env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True, timeout=120
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert not list(tmp_path.rglob("*.parquet"))
