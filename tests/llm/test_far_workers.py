"""Queries run where executors have no copy of the package: only the driver's own path holds it."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

pytest.importorskip("barloom.llm.queries")

REPO = Path(__file__).resolve().parent.parent.parent
CODE = """
import sys
from pyspark.sql import SparkSession

conf = {"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": "file://" + sys.argv[2]}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
spark.range(8).repartition(4).mapInPandas(lambda x: x, "id long").count()  # workers start before the path is changed
sys.path.insert(0, sys.argv[1])
from barloom.llm import queries
import corpus_pipeline

every = {f.__name__: f for f in queries.REGISTERED} | {"pipeline": corpus_pipeline.run}
for name in sys.argv[4:] or every:
    try:
        print("ROWS", name, every[name](spark, sys.argv[3]).count(), flush=True)
    except Exception as e:
        print("FAILED", name, str(e)[-600:], flush=True)
"""


def test_all_queries(tmp_path, sf):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, str(REPO), str(tmp_path / "shared"), sf], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1500)
    found = [line for line in done.stdout.splitlines() if line.startswith(("ROWS", "FAILED"))]
    assert len(found) == 14 and not [x for x in found if x.startswith("FAILED")], (found, done.stderr[-2000:])
