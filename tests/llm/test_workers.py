"""Executors need no copy of this package: a driver that finds it on its own path only, as on a cluster."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {folder!r}).getOrCreate()
for name in ("op4_decontamination", "op8_token_counts", "op9_sentencepiece", "op10_language_id"):
    print(name, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, folder=str(tmp_path / "shared"))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    counts = dict(line.split() for line in run.stdout.splitlines() if line.startswith("op"))
    assert run.returncode == 0 and len(counts) == 4, run.stderr[-2000:]
    assert all(int(counts[k]) >= 200 for k in counts if k != "op4_decontamination")
