"""What a Python worker of the encoding takes at most: two of them share an executor with its JVM."""

import os
import random
import subprocess
import sys
import tracemalloc

from cloudloom.llm import pieces

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from cloudloom.llm import pieces
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {folder!r}).getOrCreate()
docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
pieces.encode(docs, pieces.load()).write.format("noop").mode("overwrite").save()
def most(batches):  # the same worker, as there is but one
    import pyarrow as pa
    for _ in batches:
        with open("/proc/self/status") as f:
            yield pa.RecordBatch.from_pydict({{"mb": [int(next(x for x in f if x.startswith("VmHWM")).split()[1]) // 1024]}})
print("MB", spark.range(1, numPartitions=1).mapInArrow(most, "mb long").first()[0])
"""


def test_encoding_worker(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, folder=str(tmp_path / "shared"))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    found = [int(line.split()[1]) for line in run.stdout.splitlines() if line.startswith("MB ")]
    assert run.returncode == 0 and found, run.stderr[-2000:]
    print(found)
    assert found[0] < 300


def test_many_long_words_are_not_all_remembered():
    """The lattices that are kept are bounded by their places, and start anew without changing a draw."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("etaoinshrdlu", k=50)) for _ in range(8_000)) for _ in range(10)]
    sampler = pieces.Sampler(pieces.Lattice(pieces.load()), 1)
    tracemalloc.start()
    drawn = [sampler.encode_all([t], [k])[0] for k, t in enumerate(texts)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print(most)
    assert most < 200e6
    assert sampler.encode_all([texts[0]], [0])[0].tolist() == drawn[0].tolist()
