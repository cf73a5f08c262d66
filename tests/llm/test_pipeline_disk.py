import os

from pyspark.sql import functions as F

import corpus_pipeline
from cloudloom.llm import linededup
from cloudloom.sources.shared import shared_folder

FOLDER = "/root/testdata/sf0.001"


def tables(spark):
    """Names of the written tables' columns in the shared folder, by folder."""
    top = os.path.dirname(shared_folder(spark).removeprefix("file:"))
    return {d: set(spark.read.parquet(f"{top}/{d}").columns) for d in os.listdir(top) if any(x.startswith("part-") for x in os.listdir(f"{top}/{d}"))}


def test_a_stage_s_table_goes_when_the_next_one_is_written(spark, monkeypatch):
    stages = [(f"s{k}", lambda s, docs, d, k=k: docs.withColumn(f"stage_{k}", F.lit(k))) for k in range(5)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    before = tables(spark)
    out = corpus_pipeline.run(spark, FOLDER)
    left = [c for d, c in tables(spark).items() if d not in before]
    assert len(left) == 1 and "stage_3" in left[0]
    assert out.where("stage_4 = 4 AND stage_0 = 0").count() == 200


def test_line_dedup_leaves_no_table_of_all_lines(spark):
    docs = spark.createDataFrame([(i, f"this line stands everywhere\nown line {i} of it", f"site{i}") for i in range(8)], "doc_id long, text string, source string")
    before = tables(spark)
    out = linededup.dedup_lines(docs)
    assert not [c for d, c in tables(spark).items() if d not in before and {"key", "pos"} <= c]
    assert sorted(r.n_removed for r in out.collect()) == [0] + [1] * 7
