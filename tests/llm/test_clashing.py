"""Callers' columns with the names of operators' own: none is lost, none crashes, results are the same."""

import json

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cloudloom.llm import decontaminate, jaccard, linededup, periodic, pieces, toolcalls

NAMES = ["_id", "_own", "_who", "_key", "_gone", "_parts", "_rest", "_ID_", "own", "id", "who", "set", "row", "line", "pos", "site", "key", "first"]
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    line = "the same boilerplate line stands on many sites"
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"own text number {i} {'x' * i}\n{line}", f"s{i}") for i in range(8)]
    rows += [(20, long, "s1"), (21, long + " more", "s2"), (None, long, "s3"), (22, None, None), (23, "", "s1"), (24, long, "s1"), (24, long, "s1")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))


def wide(docs):
    return docs.select("*", *[F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES])


def rows(df, columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())


def item(spark):
    return spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(40)) + ". word41 word42 word43 word44 word45")], "item_id long, text string")


OPERATORS = {
    "dedup": lambda s, d: jaccard.dedup(d),
    "clean": lambda s, d: decontaminate.clean(d, item(s)),
    "dedup_lines": lambda s, d: linededup.dedup_lines(d),
    "encode": lambda s, d: pieces.encode(d, pieces.load(), verify=True),
    "runs": lambda s, d: periodic.scan(d),
    **{name: lambda s, d, f=stage: f(s, d, FOLDER) for name, stage in corpus_pipeline.STAGES},
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_stay(spark, docs, name):
    plain, out = OPERATORS[name](spark, docs), OPERATORS[name](spark, wide(docs))
    assert set(out.columns) == {*plain.columns, *NAMES}
    assert rows(out, plain.columns) == rows(plain, plain.columns)
    assert out.where(" OR ".join(f"`{n}` <> concat('{n}', coalesce(cast(doc_id AS string), '-')) OR `{n}` IS NULL" for n in NAMES)).isEmpty()


def test_arguments_at_the_nesting_limit(spark):
    """Deep arguments are either read and written whole or invalid; no depth ends the job."""
    deep = [k for k in (10, 300, *range(900, 1000, 33), *range(9_980, 10_000), 50_000)]
    calls = spark.createDataFrame([("c", f"i{k}", k, "search", "[" * k + "]" * k, []) for k in deep], "conversation string, id string, turn int, name string, arguments string, uses array<string>")
    results = spark.createDataFrame([], "conversation string, id string, turn int, content string")
    out = toolcalls.link(calls, results, toolcalls.SCHEMAS).first()
    assert out["n_calls"] == len(deep) == out["n_invalid"] and out["json"].startswith('{"calls":[{"arguments":')
    assert toolcalls.parsed("[" * 50_000 + "]" * 50_000)[0] is False and json.loads(toolcalls.canonical(toolcalls.parsed("[[1]]")[1])) == [[1]]
