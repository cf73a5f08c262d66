"""Periodic runs against a plain search of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from cloudloom.llm import periodic, registry
from cloudloom.llm.common import read


def plain(words, least):
    """All runs: for each period the stretches in which words that far apart are equal, each with its smallest period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in found.items())


@pytest.mark.parametrize("least", [2, 3, 5, 7, 12])
def test_runs_equal_plain_search(least):
    draw = random.Random(least)
    for _ in range(1200):
        n, letters = draw.randrange(70), draw.choice([1, 2, 3, 6])
        words = [draw.randrange(1, letters + 1) for _ in range(n)]
        if n and draw.random() < 0.6:  # a periodic end, and perhaps one change in it
            a, p = draw.randrange(n), 1 + draw.randrange(1 + n // 3)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            if draw.random() < 0.5:
                words[draw.randrange(n)] = 9
        assert periodic.runs_of(np.array(words, np.int64), least) == plain(words, least)


def test_long_texts():
    for n, start, period in ((30_000, 17, 9_000), (30_000, 0, 1), (30_000, 5, 2)):
        words = np.random.default_rng(n).permutation(n) + 1
        words[start:] = words[start + np.arange(n - start) % period]
        assert periodic.runs_of(words) == [(start, n - start, period)]


def test_odd_rows_and_clashing_columns(spark):
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("runs", T.LongType()), T.StructField("word", T.StringType())])
    loop = "a b " * 7
    rows = [(None, "x", 1, "w"), ("", "x", 2, None), (" \t\n", None, 3, "w"), (loop, None, 4, "w"), (loop, None, 4, "w"), ("één " * 12, "y", 5, "w"), ("a b " * 11, "z", 6, "w")]
    got = periodic.scan(spark.createDataFrame(rows, schema))
    assert got.columns == ["text", "doc_id", "word", "runs", "collapsed"]
    out = [([tuple(x) for x in r["runs"]], r["collapsed"], r["word"]) for r in got.collect()]
    assert out == [([], "", "w"), ([], "", None), ([], "", "w"), ([(0, 14, 2)], "a b", "w"), ([(0, 14, 2)], "a b", "w"), ([(0, 12, 1)], "één", "w"), ([], " ".join(["a b"] * 11), "w")]
    assert periodic.scan(spark.createDataFrame([], schema)).count() == 0


def test_query_equals_plain_search(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in read(spark, folder, "documents").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in registry.op13_periodic_runs(spark, folder).collect()}
    assert len(got) == len(docs)
    planted = 0
    for id_, text in docs.items():
        words = (text or "").encode().split()
        h = zlib.crc32(str(id_).encode())
        if words and h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        if len(words) > 3000 and h % 10:
            continue  # too long for a plain search
        runs = plain(words, 12)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        first = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        assert got[id_] == (len(runs), *first, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
    assert planted > 5
