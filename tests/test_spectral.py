"""Spectral groups of planted blocks, vectors against a dense solver."""

import random

import numpy as np
from pyspark.ml.clustering import PowerIterationClustering
from pyspark.sql import functions as F

from cloudloom.operators import spectral


def table(spark, weights):
    n = len(weights)
    return spark.createDataFrame([(i, j, float(weights[i, j])) for i in range(n) for j in range(i + 1, n) if weights[i, j] > 0], "a long, b long, weight double")


def test_vectors_equal_dense_solver(spark):
    draw = np.random.default_rng(2)
    at = np.concatenate([draw.normal(c, 0.6, (12, 2)) for c in ((0, 0), (4, 0), (0, 5))])
    weights = np.exp(-np.square(at[:, None] - at[None]).sum(-1) / 4)
    np.fill_diagonal(weights, 0)
    degree = weights.sum(1)
    values, vectors = np.linalg.eigh(weights / np.sqrt(degree[:, None] * degree[None]))
    want = vectors[:, ::-1][:, :3] / np.sqrt(degree)[:, None]
    got = np.array([list(r)[1:] for r in spectral.embedded(table(spark, weights), 3).orderBy("node").collect()])
    for j in range(3):
        sign = np.sign(got[:, j] @ want[:, j])
        assert np.allclose(got[:, j] * sign, want[:, j], atol=1e-3)


def test_blocks_that_one_vector_merges(spark):
    """Blocks of one size, weakly linked: all are told apart. All degrees are equal, so the one vector of power iteration says nothing."""
    names = [block for block in range(4) for _ in range(8)]
    random.Random(3).shuffle(names)
    n = len(names)
    weights = np.zeros((n, n))
    for i in range(n):
        for j in range(i + 1, n):
            weights[i, j] = 1.0 if names[i] == names[j] else 0.02
    links = table(spark, weights)
    label = {r["node"]: r["label"] for r in spectral.groups(links, 4).collect()}
    told = lambda found: len({(names[i], found[i]) for i in range(n)}) == 4 == len(set(found.values()))
    assert told(label)
    plain = PowerIterationClustering(k=4, maxIter=20, initMode="degree", weightCol="weight").assignClusters(links.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"))
    assert not told({r["id"]: r["cluster"] for r in plain.collect()})


def test_few_nodes(spark):
    links = spark.createDataFrame([(4, 9, 1.0)], "a long, b long, weight double")
    assert len({r["label"] for r in spectral.groups(links, 4).collect()}) == 2
    assert spectral.groups(links.limit(0), 4).count() == 0
