"""Spectral grouping over a table of weighted links: leading vectors of the normalised adjacency by orthogonal iteration, then k-means on them.

A multiplication is a join of links and vectors and a sum for each node; only the k x k products of the vectors come to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.sources.shared import Workspace, saved


def embedded(links: DataFrame, k: int, most_rounds: int = 40, steps: int = 4, tolerance: float = 1e-8) -> DataFrame:
    """(node, u0, u1, ...): the k leading vectors of D^-1/2 W D^-1/2 over the ends of links (a, b, weight over 0, each pair once), each divided by the root of the node's degree.

    Starts from hashes of the nodes, so equal input gives equal vectors; a round is steps multiplications (each added to twice the vectors, so that no eigenvalue is 0 or less) and one
    orthogonalisation, until no vector's growth changes by tolerance or more."""
    with Workspace(links.sparkSession) as work:
        both = work.keep(links.select("a", "b", "weight").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
        roots = work.keep(both.groupBy(F.col("a").alias("node")).agg(F.sqrt(F.sum("weight")).alias("root")))
        k = min(k, roots.count())
        if not k:
            return saved(roots.select("node"))
        ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"]
        step = work.keep(both.join(ends[0], "a").join(ends[1], "b").select("a", F.col("b").alias("node"), (F.col("weight") / F.col("ra") / F.col("rb")).alias("w")))
        names = [f"v{j}" for j in range(k)]
        # The first vector is known: the roots themselves.
        vectors = work.keep(roots.select("node", F.col("root").alias("v0"), *[(F.pmod(F.xxhash64("node", F.lit(j)), F.lit(1 << 20)) / (1 << 20) - 0.5).alias(f"v{j}") for j in range(1, k)]))
        grown = np.zeros(k)
        for _ in range(most_rounds):
            for _ in range(steps):
                sums = step.join(vectors, "node").groupBy(F.col("a").alias("node")).agg(*[F.sum(F.col("w") * F.col(v)).alias(f"s{v}") for v in names])
                vectors = vectors.join(sums, "node").select("node", *[((2 * F.col(v) + F.col(f"s{v}")) / 3).alias(v) for v in names])
            vectors = work.keep(vectors)
            products = vectors.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
            gram = np.array([[products[f"p{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)])
            lower = np.linalg.cholesky(gram + np.eye(k) * 1e-14 * np.trace(gram))
            turn = np.linalg.inv(lower).T  # vectors @ turn are orthonormal
            vectors = vectors.select("node", *[sum((F.col(names[i]) * float(turn[i, j]) for i in range(j + 1)), F.lit(0.0)).alias(names[j]) for j in range(k)])
            now = np.diag(lower)
            if np.abs(now - grown).max() < tolerance:
                break
            grown = now
        out = work.keep(vectors).join(roots, "node")
        return saved(out.select("node", *[(F.col(v) / F.col("root")).alias(f"u{j}") for j, v in enumerate(names)]))


def groups(links: DataFrame, k: int) -> DataFrame:
    """(node, label): the ends of links in k groups, or as many as there are nodes."""
    from cloudloom.operators.clusters import kmeans

    found = embedded(links, k)
    names = tuple(c for c in found.columns if c != "node")
    if not names:
        return found.withColumn("label", F.lit(0))
    return kmeans(found.withColumnRenamed("node", "point_id"), len(names), names).select(F.col("point_id").alias("node"), "label")
