"""Consistent orientation of normals: signs carried along a minimum spanning tree of the neighbour graph.

Neighbouring tangent planes that are nearly parallel are joined first: a link weighs 1 - |cosine| of its normals. The tree grows by Borůvka's rounds: each part takes its
lightest link to another part, parts joined so become one, and each point keeps its sign against its part's root, which is the product of the signs along the tree. A
round is a few joins over links between parts; there are log2 of the points' number at most, and the links that are left fall with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.functions.geometry import inverted
from cloudloom.operators.neighbors import nearest
from cloudloom.sources.shared import Workspace, saved

NORMAL = ("nx", "ny", "nz")


def tangent_links(cloud: DataFrame, k: int = 10) -> DataFrame:
    """(a, b, weight, sign) with a < b: each point with its k nearest, itself counted; weight is 1 - |cosine| of the two normals, sign -1 where the cosine is under 0, else 1."""
    pairs = nearest(cloud, cloud, k).where("qid <> pid").select(F.least("qid", "pid").alias("a"), F.greatest("qid", "pid").alias("b")).distinct()
    left = cloud.select(F.col("point_id").alias("a"), *[F.col(c).alias(f"a{c}") for c in NORMAL])
    right = cloud.select(F.col("point_id").alias("b"), *[F.col(c).alias(f"b{c}") for c in NORMAL])
    cosine = F.col("anx") * F.col("bnx") + F.col("any") * F.col("bny") + F.col("anz") * F.col("bnz")
    return pairs.join(left, "a").join(right, "b").select("a", "b", (1 - F.abs(cosine)).alias("weight"), F.when(cosine < 0, -1).otherwise(1).alias("sign"))


def _rooted(best: DataFrame, work: Workspace) -> DataFrame:
    """(part, root, sign) from each part's lightest link (part, key, to, sign): the ways to the roots, doubled until they end."""
    back = best.select(F.col("part").alias("to"), F.col("key").alias("back"))
    # Links have an order, so ways end only where two parts take the same link; the smaller of them is the root.
    is_root = (F.col("key") == F.col("back")) & (F.col("part") < F.col("to"))
    up = best.join(back, "to").select("part", F.when(is_root, F.col("part")).otherwise(F.col("to")).alias("root"), F.when(is_root, 1).otherwise(F.col("sign")).alias("sign"))
    while True:
        up = work.keep(up)
        above = up.select(F.col("part").alias("root"), F.col("root").alias("next"), F.col("sign").alias("further"))
        moved = up.join(above, "root").select("part", F.col("next").alias("root"), (F.col("sign") * F.col("further")).alias("sign"), (F.col("next") != F.col("root")).alias("moved"))
        moved = work.keep(moved)
        if moved.where("moved").isEmpty():
            return up
        up = moved.drop("moved")


def spanning_signs(links: DataFrame) -> DataFrame:
    """(node, root, sign) for the ends of links (a, b, weight, sign): its tree's root and the product of signs on the way there, over the tree of least weight; of equal weights the smaller (a, b) counts as lighter.

    Links between the same two nodes may repeat; a link of a node with itself says nothing. What isn't linked lies in different trees."""
    with Workspace(links.sparkSession) as work:
        left = work.keep(links.where("a <> b").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.struct("weight", "a", "b").alias("key"), "sign"))
        nodes = work.keep(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().select("node", F.col("node").alias("root"), F.lit(1).alias("sign")))
        while not left.isEmpty():
            both = left.select(F.col("pa").alias("part"), F.struct("key", F.col("pb").alias("to"), "sign").alias("link")).unionByName(left.select(F.col("pb").alias("part"), F.struct("key", F.col("pa").alias("to"), "sign").alias("link")))
            best = work.keep(both.groupBy("part").agg(F.min("link").alias("link")).select("part", "link.key", "link.to", "link.sign"))
            up = _rooted(best, work)
            turn = up.select(F.col("part").alias("root"), F.col("root").alias("top"), F.col("sign").alias("turn"))
            nodes = work.keep(nodes.join(turn, "root", "left").select("node", F.coalesce("top", "root").alias("root"), (F.col("sign") * F.coalesce("turn", F.lit(1))).alias("sign")))
            named = {end: up.select(F.col("part").alias(f"p{end}"), F.col("root").alias(f"r{end}"), F.col("sign").alias(f"s{end}")) for end in "ab"}
            joined = left.join(named["a"], "pa").join(named["b"], "pb").where("ra <> rb")
            apart = joined.select(F.least("ra", "rb").alias("pa"), F.greatest("ra", "rb").alias("pb"), F.struct("key", (F.col("sign") * F.col("sa") * F.col("sb")).alias("sign")).alias("link"))
            # Of the links between two parts only the lightest can be a tree's.
            left = work.keep(apart.groupBy("pa", "pb").agg(F.min("link").alias("link")).select("pa", "pb", "link.key", "link.sign"))
        return saved(nodes)


def oriented(cloud: DataFrame, k: int = 10) -> DataFrame:
    """cloud with flipped, and its normals turned round where that holds: so that they agree along the tree and that of each tree's highest point, of equal ones the smallest id, doesn't face down.

    A point without neighbours is a tree by itself. The k nearest graph may fall into several trees; each has its own highest point."""
    signs = spanning_signs(tangent_links(cloud, k))
    rows = cloud.select("point_id", "z", "nz").join(signs.withColumnRenamed("node", "point_id"), "point_id", "left").select("point_id", "z", "nz", F.coalesce("root", "point_id").alias("root"), F.coalesce("sign", F.lit(1)).alias("sign"))
    with Workspace(cloud.sparkSession) as work:
        rows = work.keep(rows)
        top = rows.groupBy("root").agg(F.max(F.struct(F.col("z"), (-F.col("point_id")).alias("first"), "nz", "sign")).alias("top"))
        start = top.select("root", F.when(F.col("top.nz") < 0, -F.col("top.sign")).otherwise(F.col("top.sign")).alias("start"))
        flips = saved(rows.join(start, "root").select("point_id", (F.col("sign") != F.col("start")).alias("flipped")))
    return inverted(cloud.drop("flipped").join(flips, "point_id"), F.col("flipped"))
