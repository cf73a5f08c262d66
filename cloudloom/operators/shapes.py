"""Shapes of pixels: polygons filled by scan lines, and regions thinned to their skeletons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.sources.shared import Workspace, saved

#: The neighbours of a pixel in turn, from above clockwise, as (row, col) offsets.
_TURN = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def ring_edges(vertices: DataFrame) -> DataFrame:
    """(shape, ring, x, y, x2, y2): the edges of closed rings given by vertices (shape, ring, seq, x, y), the last leading back to the first."""
    ring = Window.partitionBy("shape", "ring")
    line = ring.orderBy("seq")
    nexts = {c: F.coalesce(F.lead(c).over(line), F.first(c).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias(f"{c}2") for c in "xy"}
    return vertices.select("shape", "ring", "x", "y", *nexts.values())


def filled(vertices: DataFrame) -> DataFrame:
    """(shape, row, col): the pixels (whole numbers; x is col, y is row) inside ring 0 or on its border and neither inside a further ring, a hole, nor on its border.

    Each edge meets the rows it crosses; the crossings of a row, sorted, begin and end spans by turns (even-odd). What lies on an edge counts as inside."""
    edges = ring_edges(vertices)
    low, high = F.least("y", "y2"), F.greatest("y", "y2")
    # A row crosses an edge from its lower end on, the upper end left out, so a vertex on a row counts once.
    first, last = F.ceil(low), F.ceil(high) - 1
    crossed = edges.where("y <> y2").withColumn("rows", F.when(first <= last, F.sequence(first, last))).select("shape", "ring", "x", "y", "x2", "y2", F.explode("rows").alias("row"))
    at = crossed.select("shape", "ring", "row", (F.col("x") + (F.col("row") - F.col("y")) * (F.col("x2") - F.col("x")) / (F.col("y2") - F.col("y"))).alias("at"))
    line = Window.partitionBy("shape", "ring", "row").orderBy("at")  # the crossings of one row with one ring
    spans = at.select("shape", "ring", "row", "at", F.row_number().over(line).alias("n"), F.lead("at").over(line).alias("to")).where("n % 2 = 1 AND to IS NOT NULL").select("shape", "ring", "row", "at", "to")
    # Rows through level edges, and through ends of edges, which the half-open rule may leave out.
    level = edges.where("y = y2 AND y = floor(y)").select("shape", "ring", F.floor("y").alias("row"), F.least("x", "x2").alias("at"), F.greatest("x", "x2").alias("to"))
    ends = edges.where("y = floor(y)").select("shape", "ring", F.floor("y").alias("row"), F.col("x").alias("at"), F.col("x").alias("to"))
    begin, end = F.ceil(F.round("at", 9)), F.floor(F.round("to", 9))
    every = spans.unionByName(level).unionByName(ends).where(begin <= end)
    cells = every.select("shape", "ring", "row", F.explode(F.sequence(begin, end)).alias("col"))
    marked = cells.groupBy("shape", "row", "col").agg(F.min("ring").alias("inner"), F.max("ring").alias("outer"))
    return marked.where("inner = 0 AND outer = 0").select("shape", "row", "col")


def _removable() -> tuple[np.ndarray, np.ndarray]:
    """For each code of lit neighbours (bit k for the k-th of _TURN) whether the pixel goes in the first and in the second half of a thinning round: it has two to six lit
    neighbours in one stretch, and an open side, to the right or below in the first half, to the left or above in the second."""
    codes = np.arange(256)
    p = codes[:, None] >> np.arange(8) & 1
    starts = ((p == 0) & (np.roll(p, -1, axis=1) == 1)).sum(axis=1)
    edge = (p.sum(axis=1) >= 2) & (p.sum(axis=1) <= 6) & (starts == 1)
    up, right, down, left = p[:, 0], p[:, 2], p[:, 4], p[:, 6]
    return edge & (up * right * down == 0) & (right * down * left == 0), edge & (up * right * left == 0) & (up * down * left == 0)


def thin(lit: np.ndarray, halves: int) -> np.ndarray:
    """A picture after so many halves of thinning rounds; nothing is lit around it."""
    tables = _removable()
    lit = np.pad(lit, 1)
    (h, w), before = lit.shape, True
    for k in range(halves):
        code = np.zeros((h - 2, w - 2), np.uint8)
        for bit, (dr, dc) in enumerate(_TURN):
            code |= lit[1 + dr : h - 1 + dr, 1 + dc : w - 1 + dc].astype(np.uint8) << bit
        gone = lit[1:-1, 1:-1] & tables[k % 2][code]
        if k % 2 and not gone.any() and not before:
            break
        before = gone.any()
        lit[1:-1, 1:-1] &= ~gone
    return lit[1:-1, 1:-1]


def thinned(pixels: DataFrame, tile: int = 256, rounds: int = 16) -> DataFrame:
    """The pixels (segment_id, row, col) that are left when regions are thinned, in two alternating halves, until nothing changes.

    A tile with as many pixels around it as halves are done shows its own pixels as the whole image would, so many rounds are one pass over tiles."""
    halo = 2 * rounds
    near = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(pdf["tr"].iloc[0]) * tile, int(pdf["tc"].iloc[0]) * tile
        picture = np.zeros((tile + 2 * halo,) * 2, bool)
        picture[pdf["row"] - top + halo, pdf["col"] - left + halo] = True
        own = thin(picture, halo)[halo:-halo, halo:-halo]
        rows, cols = np.nonzero(own)
        return pd.DataFrame({"segment_id": pdf["segment_id"].iloc[0], "row": rows + top, "col": cols + left})

    with Workspace(pixels.sparkSession) as work:
        left = work.keep(pixels.select("segment_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct())
        count = left.count()
        while count:
            spread = left.select("*", F.explode(near("row")).alias("tr")).select("*", F.explode(near("col")).alias("tc"))
            left = work.keep(spread.groupBy("segment_id", "tr", "tc").applyInPandas(run, left.schema))
            now = left.count()
            if now == count:
                break
            count = now
        return saved(left)
