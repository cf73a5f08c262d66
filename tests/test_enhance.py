"""Tile equalisation, thinning and filling against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import enhance, shapes


def mirrored(p, n):
    while not 0 <= p < n:
        p = -p if p < 0 else 2 * (n - 1) - p
    return p if n > 1 else 0


def plain(image, clip, tiles):
    h, w = image.shape
    th, tw = (h // tiles, w // tiles) if h % tiles == 0 and w % tiles == 0 else ((h + tiles - h % tiles) // tiles, (w + tiles - w % tiles) // tiles)
    maps = {}
    for ty in range(tiles):
        for tx in range(tiles):
            counts = [0] * 256
            for r in range(ty * th, ty * th + th):
                for c in range(tx * tw, tx * tw + tw):
                    counts[image[mirrored(r, h) if h > 1 else 0, mirrored(c, w) if w > 1 else 0]] += 1
            most = max(int(clip * th * tw / 256), 1)
            over = sum(max(0, n - most) for n in counts)
            counts = [min(n, most) + over // 256 for n in counts]
            rest = over % 256
            if rest:
                step = max(256 // rest, 1)
                for k in range(0, 256, step):
                    if rest:
                        counts[k] += 1
                        rest -= 1
            total, level = 0, []
            for n in counts:
                total += n
                level.append(min(255, round(total * (255.0 / (th * tw)))))
            maps[ty, tx] = level
    out = np.zeros_like(image)
    for r in range(h):
        for c in range(w):
            y, x = r / th - 0.5, c / tw - 0.5
            y0, x0 = math.floor(y), math.floor(x)
            at = lambda a, b: maps[min(max(a, 0), tiles - 1), min(max(b, 0), tiles - 1)][image[r, c]]
            v = (at(y0, x0) * (1 - (x - x0)) + at(y0, x0 + 1) * (x - x0)) * (1 - (y - y0)) + (at(y0 + 1, x0) * (1 - (x - x0)) + at(y0 + 1, x0 + 1) * (x - x0)) * (y - y0)
            out[r, c] = round(round(v, 6))
    return out


def test_equalised_equals_plain(spark):
    draw = np.random.default_rng(5)
    images = [draw.integers(0, 256, (16, 24)), draw.integers(90, 140, (13, 30)), np.full((9, 8), 77), draw.integers(0, 4, (1, 5)), (np.add.outer(np.arange(40), np.arange(33)) * 3) % 256]
    rows = [(s, r, c, int(v)) for s, image in enumerate(images) for (r, c), v in np.ndenumerate(image)]
    table = spark.createDataFrame(rows, "segment_id int, row long, col long, v int")
    for clip, tiles in ((1.2, 8), (4.0, 3)):
        got = [np.zeros_like(i) for i in images]
        for s, r, c, v in enhance.equalised(table, clip, tiles).select("segment_id", "row", "col", "v").collect():
            got[s][r, c] = v
        for a, b in zip(got, images, strict=True):
            assert (a == plain(b, clip, tiles)).all()


def test_lab_levels(spark):
    """Known colours, and the way back within rounding."""
    rows = [(0, i, 0, *c) for i, c in enumerate([(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (119, 119, 119)])]
    light, a, b = enhance.to_lab(F.col("r"), F.col("g"), F.col("b"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "segment_id int, row long, col long, r int, g int, b int").orderBy("row").select(light, a, b).collect()]
    assert got == [(0, 128, 128), (255, 128, 128), (136, 208, 195), (224, 42, 211), (82, 207, 20), (128, 128, 128)]
    many = spark.range(4000).select(*[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(256))).cast("int").alias(c) for k, c in enumerate("rgb")])
    for lab, most in ((enhance.exact_lab, 0), (enhance.to_lab, 1.5)):  # exact without levels; with levels dark colours are off by more
        found = many.select("*", *[x.alias(f"l{i}") for i, x in enumerate(lab(F.col("r"), F.col("g"), F.col("b")))])
        back = found.select("r", "g", "b", *[x.alias(f"o{i}") for i, x in enumerate(enhance.from_lab(F.col("l0"), F.col("l1"), F.col("l2")))])
        assert max(back.agg(*[F.avg(F.abs(F.col(c) - F.col(f"o{i}"))) for i, c in enumerate("rgb")]).first()) <= most


def test_contrast_grows(spark):
    rows = [(0, r, c, *[110 + (r + c) % 20] * 3) for r in range(32) for c in range(32)]
    out = enhance.clahe_gamma(spark.createDataFrame(rows, "segment_id int, row int, col int, r int, g int, b int"))
    low, high, gray = out.agg(F.min("g"), F.max("g"), F.max(F.greatest(*"rgb") - F.least(*"rgb"))).first()
    assert high - low > 60 and gray <= 2 and out.count() == 1024


def thinned(lit):
    """Thinning by a loop over pixels."""
    lit = {p: True for p in lit}
    turn = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        changed = False
        for half in (0, 1):
            gone = []
            for r, c in lit:
                p = [(r + a, c + b) in lit for a, b in turn]
                if not 2 <= sum(p) <= 6 or sum(not p[k] and p[(k + 1) % 8] for k in range(8)) != 1:
                    continue
                n, e, s, w = p[0], p[2], p[4], p[6]
                if (not (n and e and s) and not (e and s and w)) if half == 0 else (not (n and e and w) and not (n and s and w)):
                    gone.append((r, c))
            for p in gone:
                del lit[p]
            changed |= bool(gone)
        if not changed:
            return set(lit)


@pytest.mark.parametrize(("tile", "rounds"), [(256, 16), (7, 1), (16, 3)])
def test_thinned_equals_plain(spark, tile, rounds):
    draw = random.Random(tile)
    bar = {(r, c) for r in range(-3, 4) for c in range(40)}
    ring = {(r, c) for r in range(40) for c in range(40) if 80 < (r - 20) ** 2 + (c - 20) ** 2 < 330}
    cross = {(r, c) for r in range(30) for c in range(30) if abs(r - c) < 4 or abs(r + c - 29) < 5}
    noise = {(draw.randrange(25), draw.randrange(25)) for _ in range(420)}
    figures = [bar, ring, cross, noise, {(5, 5)}]
    table = spark.createDataFrame([(s, r, c) for s, f in enumerate(figures) for r, c in f], "segment_id int, row long, col long")
    got = {}
    for s, r, c in shapes.thinned(table, tile, rounds).collect():
        got.setdefault(s, set()).add((r, c))
    assert got == {s: thinned(f) for s, f in enumerate(figures)}
    assert shapes.thinned(table.limit(0), tile, rounds).count() == 0


def inside(ring, x, y):
    """Inside a ring or on its border."""
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return True
        if (y1 <= y) != (y2 <= y) and (x1 + (y - y1) * (x2 - x1) / (y2 - y1)) < x:
            odd = not odd
    return odd


def test_filled_equals_plain(spark):
    draw = random.Random(11)
    figures = [[[(0.0, 0.0), (10.0, 0.0), (10.0, 8.0), (0.0, 8.0)], [(3.0, 2.0), (6.0, 2.0), (6.0, 5.0), (3.0, 5.0)]], [[(2.5, 1.5), (9.25, 4.0), (4.0, 9.5)]], [[(0.0, 4.0), (4.0, 0.0), (8.0, 4.0), (4.0, 8.0)], [(4.0, 2.0), (6.0, 4.0), (4.0, 6.0), (2.0, 4.0)], [(7.0, 4.0), (7.25, 4.25), (7.0, 4.5)]]]
    for _ in range(6):
        figures.append([[(draw.randrange(60) / 4, draw.randrange(60) / 4) for _ in range(draw.randrange(3, 9))]])
    rows = [(s, k, i, *p) for s, f in enumerate(figures) for k, ring in enumerate(f) for i, p in enumerate(ring)]
    got = {}
    for s, r, c in shapes.filled(spark.createDataFrame(rows, "shape int, ring int, seq int, x double, y double")).collect():
        got.setdefault(s, set()).add((r, c))
    for s, f in enumerate(figures):
        want = {(y, x) for y in range(-1, 17) for x in range(-1, 17) if inside(f[0], x, y) and not any(inside(h, x, y) for h in f[1:])}
        assert got.get(s, set()) == want, s
