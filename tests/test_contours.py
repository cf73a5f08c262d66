"""Contours against border following by hand, planted shapes."""

import random
from collections import deque

import pytest

from cloudloom.operators import contours
from cloudloom.sources.shared import Workspace


def image(spark, pictures):
    rows = [(s, r, c, 255 if x == "#" else 0) for s, p in enumerate(pictures) for r, line in enumerate(p) for c, x in enumerate(line)]
    return spark.createDataFrame(rows, "segment_id int, row long, col long, v int")


def flood(cells, steps):
    """Sets of connected cells."""
    left, out = set(cells), []
    while left:
        own, queue = set(), deque([left.pop()])
        while queue:
            r, c = queue.popleft()
            own.add((r, c))
            for dr, dc in steps:
                if (r + dr, c + dc) in left:
                    left.remove((r + dr, c + dc))
                    queue.append((r + dr, c + dc))
        out.append(own)
    return out


FOUR = [(0, 1), (1, 0), (0, -1), (-1, 0)]
EIGHT = [*FOUR, (1, 1), (1, -1), (-1, 1), (-1, -1)]


def areas(picture):
    """Areas by squares: of each region's filled shape, and of each hole with the pixels beside it."""
    h, w = len(picture), len(picture[0])
    lit = {(r, c) for r in range(h) for c in range(w) if picture[r][c] == "#"}
    every = {(r, c) for r in range(-1, h + 1) for c in range(-1, w + 1)}
    out = []
    for own in flood(lit, EIGHT):
        for hole in flood(every - own, FOUR):
            if (-1, -1) in hole:
                shape, needs = every - hole, own
                sign = 1
            else:
                # Of a hole the unlit pixels that touch the region; regions inside it have contours of their own.
                shape, needs = hole | {p for p in own if any((p[0] + a, p[1] + b) in hole for a, b in FOUR)}, hole
                sign = -1
            total = 0
            for r in range(-1, h):
                for c in range(-1, w):
                    square = [(r, c), (r, c + 1), (r + 1, c), (r + 1, c + 1)]
                    n = sum(p in shape for p in square)
                    if n >= 3 and any(p in needs or sign > 0 for p in square):
                        total += 1 if n == 4 else 0.5
            out.append(sign * total)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_areas_equal_squares(spark, seed):
    draw = random.Random(seed)
    pictures = [["".join("#" if draw.random() < d else "." for _ in range(draw.choice([1, 5, 12]) or 1)) for _ in range(1)] for d in (0.5,)]
    for d in (0.35, 0.5, 0.65, 0.8):
        w = draw.randrange(4, 14)
        pictures.append(["".join("#" if draw.random() < d else "." for _ in range(w)) for _ in range(draw.randrange(3, 12))])
    pictures.append(["#######", "#.....#", "#.###.#", "#.#.#.#", "#.###.#", "#.....#", "#######"])
    found = contours.contours(contours.regions(image(spark, pictures))).collect()
    for s, p in enumerate(pictures):
        assert sorted(r["area"] for r in found if r["segment_id"] == s) == areas(p), p


SQUARE_WITH_HOLE = [["#" * 40] * 14 + ["#" * 14 + "." * 12 + "#" * 14] * 12 + ["#" * 40] * 14][0]


def test_square_with_a_hole(spark):
    """A frame of 40 x 40 in an image of 50 x 50: the outer band is as wide as the erosions reach, the hole's border is drawn over."""
    picture = ["." * 50] * 5 + ["." * 5 + line + "." * 5 for line in SQUARE_WITH_HOLE] + ["." * 50] * 5
    gray = image(spark, [picture, ["."] * 3])
    found = contours.contours(contours.regions(gray)).collect()
    assert sorted((r["segment_id"], r["area"]) for r in found) == [(0, -(13 * 13 - 2.0)), (0, 39.0 * 39)]
    white = image(spark, [["#" * 50] * 50, ["#"] * 3])
    got = {(r["segment_id"], r["row"], r["col"]): r["v"] for r in contours.without_borders(gray, white, size=5, rounds=2, stroke=4).collect()}
    assert len(got) == 2503 and all(got[1, r, 0] == 255 for r in range(3))
    for r in range(50):
        for c in range(50):
            inside = 5 <= r < 45 and 5 <= c < 45
            band = inside and not (9 <= r < 41 and 9 <= c < 41)
            ring = [(y, x) for y in range(18, 32) for x in range(18, 32) if (y in (18, 31)) != (x in (18, 31))]
            stroke = any((r - y) ** 2 + (c - x) ** 2 <= 4 for y, x in ring)
            assert got[0, r, c] == (0 if band or stroke else 255), (r, c)


def test_what_lies_inside(spark):
    picture = [".........", ".#######.", ".#.....#.", ".#.###.#.", ".#.#.#.#.", ".#.###.#.", ".#.....#.", ".#######.", "........."]
    apart = [line + "##." for line in picture]
    gray = image(spark, [apart])
    with Workspace(spark) as work:
        pixels = contours.regions(gray)
        found = contours.contours(pixels)
        top = contours.largest(found).first()
        assert top["area"] == 36.0
        got = {(r["row"], r["col"]) for r in contours.filled(gray, pixels, found, work).where("v > 0").collect()}
    assert got == {(r, c) for r in range(1, 8) for c in range(1, 8)}
