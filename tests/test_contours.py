"""Outlines against a plain walk, their fill against the mask, tiles against no tiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import contours, layout


def masks():
    rng = random.Random(2)
    out = [[[0]], [[1]], [[1, 0], [0, 1]], [[0, 1], [1, 0]], [[1, 1, 1], [1, 0, 1], [1, 1, 1]], [[1] * 20] * 20]
    out += [[[int(rng.random() < p) for _ in range(w)] for _ in range(h)] for p in (0.2, 0.5, 0.7, 0.9) for h, w in ((5, 9), (13, 11), (30, 17))]
    ring = np.ones((25, 25), int)
    ring[3:22, 3:22] = 0
    ring[6:19, 6:19] = 1
    ring[12, 12] = 0
    return [*out, ring.tolist()]


def cells(spark, own=None):
    rows = [(i, y, x, v) for i, m in enumerate(own or masks()) for y, line in enumerate(m) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, open int")


def plain(m):
    """Loops by walking the sides of open cells one by one."""
    h, w = len(m), len(m[0])
    at = lambda y, x: 0 <= y < h and 0 <= x < w and m[y][x] == 1
    move, begin = [(0, 1), (1, 0), (0, -1), (-1, 0)], [(0, 0), (0, 1), (1, 1), (1, 0)]
    sides = {(y, x, s) for y in range(h) for x in range(w) for s in range(4) if at(y, x) and not at(y - move[(s + 1) % 4][0], x - move[(s + 1) % 4][1])}
    out = []
    while sides:
        first = min(sides, key=lambda e: (e[0] + begin[e[2]][0], e[1] + begin[e[2]][1], e[2]))
        e, points, length, before = first, [], 0, None
        while e in sides:
            sides.remove(e)
            y, x, s = e
            if s != before:
                points.append((x + begin[s][1], y + begin[s][0]))
            before, length = s, length + 1
            ay, ax = y + move[s][0], x + move[s][1]
            by, bx = ay - move[(s + 1) % 4][0], ax - move[(s + 1) % 4][1]
            e = (y, x, (s + 1) % 4) if not at(ay, ax) else (ay, ax, s) if not at(by, bx) else (by, bx, (s + 3) % 4)
        assert e == first
        area = sum(a * d - c * b for (a, b), (c, d) in zip(points, points[1:] + points[:1])) // 2
        out.append((area < 0, area, length, tuple(points)))
    return sorted(out)


@pytest.mark.parametrize("tile", [512, 7])
def test_loops(spark, tile):
    found = contours.contours(cells(spark), tile=tile).collect()
    for i, m in enumerate(masks()):
        own = [(r.hole, r.area, r.length, tuple(zip(map(int, r.xs), map(int, r.ys)))) for r in found if r.image_id == i]
        assert sorted(own) == plain(m), i
        assert sum(r[1] for r in own) == sum(map(sum, m))
    assert len({(r.image_id, r.loop) for r in found}) == len(found)


@pytest.mark.parametrize("tile", [512, 6])
def test_fill_gives_the_mask_back(spark, tile):
    back = contours.filled_cells(contours.contours(cells(spark), tile=tile)).collect()
    assert len(back) == len(set(back)) and {tuple(r) for r in back} == {(i, y, x) for i, m in enumerate(masks()) for y, line in enumerate(m) for x, v in enumerate(line) if v}


def test_simplified(spark):
    """A staircase becomes a line; what stays is near what went; short loops go."""
    stairs = [[int(x <= y) for x in range(30)] for y in range(30)]
    mask = cells(spark, [stairs, [[1]], [[1] * 8] * 8])
    found = {r.image_id: r for r in contours.simplify(contours.contours(mask), 1.0, 5).collect()}
    assert {*found} == {0, 2} and len(found[2].xs) == 4
    assert len(found[0].xs) <= 5 and found[0].area == 465
    loops = contours.contours(cells(spark)).cache()
    for tolerance in (0.4, 1.4):
        for r, exact in zip(*(contours.simplify(loops, t, 0).orderBy("image_id", "loop").collect() for t in (tolerance, 0))):
            kept = np.array([*zip(r.xs, r.ys)])
            ends = np.roll(kept, -1, axis=0)
            for p in zip(exact.xs, exact.ys):
                line = ends - kept
                t = np.clip(((p - kept) * line).sum(1) / np.maximum((line**2).sum(1), 1e-9), 0, 1)
                assert np.hypot(*(kept + t[:, None] * line - p).T).min() <= tolerance + 1e-9
            assert len(kept) >= 3


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 0, 1), (1, None, 2, 1), (1, 3, 3, None), (None, 0, 0, 1), (2, 0, 0, 0)], "image_id long, y int, x int, open int").withColumn("a", F.lit("clash")).withColumn("TX", F.lit("clash"))
    assert sorted((str(r.image_id), r.area, r.length) for r in contours.contours(df).collect()) == [("1", 1, 4), ("None", 1, 4)]
    assert contours.contours(df.limit(0)).collect() == []


def test_paths_hold_holes(spark):
    loops = contours.contours(cells(spark, [[[1, 1, 1], [1, 0, 1], [1, 1, 1]]]).withColumn("layer", F.lit(0)))
    paths = contours.contour_paths(loops)
    assert paths.first().d == "M 0 0 L 3 0 L 3 3 L 0 3 Z M 1 1 L 1 2 L 2 2 L 2 1 Z"
    sheet = spark.createDataFrame([(0, 0, 3, 3, 30.0, 30.0, "#000000")], "image_id long, layer int, width int, height int, width_mm double, height_mm double, fill string")
    svg = layout.layer_svg(paths, sheet).first().svg
    assert svg.count("<path") == 1 and 'fill-rule="evenodd"' in svg
