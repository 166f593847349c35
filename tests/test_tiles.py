"""Components and islands of rasters of many tiles are those of the whole."""

import numpy as np
import pytest

from pixelweave.functions.lineage import cycle_lows, joined_lows
from pixelweave.operators import components


def frame(spark, masks, layer=None):
    rows = [(i, y, x, int(v)) for i, m in masks.items() for (y, x), v in np.ndenumerate(m)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, open int").repartition(5)


def masks():
    rng = np.random.default_rng(8)
    out = {i: (rng.random((int(rng.integers(1, 40)), int(rng.integers(1, 40)))) < p).astype(int) for i, p in enumerate((0.3, 0.5, 0.6, 0.75, 0.9, 0.6))}
    snake = np.zeros((33, 33), int)  # one component through every tile and back
    snake[::2] = 1
    snake[1::4, -1] = snake[3::4, 0] = 1
    out |= {10: snake, 11: 1 - snake, 12: np.ones((20, 9), int), 13: np.zeros((9, 20), int)}
    return out


@pytest.mark.parametrize(("tile", "value"), [(5, 0), (7, 1)])
def test_labels(spark, tile, value):
    own = masks()
    found = {i: np.full(m.shape, -1) for i, m in own.items()}
    for r in components.components_by_tile(frame(spark, own), value, tile).collect():
        found[r.image_id][r.y, r.x] = r.label
    for i, m in own.items():
        assert (found[i] == components.labelled(m, value)).all(), i
    counted = {r.image_id: r.components for r in components.count_by_tile(frame(spark, own), value, tile).collect()}
    assert counted == {i: int(components.labelled(m, value).max()) for i, m in own.items()}


def test_islands(spark, tile=6):
    df = frame(spark, masks())
    columns = ["image_id", "label", "size", "sum_x", "sum_y", "cx", "cy"]
    a, b = (sorted(map(tuple, x.select(columns).collect())) for x in (components.islands_by_tile(df, tile), components.islands(df)))
    assert a == b and len(a) > 20


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 0, 0), (1, 0, 9, 1), (1, None, 1, 1), (1, 3, 3, None), (None, 0, 0, 1)], "image_id long, y int, x int, open int")
    assert components.count_by_tile(df, 1, 4).collect()[0].components == 2
    assert components.components_by_tile(df.limit(0)).collect() == [] and components.islands_by_tile(df.limit(0)).collect() == []


def test_joined_and_cycles(spark):
    """Long paths, stars and rings, by plain walks."""
    rng = np.random.default_rng(2)
    order = rng.permutation(200).tolist()
    edges = [("p", a, b) for a, b in zip(order, order[1:])] + [("s", 7, i) for i in range(8, 60)] + [("q", 1, 2), ("q", 4, 3), ("q", 2, 3), ("q", 9, 9)]
    found = {(r.g, r.node): r.low for r in joined_lows(spark.createDataFrame(edges, "g string, a long, b long"), ["g"]).collect()}
    assert found == {("p", i): 0 for i in range(200)} | {("s", i): 7 for i in range(7, 60)} | {("q", i): 1 for i in range(1, 5)}
    rings = [(g, own[i], own[(i + 1) % len(own)]) for g, own in (("a", order[:77]), ("a", order[77:]), ("b", [5]), ("b", [9, 4])) for i in range(len(own))]
    lows = {(r.g, r.a): r.low for r in cycle_lows(spark.createDataFrame(rings, "g string, a long, b long"), ["g"]).collect()}
    assert lows == {("a", i): min(o) for o in (order[:77], order[77:]) for i in o} | {("b", 5): 5, ("b", 9): 4, ("b", 4): 4}
