"""Packed rasters: kernels on stacks give what the operators on pixels give, and the queries move no pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import bridges, contours, grids, morphology, palettes, posterize, resample, statistics, tone
from pixelweave.operators.components import despeckled, island_labels, labelled, own_numbers
from pixelweave.plans.queries import QUERIES
from pixelweave.sources import rasters

SF = "/root/testdata/sf0.001"
SHAPES = ((1, 1), (1, 7), (9, 2), (12, 12), (12, 12), (5, 12), (12, 12), (3, 3))


def frame(spark, column="open", most=2):
    rng = np.random.default_rng(5)
    rows = [(i, y, x, int(v)) for i, s in enumerate(SHAPES) for (y, x), v in np.ndenumerate(rng.integers(0, most, s))]
    return spark.createDataFrame(rows, f"image_id long, y int, x int, {column} int").repartition(3)


def cells(df, *columns):
    return sorted(tuple(r) for r in df.select("image_id", "y", "x", *columns).collect())


@pytest.mark.parametrize("name", ["erode_r1", "morph_open", "morph_close", "sobel_edges", "line_art", "gray_intake", "resize_area", "auto_bridges", "prepare_islands", "build_masks", "compute_layers", "mask_contours", "cut_files", "preset_for_image"])
def test_no_pixel_moves(spark, name):
    assert "Exchange" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_packed_and_back(spark):
    df = frame(spark, "lum", 256)
    assert cells(grids.pixels(grids.packed(df, "lum"), "lum"), "lum") == cells(df, "lum")


def test_sources(spark):
    for made, plain, columns in ((rasters.ring_grids, rasters.ring_rasters, ["lum"]), (rasters.ring_color_grids, rasters.ring_colors, ["r", "g", "b", "a"])):
        assert cells(grids.pixels(made(spark, SF), *columns), *columns) == cells(plain(spark, SF), *columns)
    assert cells(grids.pixels(rasters.ring_masks(spark, SF), "open"), "open") == cells(rasters.ring_rasters(spark, SF).withColumn("open", (F.col("lum") < 128).cast("int")), "open")


def test_ids_are_dealt_out_before_they_grow(spark, monkeypatch):
    monkeypatch.setattr(rasters, "CELLS", 10 * rasters.SIDE**2)
    assert rasters.ring_grids(spark, SF).rdd.getNumPartitions() == 20


@pytest.mark.parametrize("r", [0, 1, 2])
def test_morphology(spark, r):
    df = frame(spark).filter("image_id in (3, 4, 6)")  # of one size
    packed = grids.packed(df, "open")
    pixels = lambda m: cells(grids.pixels(m, "open"), "open")
    assert pixels(morphology.dilate(packed, r)) == cells(morphology.dilate(df, r), "open")
    for f in (morphology.erode, morphology.opened, morphology.closed):
        assert pixels(f(packed, 12, 12, r)) == cells(f(df, 12, 12, r), "open")


@pytest.mark.parametrize("thicken", [0, 1])
def test_edges(spark, thicken):
    df = frame(spark, "lum", 256)
    found = grids.pixels(tone.edges(grids.packed(df, "lum"), 60, thicken), "open")
    assert cells(found, "open") == cells(tone.edges(df, 60, thicken), "open")


def test_gray(spark):
    df = frame(spark, "r", 256).withColumns({"g": (F.col("r") * 7 + F.col("x")) % 256, "b": (F.col("r") * 3 + F.col("y")) % 256}).filter("image_id in (3, 4, 6)")
    found = tone.prepared_gray(grids.packed(df, "r", "g", "b"), 12, 12, 20, 6, True, 1, True, True, True)
    assert cells(grids.pixels(found, "lum"), "lum") == cells(tone.prepared_gray(df, 12, 12, 20, 6, True, 1, True, True, True), "lum")


def test_resize(spark):
    df = frame(spark, "r", 256)
    own = spark.createDataFrame([(i, *s) for i, s in enumerate(SHAPES)], "image_id long, height int, width int")
    w, h = F.col("image_id") * 5 % 7, 1 + F.col("image_id") % 3 * 6
    a, b = resample.resize_area(df.join(own, "image_id"), w, h, ("r",)), grids.pixels(resample.resize_area(grids.packed(df, "r"), w, h, ("r",)), "r", size=True)
    columns = ("width", "height", "r")
    assert a.columns == b.columns and cells(a, *columns) == cells(b, *columns) and a.count() > 100


def test_sampled_colors_move_no_pixels(spark):
    """A row for each raster meets its points, whatever the number of pixels."""
    points = spark.createDataFrame([(i, i * 1.7, 30.0 - i) for i in range(1, 30)], "image_id long, px double, py double")
    found = palettes.sample_color(points, rasters.ring_color_grids(spark, SF), 24, 24, mirror=True)
    plan = QUERIES["sample_colors"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    assert sorted(found.collect()) == sorted(palettes.sample_color(points, rasters.ring_colors(spark, SF), 24, 24, mirror=True).collect())


def test_stacks_of_builds():
    """Rasters of a stack, with values of their own, are built as each alone."""
    rng = np.random.default_rng(11)
    lum = np.kron(rng.integers(0, 256, (9, 6, 5)), np.ones((1, 9, 9), int)).astype(np.int32)
    n = len(lum)
    for value in (0, 1):
        mask = (lum < 128).astype(np.int32)
        assert (own_numbers(labelled(mask, value)) == [labelled(m, value) for m in mask]).all()
        assert (own_numbers(island_labels(mask)) == [island_labels(m) for m in mask]).all()
    least = rng.integers(0, 30, n)
    assert (despeckled(mask, least) == [despeckled(m, k) for m, k in zip(mask, least)]).all()
    t = posterize.cuts_of(lum, 3)
    fields = {"min_feature": rng.integers(0, 3, n).astype(float), "width": rng.integers(1, 5, n), "mm_per_px": rng.random(n) * 9, "spacing": 20.0 + np.arange(n), "bridge": rng.random(n) < 0.8, "keep_highlights": rng.random(n) < 0.5, "edge_amount": rng.integers(0, 100, n), "span": rng.integers(1, 5, n)}
    found = bridges.stack_built(lum, t, bridges.Build(**fields))
    ties = [layer[3].lists(n) for layer in found]
    for i in range(n):
        alone = bridges.built(lum[i], t[i].tolist(), bridges.Build(**{k: v[i].item() for k, v in fields.items()}))
        assert [(int(a[i]), e, m[i].tolist(), x[i]) for (a, e, m, _), x in zip(found, ties)] == [(a, e, m.tolist(), x) for a, e, m, x in alone]
    assert sum(len(x) for layer in ties for x in layer) > 20


def test_cuts_try_the_levels_that_occur():
    """The cuts of all 256 bins, ties and few levels included."""

    def plain(counts, k):
        best = {(0, -1): (0.0, ())}
        w, s = np.append(0, counts.cumsum()).astype(float), np.append(0, (counts * np.arange(256)).cumsum()).astype(float)
        for m in range(1, k + 2):
            for v in range(m - 1, 256):
                for u in [-1] if m == 1 else range(m - 2, v):
                    d = w[v + 1] - w[u + 1]
                    score = best[m - 1, u][0] + ((s[v + 1] - s[u + 1]) ** 2 / d if d else 0)
                    if (m, v) not in best or score > best[m, v][0]:
                        best[m, v] = (score, (*best[m - 1, u][1], u + 1))
        return [min(255, c) for c in best[k + 1, 255][1][1:]]

    rng = np.random.default_rng(3)
    for levels in (1, 2, 3, 4, 9):
        counts = np.zeros(256, int)
        counts[rng.choice(256, levels, replace=False)] = rng.integers(1, 5, levels)
        assert posterize.cuts(counts, 2).tolist() == plain(counts, 2), levels


@pytest.mark.parametrize(("name", "small"), [("sheet_tiles", 0), ("sheet_pdf", 0), ("zipped_files", 0), ("run_params", 2), ("run_summary", 0), ("run_cut_files", 0)])
def test_loops_are_not_broadcast(spark, name, small):
    """But the tables of presets and materials are."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMap" not in plan and plan.count("BroadcastExchange") == small


def test_outlines(spark):
    """Loops of packed masks, and their paths, simplified by columns."""
    df = frame(spark).withColumn("layer", F.lit(2))
    packed = grids.packed(df, "open")
    columns = ["image_id", "layer", "loop", "hole", "area", "length", "xs", "ys"]
    a, b = (sorted(map(tuple, contours.contours(m).select(columns).collect()), key=repr) for m in (df, packed))
    assert a == b and len(a) > 40 and contours.contours(df).schema == contours.contours(packed).schema
    own = packed.select("image_id", "layer", (F.col("image_id") * 0.4).alias("t"), F.when(F.col("image_id") > 3, 6.0).alias("o"))
    loops = contours.simplify(contours.contours(df).join(own, ["image_id", "layer"]), F.col("t"), F.col("o"))
    paths = {r.image_id: r.d for r in contours.contour_paths(loops).collect()}
    found = contours.drawn(packed.join(own, ["image_id", "layer"]), "open", "t", "o")
    assert {r.image_id: r.d for r in found.collect()} == {i: paths.get(i, "") for i in range(len(SHAPES))} and len(paths) > 5


@pytest.mark.parametrize("name", ["burn_bridges", "reburn"])
def test_burnt_cells_are_not_broadcast(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange") == 2 and "Generate" not in plan


def test_few_ties_of_many_cells_are_not_broadcast(spark):
    """The operator on pixels too."""
    mask = spark.range(3).selectExpr("id as image_id", "0 as y", "0 as x", "1 as open")
    ties = spark.range(3).selectExpr("id as image_id", "0d as x1", "0d as y1", "9d as x2", "0d as y2", "4d as width")
    assert "Broadcast" not in bridges.burn(mask, ties)._jdf.queryExecution().executedPlan().toString()


def test_corners_of_many_loops():
    """Loops are simplified together as each alone."""
    rng = np.random.default_rng(4)
    o = contours.outlined(np.kron(rng.integers(0, 2, (20, 14, 15)), np.ones((1, 2, 1), int)))
    tolerance = rng.choice([0.0, 0.4, 0.8, 1.4, 3.0, 30.0], len(o.loop))
    found = np.split(contours.fewer_corners(o, tolerance), o.ends[:-1])
    own = [contours.simplified(y, x, t) for y, x, t in zip(np.split(o.ys, o.ends[:-1]), np.split(o.xs, o.ends[:-1]), tolerance)]
    assert all((a == b).all() for a, b in zip(found, own)) and len(own) > 200 and sum(map(sum, own)) < len(o.xs)


def test_probes(spark):
    """Figures of packed images are those of their pixels; images that are nowhere solid have no signals."""
    df = frame(spark, "r", 256).withColumns({"g": (F.col("r") * 7 + F.col("x")) % 256, "b": (F.col("r") * 3 + F.col("y")) % 256, "a": F.when(F.col("image_id") < 2, 3).otherwise(F.col("r"))})
    shapes = spark.createDataFrame([(i, *s) for i, s in enumerate(SHAPES)], "image_id long, height int, width int")
    df = df.join(shapes, "image_id")
    stats = statistics.image_stats(tone.gray(df)).join(statistics.color_signals(df, F.col("width"), F.col("height")), "image_id", "left")
    columns = list(statistics.PROBED)
    a, b = (sorted((r.image_id, *(v if v is None else round(v, 9) for v in r[1:])) for r in m.select("image_id", *columns).collect()) for m in (stats, statistics.probed(grids.packed(df, *"rgba"))))
    assert a == b and a[0][-1] is None and a[-1][-1] is not None
