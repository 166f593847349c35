"""Known cases on small rasters: exact values, and what must hold whatever the values."""

import math
import os
import struct
import zipfile
import zlib
from io import BytesIO

import numpy as np
import pytest
from plain import plain_ties
from pyspark.sql import functions as F

from pixelweave.operators import bridges, components, layout, morphology, palettes, posterize, rules, statistics, tone
from pixelweave.operators.components import island_labels, labelled
from pixelweave.plans import compute
from pixelweave.sources.rasters import image_folder

DONUT = ["#######", "#######", "##...##", "##...##", "##...##", "#######", "#######"]


def art(lines):
    return np.array([[int(c == "#") for c in line] for line in lines])


def frame(spark, grid, column="lum", image=1):
    grid = np.asarray(grid)
    return spark.createDataFrame([(image, int(y), int(x), int(v)) for (y, x), v in np.ndenumerate(grid)], f"image_id long, y int, x int, {column} int")


def grid(df, column):
    rows = df.select("y", "x", column).collect()
    out = np.zeros((max(r[0] for r in rows) + 1, max(r[1] for r in rows) + 1), int)
    for y, x, v in rows:
        out[y, x] = v
    return out


def flood(mask, value):
    """Components by a plain search."""
    label, n = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask == value):
        if not label[y, x]:
            n += 1
            todo = [(y, x)]
            label[y, x] = n
            while todo:
                a, b = todo.pop()
                for p in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                    if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] == value and not label[p]:
                        label[p] = n
                        todo.append(p)
    return label


def test_components_by_search():
    rng = np.random.default_rng(1)
    for _ in range(60):
        mask = (rng.random((rng.integers(1, 14), rng.integers(1, 14))) < 0.55).astype(int)
        for value in (0, 1):
            assert (labelled(mask, value) == flood(mask, value)).all()
    snake = np.zeros((41, 41), int)
    snake[::2] = 1
    for i, y in enumerate(range(1, 41, 2)):
        snake[y, 0 if i % 2 else -1] = 1
    assert labelled(snake, 1).max() == 1


def test_threshold_and_histogram(spark):
    h = statistics.histogram(frame(spark, [[0, 0, 128, 255]]))
    assert {r.lum: r.n for r in h.filter("n > 0").collect()} == {0: 2, 128: 1, 255: 1}
    assert h.count() == 256
    levels = spark.createDataFrame([(1, [128])], "image_id long, thresholds array<int>")
    assert grid(posterize.layers(frame(spark, [[0, 64, 128, 192, 255]]), levels), "open").tolist() == [[1, 1, 0, 0, 0]]


def cuts(values, k):
    return posterize.cuts(np.bincount(np.ravel(values), minlength=256), k).tolist()


def test_cuts():
    found = cuts([10, 50, 120, 200, 240], 3)
    assert found == sorted(set(found)) and found[0] >= 10 and found[-1] <= 240
    (t,) = cuts([40] * 32 + [210] * 32, 1)
    assert 40 < t <= 210
    same = cuts([254] * 64, 6)
    assert len(same) == 6 and same == sorted(same) and 0 <= same[0] and same[-1] <= 255


def test_cuts_by_trial():
    rng = np.random.default_rng(2)
    for _ in range(5):
        n = np.zeros(256, int)
        n[rng.choice(256, 12, replace=False)] = rng.integers(1, 50, 12)

        def value(edges):
            parts = [np.arange(a, b) for a, b in zip([0, *edges], [*edges, 256])]
            return sum((n[p] * p).sum() ** 2 / n[p].sum() for p in parts if n[p].sum())

        best = max(value((a, b)) for a in range(1, 255) for b in range(a + 1, 256))
        assert value(posterize.cuts(n, 2).tolist()) == pytest.approx(best)


def test_layers_are_nested(spark):
    levels = spark.createDataFrame([(1, [80, 160])], "image_id long, thresholds array<int>")
    masks = posterize.layers(frame(spark, [[0, 60, 120, 180, 240]]), levels)
    light, dark = (grid(masks.filter(F.col("layer") == i), "open") for i in (0, 1))
    assert (light >= dark).all() and light.sum() > dark.sum()


def test_morphology(spark):
    dot = np.zeros((5, 5), int)
    dot[2, 2] = 1
    block = np.zeros((5, 5), int)
    block[1:4, 1:4] = 1
    d, b = frame(spark, dot, "open"), frame(spark, block, "open")
    assert grid(morphology.dilate(d), "open").sum() == 9
    assert grid(morphology.opened(d, 5, 5), "open").sum() == 0
    assert grid(components.despeckle(d, 2), "open").sum() == 0
    assert (grid(morphology.opened(b, 5, 5), "open") == block).all()
    assert grid(morphology.erode(b, 5, 5), "open").sum() == 1
    assert (grid(morphology.closed(b, 5, 5), "open") == block).all()
    bars = art([".......", ".##.##.", "......."])
    assert grid(morphology.closed(frame(spark, bars, "open"), 7, 3), "open")[1].tolist() == [0, 1, 1, 1, 1, 1, 0]
    assert components.component_count(frame(spark, art(["#..#", "#..#", "#..#"]), "open")).first().components == 2


def test_donut(spark):
    mask = frame(spark, art(FRAMED_DONUT := ["." * 9] + ["." + r + "." for r in DONUT] + ["." * 9]), "open")
    (island,) = components.islands(mask).collect()
    assert (island.size, island.cx, island.cy) == (9, 4.0, 4.0)
    ties = bridges.auto_bridges(mask)
    assert ties.count() >= 1
    assert components.islands(bridges.burn(mask, ties)).count() == 0
    found = bridges.reburn(mask, ties)
    assert grid(found, "floating").sum() == 0
    assert (grid(bridges.reburn(mask, ties.limit(0)), "floating") == (island_labels(art(FRAMED_DONUT)) > 0)).all()


def square(size, inner, border=1):
    g = np.ones((size, size), int)
    g[:border], g[-border:], g[:, :border], g[:, -border:] = 0, 0, 0, 0
    a = (size - inner) // 2
    g[a : a + inner, a : a + inner] = 0
    return g


def test_number_of_ties():
    g = square(41, 11)
    assert len(bridges.ties_of(g, bridges.Options())) == 1
    assert len(bridges.ties_of(g, bridges.Options(mm_per_px=2, spacing=6))) >= 2
    # the span of six cells is five steps: 10 mm is under 12, so one tie
    assert len(bridges.ties_of(square(24, 6), bridges.Options(mm_per_px=2.0))) == 1


@pytest.mark.parametrize("marks", [1 << 26, 500])
def test_ties_by_search(monkeypatch, marks):
    """All islands at once, one to five sectors, with a short reach and a long one, in turns and not."""
    monkeypatch.setattr(bridges, "MARKS", marks)
    rng = np.random.default_rng(3)
    many = 0
    for i in range(120):
        g = (rng.random((int(rng.integers(3, 22)), int(rng.integers(3, 22)))) < rng.choice([0.6, 0.75, 0.9])).astype(int)
        label = island_labels(g)
        if not label.max():
            continue
        counts = rng.integers(1, 6, int(label.max()))
        most = int(rng.choice([1, 2, 40]))
        found = bridges.waves(label, g, (g == 0) & (label == 0), most, counts)
        assert found == plain_ties(g, label, lambda k: counts[k - 1], most)
        many += len(found)
    assert many > 300


def test_burnt_by_distance():
    rng = np.random.default_rng(4)
    for _ in range(30):
        ties = [(*rng.uniform(-3, 18, 4).tolist(), float(rng.choice([0.5, 1, 2, 5]))) for _ in range(2)]
        want = np.ones((14, 16), int)
        for x1, y1, x2, y2, width in ties:
            n = max(1, math.ceil(2 * math.hypot(x2 - x1, y2 - y1)))
            for i in range(n + 1):
                px, py = x1 + (x2 - x1) * (i / n), y1 + (y2 - y1) * (i / n)
                for y in range(14):
                    for x in range(16):
                        if (x - px) ** 2 + (y - py) ** 2 <= max(0.5, width / 2) ** 2:
                            want[y, x] = 0
        assert (bridges.burnt(np.ones((14, 16), int), ties) == want).all()


def test_prepared_islands():
    g = art(["." * 9] + ["." + r + "." for r in DONUT] + ["." * 9])
    none = np.zeros_like(g)
    out, ties, kept, filled = bridges.prepared(g, none, bridges.Options(min_area=100))
    assert (kept, filled, len(ties)) == (0, 1, 0) and island_labels(out).max() == 0
    out, ties, kept, filled = bridges.prepared(g, none, bridges.Options(min_area=5))
    assert (kept, filled) == (1, 0) and len(ties) >= 1 and island_labels(bridges.burnt(out, ties)).max() == 0
    dots = np.ones((9, 9), int)
    dots[0], dots[-1], dots[:, 0], dots[:, -1] = 0, 0, 0, 0
    for y, x in ((2, 2), (2, 6), (6, 2), (6, 6)):
        dots[y, x] = 0
    assert bridges.prepared(dots, np.zeros_like(dots), bridges.Options(max_kept=2))[2:] == (2, 2)
    shiny = square(11, 5)
    bright = np.zeros_like(shiny)
    bright[3:8, 3:8] = 1
    _, ties, kept, _ = bridges.prepared(shiny, bright, bridges.Options(max_kept=0, min_area=100, keep_highlights=True))
    assert kept == 1 and len(ties) >= 1
    open_field = np.ones((7, 7), int)
    open_field[3, 3] = 0
    assert bridges.ties_of(open_field, bridges.Options()) == []
    open_field[0], open_field[-1], open_field[:, 0], open_field[:, -1] = 0, 0, 0, 0
    assert len(bridges.ties_of(open_field, bridges.Options())) >= 1


def test_built_layers(spark):
    steps = np.array([[x * 10 % 256 for x in range(24)] for _ in range(24)])
    found = bridges.built(steps, cuts(steps, 4), bridges.Build())
    assert len(found) == 4 and not any(e for _, e, _, _ in found)
    dark = np.full((16, 16), 255)
    dark[:2], dark[-2:], dark[:, :2], dark[:, -2:] = 0, 0, 0, 0
    dark[6:10, 6:10] = 0
    assert all(not ties for *_, ties in bridges.built(255 - dark, [128], bridges.Build(bridge=False)))
    again = np.array([[x * 12 % 256 for x in range(20)] for _ in range(20)])
    one, two = (bridges.built(again, cuts(again, 3), bridges.Build(edge_amount=50)) for _ in range(2))
    assert all((a[2] == b[2]).all() and a[3] == b[3] for a, b in zip(one, two))


def test_edge_layer_drops_specks():
    """Despeckled by the floor of edge layers (40 cells at least), not by the least feature."""
    rng = np.random.default_rng(5)
    lum = np.where(rng.random((48, 48)) < 0.02, 0, 200)
    lum[10:38, 10:38] = 20
    mask = bridges.built(lum, [100], bridges.Build(edge_amount=50))[-1][2]
    sizes = np.bincount(labelled(mask, 1).ravel())[1:]
    holes = np.bincount(island_labels(mask).ravel())[1:]
    assert (sizes >= 40).all() and (holes >= 40).all() and mask.sum() > 0


def test_layers_as_rows(spark):
    lum = np.array([[(x * 9 + y * 31) % 256 for x in range(30)] for y in range(26)])
    look = compute.Look(layers=3, build=bridges.Build(edge_amount=50))
    layers = compute.layers(frame(spark, lum), look)
    want = bridges.built(lum, cuts(lum, 3), look.build)
    pixels, work = bridges.layer_pixels(layers), compute.work_masks(layers)
    for i, (_, _, mask, ties) in enumerate(want):
        assert (grid(pixels.filter(F.col("layer") == i), "open") == mask).all()
        assert (grid(work.filter(F.col("layer") == i), "open") == bridges.burnt(mask, ties)).all()
    assert [tuple(r)[3:] for r in bridges.layer_ties(layers).orderBy("layer", "tie").collect()] == [t for w in want for t in w[3]]
    assert compute.cut_files(layers, 200, marks=True).count() == 4
    (proof,) = compute.proofs(layers, 200).collect()
    assert proof.svg.count("<g ") == 4 and 'width="200mm" height="173.33mm" viewBox="0 0 30 26"' in proof.svg


def test_sobel_and_flips(spark):
    halves = np.array([[0] * 6 + [255] * 6] * 6)
    found = grid(tone.edges(frame(spark, halves)), "open")
    assert found.sum() > 0 and found[0, 0] == 0
    small = frame(spark, [[1, 2, 3], [4, 5, 6]])
    assert grid(tone.flip(small, 3), "lum").tolist() == [[3, 2, 1], [6, 5, 4]]
    assert grid(tone.flip(small, 2, horizontal=False), "lum").tolist() == [[4, 5, 6], [1, 2, 3]]
    assert grid(tone.flip(tone.flip(small, 3), 3), "lum").tolist() == [[1, 2, 3], [4, 5, 6]]


def colors(spark, value, h=20, w=20):
    return spark.createDataFrame([(1, y, x, *value(y, x)) for y in range(h) for x in range(w)], "image_id long, y int, x int, r int, g int, b int")


def test_colour_signals(spark):
    assert statistics.color_signals(colors(spark, lambda y, x: (200, 140, 110)), 20, 20).first().skin > 0.5
    assert statistics.color_signals(colors(spark, lambda y, x: (40, 80, 200)), 20, 20).first().skin == 0
    scene = statistics.color_signals(colors(spark, lambda y, x: (90, 150, 230) if y < 18 else (60, 130, 50), 40, 40), 40, 40)
    r = scene.first()
    assert r.sky > 0.4 and r.green > 0.3
    assert scene.withColumns({"tone_count": F.lit(99), "std": F.lit(20.0)}).select(rules.pick_preset()).first()[0] == "landscape"
    stats = statistics.image_stats(frame(spark, [[40] * 8 + [210] * 8] * 16)).first()
    assert stats["std"] > 50 and stats.tone_count == 2


def test_gray_values(spark):
    rows = [(1, 0, 0, 255, 255, 255), (1, 0, 1, 0, 0, 0), (1, 1, 0, 255, 0, 0), (1, 1, 1, 0, 255, 0)]
    found = grid(tone.gray(spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int")), "lum")
    assert found.tolist()[0] == [255, 0] and abs(found[1, 0] - 54) <= 1 and abs(found[1, 1] - 182) <= 1
    assert grid(tone.bright(frame(spark, [[200, 210, 255], [0, 209, 211]])), "bright").ravel().tolist() == [0, 1, 1, 0, 0, 1]


def test_smoothing(spark):
    noisy = np.array([[(60 if x < 12 else 200) + (12 if (x + y) % 2 else -12) for x in range(24)] for y in range(24)])
    out = grid(tone.bilateral(frame(spark, noisy), 3, 30), "lum")
    assert out[:, :10].var() < noisy[:, :10].var() / 2 and out[:, 14:].mean() - out[:, :10].mean() > 120
    want = np.empty_like(noisy)
    f = lambda v: float(np.float32(v))
    for y in range(24):
        for x in range(24):
            near = [(noisy[b, a], f(math.exp(-((a - x) ** 2 + (b - y) ** 2) / 8)) * f(math.exp(-((int(noisy[b, a]) - int(noisy[y, x])) ** 2) / 1800))) for b in range(max(0, y - 3), min(24, y + 4)) for a in range(max(0, x - 3), min(24, x + 4))]
            want[y, x] = round(sum(v * w for v, w in near) / sum(w for _, w in near))
    assert (out == want).all()


def test_local_contrast(spark):
    ramp = np.array([[110 + x for x in range(64)]] * 64)
    out = grid(tone.clahe(frame(spark, ramp), 2, 4), "lum")
    assert np.ptp(out) > 63 and out.min() >= 0 and out.max() <= 255


def test_local_contrast_by_loops():
    rng = np.random.default_rng(6)
    g = rng.integers(60, 120, (37, 50)).astype(np.int32)
    tw, th = math.ceil(50 / 4), math.ceil(37 / 4)
    nx, ny = math.ceil(50 / tw), math.ceil(37 / th)
    maps = {}
    for ty in range(ny):
        for tx in range(nx):
            part = g[ty * th : (ty + 1) * th, tx * tw : (tx + 1) * tw].ravel()
            bins = np.bincount(part, minlength=256)
            limit = max(1, math.floor(2.5 * len(part) / 256))
            extra = sum(max(0, b - limit) for b in bins)
            bins = [min(b, limit) + extra // 256 for b in bins]
            maps[ty, tx] = [min(255, math.floor(c * (255 / sum(bins)) + 0.5)) for c in np.cumsum(bins)]
    want = np.empty_like(g)
    for y in range(37):
        for x in range(50):
            fy, fx = (y + 0.5) / th - 0.5, (x + 0.5) / tw - 0.5
            y0, x0 = math.floor(fy), math.floor(fx)
            wy, wx = fy - y0, fx - x0
            if y0 < 0:
                y0, wy = 0, 0
            if x0 < 0:
                x0, wx = 0, 0
            y1, x1 = min(ny - 1, y0 + 1), min(nx - 1, x0 + 1)
            y0, x0 = min(y0, ny - 1), min(x0, nx - 1)
            a, b, c, d = (maps[p][g[y, x]] for p in ((y0, x0), (y0, x1), (y1, x0), (y1, x1)))
            top, low = a + (b - a) * wx, c + (d - c) * wx
            want[y, x] = round(top + (low - top) * wy)
    assert (tone.equalised(g, 4, 2.5) == want).all()


def test_pages_and_paints(spark):
    rows = spark.createDataFrame([(300.0, 200.0, 210.0, 297.0), (1500.0, 1000.0, 210.0, 297.0)], "width_mm double, height_mm double, page_w double, page_h double")
    a, b = layout.sheet_page(rows, 10.0, 24.0).collect()
    assert (a.sheet_w, a.sheet_h, a.fit) == (320.0, 244.0, 1.0)
    assert (b.sheet_w, b.sheet_h) == (210.0, 297.0) and b.fit < 1
    near = palettes.nearest_paint(palettes.channels(spark.createDataFrame([("#ffd200",), ("#0b0b0b",)], "asked string").withColumnRenamed("asked", "hex")).withColumnRenamed("hex", "asked")).collect()
    assert near[0].hex == "#ffd200" and near[0].distance == 0 and near[1].name
    nothing = spark.createDataFrame([(None, 1, 2)], "r int, g int, b int")
    assert palettes.nearest_paint(nothing).first().name is None


def test_rules(spark):
    d = spark.createDataFrame([(None,) * 6 + (None,)], "skin double, tone_count int, std double, sky double, green double, face_area double, scene boolean")
    assert d.select(rules.pick_preset()).first()[0] == "subject"
    tuned = rules.adaptive_tune(spark.createDataFrame([(128.0, 60.0, 0.2)], "mean double, std double, edge_density double").withColumns({c: F.lit(None).cast("int") for c in ("brightness", "contrast", "smooth")})).first()
    assert (tuned.brightness, tuned.contrast, tuned.smooth) == (0, 0, 2)
    plan = rules.recompute_plan(spark.createDataFrame([("minFeature", None), ("minFeature", True), ("margin", False), ("layers", False)], "control string, stale boolean"), spark)
    assert {(r.control, r.stale): (r.action, r.regray) for r in plan.collect()} == {("minFeature", None): ("pipeline", False), ("minFeature", True): ("pipeline", True), ("margin", False): ("none", None), ("layers", False): ("pipeline", True)}


def test_svg(spark, tmp_path):
    paths = spark.createDataFrame([(1, 0, 0, 0, "M 0 0 L 1 1 Z"), (1, 1, 0, 0, "M 2 2 L 3 3 Z")], "image_id long, layer int, y int, x1 int, d string")
    sheets = spark.createDataFrame([(1, i, 100, 80, 300.0, 240.0, fill) for i, fill in enumerate(["#abc", '"/><script>alert(1)</script>', "red"])], "image_id long, layer int, width int, height int, width_mm double, height_mm double, fill string")
    svgs = layout.layer_svg(paths, sheets)
    by = {r.layer: r.svg for r in svgs.collect()}
    assert 'width="300mm" height="240mm" viewBox="0 0 100 80"' in by[0] and "<script" not in by[1] and '<g fill="red"' in by[2]
    both = layout.combined_svg(paths, sheets).first().svg
    assert both.count("<g ") == 3 and "<script" not in both
    layout.export_layers(svgs, str(tmp_path / "out"))
    assert {str(f.relative_to(tmp_path / "out")): f.read_text() for f in (tmp_path / "out").rglob("*.svg")} == {f"1/layer-{i + 1}.svg": by[i] for i in range(3)}
    layout.export_zips(layout.zipped(svgs), str(tmp_path / "out"))
    assert (tmp_path / "out" / "1.zip").read_bytes() == layout.zipped(svgs).first().content
    with zipfile.ZipFile(BytesIO(layout.zipped(svgs).first().content)) as z:
        assert z.namelist() == ["layer-1.svg", "layer-2.svg", "layer-3.svg"] and z.read("layer-2.svg").decode() == by[1]


def test_odd_rasters(spark):
    """Nulls, repeated places, a single pixel, none at all."""
    rows = [(1, 0, 0, 1), (1, 0, 1, None), (1, None, 0, 1), (1, 1, 0, 0), (1, 1, 0, 1), (2, 0, 0, 1), (None, 0, 0, 1)]
    mask = spark.createDataFrame(rows, "image_id long, y int, x int, open int")
    found = sorted(map(str, components.components(mask).select("image_id", "y", "x", "label").collect()))
    assert len(found) == 7
    assert {(r.image_id, r.y, r.x): r.label for r in components.components(mask).collect()} == {(1, 0, 0): 1, (1, 0, 1): 0, (1, None, 0): None, (1, 1, 0): 1, (2, 0, 0): 1, (None, 0, 0): 1}
    for f in (components.despeckle(mask, 9), components.islands(mask), bridges.auto_bridges(mask), components.component_count(mask)):
        f.collect()
    none = mask.limit(0)
    for f in (components.components(none), components.islands(none), bridges.auto_bridges(none), bridges.burn(none, bridges.auto_bridges(none)), tone.clahe(none.withColumnRenamed("open", "lum"))):
        assert f.collect() == []


def png(path, rows, kind):
    """Writes 8-bit pixels (lists of channels); ``kind``: 0 gray, 2 colour, 6 with alpha."""
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in rows)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    png(tmp_path / "gray.png", [[(7,), (200,)]], 0)
    png(tmp_path / "with space.png", [[(1, 2, 3)], [(250, 0, 9)]], 2)
    png(tmp_path / "sub" / "alpha.png", [[(9, 8, 7, 255), (1, 1, 1, 30)]], 6)
    (tmp_path / "broken.png").write_bytes(b"no image")
    found = {}
    for r in image_folder(spark, str(tmp_path)).collect():
        found.setdefault(os.path.basename(r.image_id), {})[r.y, r.x] = (r.width, r.height, r.r, r.g, r.b, r.a)
    assert set(found) == {"gray.png", "with space.png", "alpha.png"}
    assert found["gray.png"] == {(0, 0): (2, 1, 7, 7, 7, 255), (0, 1): (2, 1, 200, 200, 200, 255)}
    assert found["with space.png"] == {(0, 0): (1, 2, 1, 2, 3, 255), (1, 0): (1, 2, 250, 0, 9, 255)}
    assert found["alpha.png"] == {(0, 0): (2, 1, 9, 8, 7, 255), (0, 1): (2, 1, 1, 1, 1, 30)}
    gray = compute.gray(image_folder(spark, str(tmp_path)), F.col("width"), F.col("height"), compute.Look(layers=1))
    assert compute.cut_files(compute.layers(gray, compute.Look(layers=1)), 100).count() == 3
