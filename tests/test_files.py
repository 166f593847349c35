"""Image files by any name, the sink that writes all or nothing, and pictures that decode to what was painted."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import contours, pictures
from pixelweave.sources import rasters
from pixelweave.sources.files import write_files

NAMES = ["plain.png", "a#b.png", "100%.png", "q?z.png", "%20x.png", "x+y.png", "\u00fc.png", "a b.png", "[c].png", "{d}.png", "e*f.png", "b\\s.png", "sub/g&h=1.png"]


def test_every_name(spark, tmp_path):
    for i, n in enumerate(NAMES):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(pictures.png(np.full((2, 3, 3), i, np.uint8)))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    found = rasters.image_folder(spark, str(tmp_path)).groupBy("image_id").agg(F.collect_set("r").alias("r"), F.count("*").alias("n")).collect()
    assert {os.path.relpath(r.image_id.removeprefix("file:"), tmp_path): (r.r, r.n) for r in found} == {n: ([i], 6) for i, n in enumerate(NAMES)}
    listed = {os.path.relpath(r.image_id.removeprefix("file:"), tmp_path): (r.width, r.height, r.status) for r in rasters.image_files(spark, str(tmp_path)).collect()}
    assert listed == {n: (3, 2, "ok") for n in NAMES} | {"broken.png": (None, None, "unreadable")}


def test_large_files_are_not_read(spark, tmp_path, monkeypatch):
    """Beyond the limit a file is pruned from the scan and still listed."""
    (tmp_path / "small.png").write_bytes(pictures.png(np.zeros((2, 2, 1), np.uint8)))
    (tmp_path / "large.png").write_bytes(pictures.png(np.random.default_rng(1).integers(0, 256, (90, 90, 4), np.uint8)))
    (tmp_path / "wide.png").write_bytes(pictures.png(np.zeros((1, 300, 1), np.uint8)))
    monkeypatch.setattr(rasters, "MOST_BYTES", 2000)
    monkeypatch.setattr(rasters, "MOST_PIXELS", 200)
    status = {os.path.basename(r.image_id): r.status for r in rasters.image_files(spark, str(tmp_path)).collect()}
    assert status == {"small.png": "ok", "large.png": "bytes", "wide.png": "pixels"}
    read = rasters._images(spark, str(tmp_path))
    assert read.count() == 2 and "file_size" in read._jdf.queryExecution().executedPlan().toString()
    assert {os.path.basename(r.image_id) for r in rasters.image_folder(spark, str(tmp_path)).collect()} == {"small.png"}


def files(path):
    return {str(f.relative_to(path)): f.read_bytes() for f in path.rglob("*") if f.is_file()}


def test_sink(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.createDataFrame([(f"{i % 3}/f{i}.bin", bytes([i])) for i in range(20)], "name string, content binary").repartition(4)
    write_files(rows, str(out))
    assert files(out) == {f"{i % 3}/f{i}.bin": bytes([i]) for i in range(20)}
    with pytest.raises(Exception, match="there already"):
        write_files(rows.limit(1), str(out))
    write_files(spark.createDataFrame([("0/f0.bin", "new")], "name string, content string"), str(out), overwrite=True)
    assert len(files(out)) == 20 and files(out)["0/f0.bin"] == b"new"
    assert not [p for p in out.rglob("_files*")]
    write_files(rows.limit(0), str(tmp_path / "none"))
    assert files(tmp_path) == {f"out/{k}": v for k, v in files(out).items()}


@pytest.mark.parametrize("bad", ["../x", "/x", "", None, "a/../../x", "twice"])
def test_sink_leaves_nothing(spark, tmp_path, bad):
    out = tmp_path / "out"
    rows = spark.createDataFrame([("one", b"1"), ("twice", b"2"), (bad, b"3")], "name string, content binary").repartition(3)
    with pytest.raises(Exception, match="named"):
        write_files(rows, str(out))
    assert files(out) == {}


def test_sink_after_a_failed_task(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.range(50).repartition(5).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken row")).cast("string")).otherwise("x").alias("content"))
    with pytest.raises(Exception, match="broken row"):
        write_files(rows, str(out))
    assert files(out) == {}


def test_pictures(spark, tmp_path):
    """Layers painted in order, scaled; decoded again they are what the fills say."""
    masks = {0: np.kron([[1, 1, 0], [1, 0, 0]], np.ones((4, 4), int)), 1: np.pad([[1, 0, 1]], ((3, 4), (2, 7)))}
    df = spark.createDataFrame([(7, k, y, x, int(v)) for k, m in masks.items() for (y, x), v in np.ndenumerate(m)], "image_id long, layer int, y int, x int, open int")
    sheets = spark.createDataFrame([(7, 0, 12, 8, "#ff0000"), (7, 1, 12, 8, "#00ff40"), (9, 0, 12, 8, "no colour")], "image_id long, layer int, width int, height int, fill string")
    made = {r.image_id: r for r in pictures.preview(contours.contours(df), sheets, 36, 60).collect()}
    want = np.full((24, 36, 3), 255)
    for k, color in ((0, (255, 0, 0)), (1, (0, 255, 64))):
        want[np.kron(masks[k], np.ones((3, 3), int)) == 1] = color
    for k, r in made.items():
        (tmp_path / f"{k}.png").write_bytes(r.content)
    assert {(r.width, r.height) for r in made.values()} == {(36, 24)}
    back = {k: np.zeros((24, 36, 3), int) for k in (7, 9)}
    for r in rasters.image_folder(spark, str(tmp_path)).collect():
        back[int(os.path.basename(r.image_id)[:-4])][r.y, r.x] = r.r, r.g, r.b
    assert (back[7] == want).all() and (back[9] == 255).all()
