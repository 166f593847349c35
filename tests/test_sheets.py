"""Page tiles against overlaps cell by cell; PDF files read back object by object."""

import re
import zlib

import pytest
from test_contours import cells, masks

from pixelweave.operators import contours, sheets


def listed(spark, ids, mm=100.0, fill="#336699"):
    sizes = {i: (len(m[0]), len(m)) for i, m in enumerate(masks())}
    rows = [(i, *sizes[i], mm, mm * sizes[i][1] / sizes[i][0], fill) for i in ids]
    return spark.createDataFrame(rows, "image_id long, width int, height int, width_mm double, height_mm double, fill string")


def test_tiles_cover_the_sheet_once(spark):
    found = sheets.tiles(listed(spark, range(len(masks()))), 40, 30, 2.5).toPandas()
    for i, m in enumerate(masks()):
        own = found[found.image_id == i]
        assert ((own.x1 - own.x0) * (own.y1 - own.y0)).sum() == pytest.approx(len(m) * len(m[0]))
        assert own.groupby("row").x0.min().eq(0).all() and own.groupby("row").x1.max().eq(len(m[0])).all()
    with pytest.raises(ValueError):
        sheets.tiles(listed(spark, [0]), 40, 30, 15)


@pytest.mark.parametrize("page", [(40, 30), (23.7, 61.1), (1000, 2000)])
def test_clipped_areas_by_cells(spark, page):
    loops = contours.contours(cells(spark))
    tiled = sheets.tiles(listed(spark, range(len(masks()))), *page, 2.5)
    found = {tuple(r[:3]): r[3] for r in sheets.clipped(loops, tiled).groupBy("image_id", "row", "col").sum("area").collect()}
    for t in tiled.collect():
        m = masks()[t.image_id]
        over = lambda a, b, c: max(0.0, min(a + 1, c) - max(a, b))
        want = sum(v * over(x, t.x0, t.x1) * over(y, t.y0, t.y1) for y, line in enumerate(m) for x, v in enumerate(line))
        assert found.get((t.image_id, t.row, t.col), 0) == pytest.approx(want, abs=1e-6)


def test_slanted_sides_are_cut_where_they_cross(spark):
    loops = spark.createDataFrame([(0, 1, [0.0, 10.0, 0.0], [0.0, 0.0, 10.0])], "image_id long, loop long, xs array<double>, ys array<double>")
    tiled = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 6.0, 6.0), (0, 0, 1, 6.0, 0.0, 10.0, 6.0), (0, 1, 0, 0.0, 6.0, 6.0, 10.0), (0, 1, 1, 6.0, 6.0, 10.0, 10.0)], "image_id long, row int, col int, x0 double, y0 double, x1 double, y1 double")
    found = {(r.row, r.col): r for r in sheets.clipped(loops, tiled).collect()}
    assert found[0, 0].area == pytest.approx(36 - 2) and found[0, 1].area == found[1, 0].area == pytest.approx(8)
    assert (6.0, 4.0) in set(zip(found[0, 0].xs, found[0, 0].ys))
    assert (1, 1) not in found or found[1, 1].area == 0


def test_areas_half_way_go_up(spark):
    """A ring of two loops whose area on a page is 8.6875, and comes out of the sums as 8.687499999999993."""
    rows = [(0, 0, 2, 8.687499999999993), (0, 1, 2, 10.0), (0, 1, 2, -1.3125000000000004), (0, 2, 2, 8.68749)]
    found = {r.row: r.area for r in sheets.page_areas(spark.createDataFrame(rows, "image_id long, row int, col int, area double")).collect()}
    assert found == {0: 8.688, 1: 8.688, 2: 8.687}


def objects(content):
    """Objects by number, found through the file's own table of places."""
    begin = int(re.search(rb"startxref\n(\d+)\n%%EOF\n$", content)[1])
    assert content[begin:].startswith(b"xref\n")
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n ", content[begin:])]
    out = {}
    for i, p in enumerate(places, 1):
        assert content[p:].startswith(b"%d 0 obj\n" % i)
        out[i] = content[p:].split(b" obj\n", 1)[1].split(b"\nendobj", 1)[0]
    assert int(re.search(rb"/Size (\d+)", content)[1]) == len(places) + 1
    return out


def test_pdf_by_its_parts(spark):
    loops = contours.contours(cells(spark, [masks()[4]] * 2).selectExpr("image_id", "cast(image_id as int) * 2 as layer", "y", "x", "open"))
    rows = [(0, 0, 3, 3, 100.0, 100.0, "#ff0000", "red (hot)"), (0, 5, 3, 3, 100.0, 100.0, "url(x)", "日"), (1, 2, 3, 3, 2000.0, 2000.0, None, None)]
    own = spark.createDataFrame(rows, "image_id long, layer int, width int, height int, width_mm double, height_mm double, fill string, label string")
    files = {r.image_id: bytes(r.content) for r in sheets.pdf(sheets.pages(loops, own, (210.0, 297.0), marks=True)).collect()}
    assert set(files) == {0, 1}
    parts = objects(files[0])
    kids = [int(k) for k in re.findall(rb"(\d+) 0 R", re.search(rb"/Kids \[(.*?)\]", parts[2])[1])]
    boxes, texts = [], []
    for k in kids:
        boxes.append([round(float(x) / sheets.POINT) for x in re.search(rb"/MediaBox \[0 0 (\S+) (\S+)\]", parts[k]).groups()])
        head, body = parts[int(re.search(rb"/Contents (\d+)", parts[k])[1])].split(b"\nstream\n", 1)
        body = body.removesuffix(b"\nendstream")
        assert len(body) == int(re.search(rb"/Length (\d+)", head)[1])
        texts.append(zlib.decompress(body).decode("latin-1"))
    assert boxes == [[210, 297], [120, 144], [120, 144]]
    assert "(2 layers, 100 x 100 mm)" in texts[0] and r"(1. red \(hot\))" in texts[0]
    assert "1.000 0.000 0.000 rg" in texts[1] and r"(Layer 1 of 2, red \(hot\), cut at 100 x 100 mm)" in texts[1]
    assert "0.000 0.000 m 3.000 0.000 l 3.000 3.000 l 0.000 3.000 l h\n1.000 1.000 m" in texts[1]  # the ring and its hole
    assert texts[1].count(" c ") == 16 and texts[1].count("f*") == 1
    assert "0.067 0.067 0.067 rg" in texts[2] and "(Layer 2 of 2, ?, cut" in texts[2] and "f*" not in texts[2]  # no outline
    large = objects(files[1])
    assert [round(float(x) / sheets.POINT) for x in re.findall(rb"/MediaBox \[0 0 (\S+) ", b"".join(large.values()))] == [210, 210]
    again = {r.image_id: bytes(r.content) for r in sheets.pdf(sheets.pages(loops, own.repartition(3), (210.0, 297.0), marks=True)).collect()}
    assert again == files


def test_no_sheets_no_files(spark):
    none = contours.contours(cells(spark).selectExpr("image_id", "0 as layer", "y", "x", "open").limit(0))
    own = listed(spark, [0]).selectExpr("image_id", "0 as layer", "width", "height", "width_mm", "height_mm", "fill")
    assert sheets.pdf(sheets.pages(none, own.limit(0), (210.0, 297.0))).count() == 0
    assert sheets.pdf(sheets.pages(none, own, (210.0, 297.0))).count() == 1
    assert sheets.clipped(none, sheets.tiles(own, 210, 297, 10)).count() == 0


def test_exported_files(spark, tmp_path):
    loops = contours.contours(cells(spark).selectExpr("image_id", "0 as layer", "y", "x", "open"))
    own = listed(spark, [4, 5]).selectExpr("image_id", "0 as layer", "width", "height", "width_mm", "height_mm", "fill")
    sheets.export_pdfs(sheets.pdf(sheets.pages(loops.filter("image_id in (4, 5)"), own, (210.0, 297.0))), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("*.pdf")) == ["4.pdf", "5.pdf"]
