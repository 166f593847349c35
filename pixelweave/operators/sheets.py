"""Outlines cut to page tiles, and print sheets as PDF files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.operators import layout
from pixelweave.operators.contours import keys

#: Millimetres above and below a layer for its title and ruler.
TITLE, FOOT = 10.0, 14.0
POINT = 72 / 25.4
#: Control points of a quarter of a ring, as a share of its radius.
ARC = 0.5523


def tiles(sheets: DataFrame, page_w: float, page_h: float, margin: float) -> DataFrame:
    """The pages on which each of sheets(image_id, [layer,] width, height, width_mm, height_mm) prints at true size.

    A row for each page: keys, ``row`` and ``col``, and the part of the raster on it, from (x0, y0) to (x1, y1) in
    pixels. The last pages of a row or column hold what is left.
    """
    if not min(page_w, page_h) > 2 * margin:
        raise ValueError("margins leave nothing of the page")
    inner = {"x": (page_w - 2 * margin) / (F.col("width_mm") / F.col("width")), "y": (page_h - 2 * margin) / (F.col("height_mm") / F.col("height"))}
    count = lambda side, c: F.greatest(F.lit(1), F.ceil(F.col(side) / inner[c] - 1e-9)).cast("int")
    out = sheets.withColumn("row", F.explode(F.sequence(F.lit(0), count("height", "y") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), count("width", "x") - 1)))
    ends = {f"{c}{i}": F.least(F.col(side).cast("double"), (F.col(at) + i) * inner[c]) for c, side, at in (("x", "width", "col"), ("y", "height", "row")) for i in (0, 1)}
    return out.select(*keys(sheets), "row", "col", *[v.alias(k) for k, v in ends.items()])


def half(x: np.ndarray, y: np.ndarray, size: np.ndarray, edge: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corners of closed lines, ``size`` of each one after the other, where ``x`` is on one side of the line's edge, and how many; where a side crosses the edge, a corner is added."""
    if not len(x):
        return x, y, size
    ends = np.cumsum(size)
    back = np.arange(len(x)) - 1
    back[(ends - size)[size > 0]] = ends[size > 0] - 1
    edge = np.repeat(edge, size)
    depth = (x - edge) * sign
    before = depth[back]
    inside = depth >= 0
    cross = inside != (before >= 0)
    share = before / np.where(cross, before - depth, 1)
    at = y[back] + (y - y[back]) * share
    kept = np.stack([cross, inside], 1).ravel()  # the crossing lies before the corner
    left = np.append(0, np.cumsum(cross.astype(np.int64) + inside))
    return np.stack([edge, x], 1).ravel()[kept], np.stack([at, y], 1).ravel()[kept], left[ends] - left[ends - size]


def clipped(loops: DataFrame, pages: DataFrame) -> DataFrame:
    """The part of each loop on each of its mask's ``pages`` (:func:`tiles`): keys, row, col, loop, ``xs``, ``ys`` and signed ``area``.

    A loop that a page cuts into several parts stays one closed line, whose parts are joined along the page's
    edge, where they hold no area.
    """
    own = keys(loops)
    low, high = ({c: f(f"{c}s") for c in ("x", "y")} for f in (F.array_min, F.array_max))
    meets = (low["x"] < F.col("x1")) & (high["x"] > F.col("x0")) & (low["y"] < F.col("y1")) & (high["y"] > F.col("y0"))
    # loops look as few as their rasters to the planner, which must not broadcast them
    out = loops.select(*own, "loop", "xs", "ys").join(pages.hint("merge"), own).filter(meets)

    @F.arrow_udf("xs array<double>, ys array<double>, area double")
    def cut(xs: pa.Array, ys: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
        size = np.asarray(xs.value_lengths()).astype(np.int64)
        x, y = (np.asarray(c.flatten()) for c in (xs, ys))
        left, top, right, bottom = map(np.asarray, (x0, y0, x1, y1))
        x, y, size = half(*half(x, y, size, left, 1), right, -1)
        y, x, size = half(*half(y, x, size, top, 1), bottom, -1)
        ends = np.cumsum(size)
        on = np.arange(len(x)) + 1
        on[ends[size > 0] - 1] = (ends - size)[size > 0]
        area = np.bincount(np.repeat(np.arange(len(size)), size), x * y[on] - x[on] * y, len(size)) / 2
        at = pa.array(np.append(0, ends).astype(np.int32))
        return pa.StructArray.from_arrays([*(pa.ListArray.from_arrays(at, pa.array(c)) for c in (x, y)), pa.array(area)], names=["xs", "ys", "area"])

    out = out.withColumn("p", cut("xs", "ys", "x0", "y0", "x1", "y1"))
    return out.select(*own, "row", "col", "loop", "p.xs", "p.ys", "p.area").filter(F.size("xs") > 2)


def page_areas(parts: DataFrame, digits: int = 3) -> DataFrame:
    """``area`` of the :func:`clipped` loops of each page, rounded.

    An area that lies half way between two results comes out of the sums a few units of the last place off: it is
    rounded to nine digits first, so that it goes up whatever the order of the sums.
    """
    return parts.groupBy(*keys(parts), "row", "col").agg(F.round(F.round(F.sum("area"), 9), digits).alias("area"))


def _text(x: Column, y: Column, size: float, text: Column) -> Column:
    """A line of text in Helvetica; signs that PDF strings give a meaning are escaped, those beyond Latin 1 are question marks."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[^\x20-\x7E\xA0-\xFF]", "?"), r"([\\()])", r"\\$1")
    return F.concat(F.format_string(f"BT /F1 {size / POINT:.3f} Tf 1 0 0 -1 %.3f %.3f Tm (", x, y), plain, F.lit(") Tj ET\n"))


def _line(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.format_string("%.3f %.3f m %.3f %.3f l S\n", *[c.cast("double") for c in (x1, y1, x2, y2)])


def crop_marks(x: Column, y: Column, w: Column, h: Column, size: float = 4.0) -> Column:
    """Two lines inwards from each corner of a box, as a page draws them."""
    lines = [_line(cx, cy, *to) for cx, sx in ((x, size), (x + w, -size)) for cy, sy in ((y, size), (y + h, -size)) for to in ((cx + sx, cy), (cx, cy + sy))]
    return F.concat(F.lit("0.588 G 0.2 w\n"), *lines)


def scale_bar(x: Column, y: Column, mm: Column) -> Column:
    """A ruler of whole centimetres and its length in words."""
    ticks = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(mm / 10).cast("int") - 1)), lambda t: _line(x + t * 10, y - 1, x + t * 10, y + 1)), "")
    return F.concat(F.lit("0.157 G 0.4 w\n"), _line(x, y, x + mm, y), _line(x, y - 1.6, x, y + 1.6), _line(x + mm, y - 1.6, x + mm, y + 1.6), ticks, _text(x, y + 5, 7.5, F.format_string("Printed at full size, this bar is %d mm long.", mm.cast("int"))))


def _ring(x: Column, y: Column, r: Column) -> Column:
    quarter = lambda a, b: [x + r * a, y + r * b]
    turns = ((1, 0), (0, 1), (-1, 0), (0, -1))
    parts = [F.format_string("%.3f %.3f m ", *quarter(1, 0))]
    for (a, b), (c, d) in zip(turns, (*turns[1:], turns[0])):
        parts.append(F.format_string("%.3f %.3f %.3f %.3f %.3f %.3f c ", *quarter(a + ARC * c, b + ARC * d), *quarter(c + ARC * a, d + ARC * b), *quarter(c, d)))
    return F.concat(*parts, F.lit("S\n"))


def _color(fill: Column) -> Column:
    """Shares of red, green and blue; what is no six-digit colour is the near black of unsafe fills."""
    digits = F.when(fill.rlike("^#[0-9a-fA-F]{6}$"), fill).otherwise("#111111")
    return F.format_string("%.3f %.3f %.3f rg", *[F.conv(F.substring(digits, i, 2), 16, 10).cast("double") / 255 for i in (2, 4, 6)])


def pages(loops: DataFrame, sheets: DataFrame, fallback: tuple[float, float], margin: float = 10.0, marks: bool = False) -> DataFrame:
    """A row for each page: image_id, ``page``, its size in millimetres (sheet_w, sheet_h) and what is drawn (``content``).

    ``sheets(image_id, layer, width, height, width_mm, height_mm, fill)`` may have a ``label``. Page 0 lists the layers
    in spray order, on the ``fallback`` size; each layer has a page at true size where that is no larger than a sheet
    can be, else scaled into the fallback, and says which. Layers are numbered as they follow each other.
    """
    margin = max(3.0, margin)
    label = F.coalesce(F.col("label"), F.col("fill")) if "label" in sheets.columns else F.col("fill")
    named = sheets.withColumn("fill", layout.safe_color(F.coalesce("fill", F.lit("#111111")))).withColumn("name", label)
    sized = layout.sheet_page(named.withColumns({"page_w": F.lit(float(fallback[0])), "page_h": F.lit(float(fallback[1]))}), margin, TITLE + FOOT)
    sub = F.concat(F.array_join(F.transform(F.arrays_zip("xs", "ys"), lambda p: F.format_string("%.3f %.3f", p["xs"], p["ys"])), " l "), F.lit(" l h"))
    path = F.regexp_replace(sub, r"^(\S+ \S+) l", "$1 m")
    drawn = loops.filter(F.size("xs") > 2).groupBy("image_id", "layer").agg(F.array_sort(F.collect_list(F.struct("loop", path.alias("d")))).alias("ds"))
    count = sized.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("layer", "fill", "name"))).alias("every"), F.min_by("width_mm", "layer").alias("w"), F.min_by("height_mm", "layer").alias("h"))
    x, y, w, h = (F.col("sheet_w") - F.col("width_mm") * F.col("fit")) / 2, F.lit(margin + TITLE), F.col("width_mm") * F.col("fit"), F.col("height_mm") * F.col("fit")
    scale = F.col("fit") * F.col("width_mm") / F.col("width")
    size = F.greatest(F.lit(8.0), F.least("width", "height") * 0.04)
    corner = [F.concat(_ring(a, b, size / 2), _line(a - size, b, a + size, b), _line(a, b - size, a, b + size)) for b in (size * 1.5, F.col("height") - size * 1.5) for a in (size * 1.5, F.col("width") - size * 1.5)]
    order = F.array_position(F.transform("every", lambda e: e["layer"]), F.col("layer")).cast("int")
    true_size = F.format_string("%d x %d mm", F.round("width_mm").cast("long"), F.round("height_mm").cast("long"))
    title = F.concat(F.format_string("Layer %d of %d, ", order, F.size("every")), F.coalesce("name", F.lit("")), F.when(F.col("fit") == 1, F.concat(F.lit(", cut at "), true_size)).otherwise(F.concat(F.lit(", scaled, true size "), true_size)))
    content = F.concat(
        F.format_string("q %.6f 0 0 %.6f %.3f %.3f cm ", scale, scale, x, y), _color(F.col("fill")), F.lit("\n"),
        F.coalesce(F.concat(F.array_join(F.transform("ds", lambda s: s["d"]), "\n"), F.lit("\nf*\n")), F.lit("")),
        F.concat(F.lit("1 0 0 RG 0.4 w\n"), *corner) if marks else F.lit(""), F.lit("Q\n"),
        crop_marks(x, y, w, h), _text(F.lit(margin), F.lit(margin + 5), 9, title), scale_bar(x, y + h + 6, F.greatest(F.lit(20.0), F.least(F.lit(100.0), F.round(w)))),
    )
    layers = sized.join(drawn.hint("merge"), ["image_id", "layer"], "left").join(count.hint("merge"), "image_id").select("image_id", order.alias("page"), "sheet_w", "sheet_h", content.alias("content"))
    entry = lambda e, i: F.concat(_color(e["fill"]), F.format_string("\n%.3f %.3f 5.5 4.6 re f\n0 g\n", F.lit(margin), margin + 18 + i * 6), _text(F.lit(margin + 8), margin + 21.4 + i * 6, 9.5, F.concat(F.format_string("%d. ", i + 1), F.coalesce(e["name"], F.lit("")))))
    head = _text(F.lit(margin), F.lit(margin + 5), 14, F.format_string("%d layers, %d x %d mm", F.size("every"), F.round("w").cast("long"), F.round("h").cast("long")))
    cover = count.select("image_id", F.lit(0).alias("page"), F.lit(float(fallback[0])).alias("sheet_w"), F.lit(float(fallback[1])).alias("sheet_h"), F.concat(head, F.array_join(F.transform("every", entry), ""), scale_bar(F.lit(margin), F.lit(float(fallback[1]) - margin - 8), F.lit(100.0))).alias("content"))
    return cover.union(layers)


def pdf(rows: DataFrame) -> DataFrame:
    """A row for each image of :func:`pages`: ``content``, the PDF file of its pages in order, the same bytes each time."""

    import zlib

    def file(drawn: list[tuple]) -> bytes:
        objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(drawn))) + b"] /Count %d >>" % len(drawn)]
        objects.append(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")
        for i, (_, w, h, text) in enumerate(drawn):
            # millimetres from the top left corner
            body = zlib.compress(f"{POINT:.6f} 0 0 {-POINT:.6f} 0 {h * POINT:.3f} cm\n{text}".encode("latin-1"))
            objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {w * POINT:.3f} {h * POINT:.3f}] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>".encode())
            objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(body) + body + b"\nendstream")
        out, places = bytearray(b"%PDF-1.4\n"), []
        for i, o in enumerate(objects):
            places.append(len(out))
            out += b"%d 0 obj\n" % (i + 1) + o + b"\nendobj\n"
        begin = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
        out += b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(places) + 1, begin)
        return bytes(out)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                files = [file([tuple(p.values()) for p in batch["pages"][i].as_py()])]
                yield pa.RecordBatch.from_arrays([batch["image_id"].slice(i, 1), pa.array(files, pa.binary())], names=["image_id", "content"])

    every = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("page", "sheet_w", "sheet_h", "content"))).alias("pages"))
    return every.mapInArrow(run, f"image_id {rows.schema['image_id'].dataType.simpleString()}, content binary")


def export_pdfs(files: DataFrame, path: str, overwrite: bool = True) -> None:
    """Writes :func:`pdf` rows as files ``<image_id>.pdf``."""
    from pixelweave.sources.files import write_files

    write_files(files.select(F.concat(layout._folder("image_id"), F.lit(".pdf")).alias("name"), "content"), path, overwrite)
