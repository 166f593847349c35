"""Physical size, registration marks, sheets and SVG text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.functions.numbers import half_up

#: The largest sheet, in millimetres.
MOST = (841.0, 1189.0)
# fixed values: fills that may stand in an SVG
SAFE = (r"^#[0-9a-fA-F]{3,8}$", r"^rgb\(\s*[\d.,\s%]+\)$", r"^[a-zA-Z]{3,20}$")
# end of fixed values


def physical_size(rows: DataFrame) -> DataFrame:
    """Rows (width, height, target_mm, bridge_mm) with size in millimetres, scale and tie width in pixels."""
    scale = F.col("target_mm") / F.col("width")
    return rows.withColumns({"width_mm": F.col("target_mm").cast("double"), "height_mm": scale * F.col("height"), "mm_per_px": scale, "bridge_px": F.greatest(F.lit(1), half_up(F.col("bridge_mm") / scale)).cast("int")})


def fit_size(rows: DataFrame, most: int) -> DataFrame:
    """Rows (width, height) clamped to a long edge."""
    share = F.least(F.lit(1.0), most / F.greatest("width", "height"))
    return rows.withColumns({c: F.greatest(F.lit(1), half_up(F.col(c) * share)).cast("int") for c in ("width", "height")})


def corner_marks(rows: DataFrame) -> DataFrame:
    """Four marks for each row (width, height): corner, x, y, size."""
    size = F.greatest(F.lit(8), half_up(F.least("width", "height") * 0.04))
    out = rows.withColumn("size", size.cast("double"))
    inset = F.col("size") * 1.5
    at = [F.struct(F.lit(i).alias("corner"), x.alias("x"), y.alias("y")) for i, (x, y) in enumerate((a, b) for b in (inset, F.col("height") - inset) for a in (inset, F.col("width") - inset))]
    return out.withColumn("m", F.explode(F.array(*at))).select(*rows.columns, "m.corner", "m.x", "m.y", "size")


def sheet_page(rows: DataFrame, margin: float, extra: float = 0.0) -> DataFrame:
    """Rows (width_mm, height_mm, page_w, page_h) with the sheet (sheet_w, sheet_h) and the scale ``fit``."""
    w, h = F.col("width_mm") + 2 * margin, F.col("height_mm") + 2 * margin + extra
    true_size = (F.least(w, h) <= MOST[0]) & (F.greatest(w, h) <= MOST[1])
    fit = F.least((F.col("page_w") - 2 * margin) / F.col("width_mm"), (F.col("page_h") - 2 * margin - extra) / F.col("height_mm"))
    return rows.withColumns({"sheet_w": F.when(true_size, w).otherwise(F.col("page_w")), "sheet_h": F.when(true_size, h).otherwise(F.col("page_h")), "fit": F.when(true_size, 1.0).otherwise(fit)})


def safe_color(color: Column) -> Column:
    c = F.trim(color)
    return F.when(c.rlike(SAFE[0]) | c.rlike(SAFE[1]) | c.rlike(SAFE[2]), c).otherwise("#111111")


def touch_up_points(ties: DataFrame, box_w: float, box_h: float) -> DataFrame:
    """Middles of ties(image_id, layer, x1, y1, x2, y2, width, px_w, px_h) scaled to a box."""
    return ties.select("image_id", ((F.col("x1") + F.col("x2")) / 2 * (box_w / F.col("px_w"))).alias("px"), ((F.col("y1") + F.col("y2")) / 2 * (box_h / F.col("px_h"))).alias("py"))


def run_paths(masks: DataFrame) -> DataFrame:
    """Outlines of the open runs of each row of masks(image_id, layer, y, x, open), as rectangles: image_id, layer, y, x1, x2, d.

    Not the smoothed outlines of a tracing library; an exact cover of the open cells.
    """
    from pyspark.sql import Window

    row = Window.partitionBy("image_id", "layer", "y").orderBy("x")
    runs = masks.filter("open = 1").withColumn("run", F.col("x") - F.row_number().over(row))
    spans = runs.groupBy("image_id", "layer", "y", "run").agg(F.min("x").alias("x1"), (F.max("x") + 1).alias("x2")).drop("run")
    return spans.withColumn("d", F.format_string("M %d %d L %d %d L %d %d L %d %d Z", "x1", "y", "x2", "y", "x2", F.col("y") + 1, "x1", F.col("y") + 1))


# fixed values: the text of an SVG sheet
HEADER = '<?xml version="1.0" encoding="UTF-8"?>\n<svg xmlns="http://www.w3.org/2000/svg" width="%smm" height="%smm" viewBox="0 0 %d %d">\n'
GROUP = '  <g fill="%s" fill-rule="evenodd" stroke="none">\n%s\n  </g>\n'
PATH = '    <path d="%s" />'
MARKS = '  <g fill="none" stroke="#ff0000" stroke-width="%s">\n    %s\n  </g>\n'
CIRCLE = '<circle cx="%s" cy="%s" r="%s" />'
LINE = '<line x1="%s" y1="%s" x2="%s" y2="%s" />'
# end of fixed values


def number(n: Column) -> Column:
    """Two decimals at most, halves up, no trailing zeros."""
    r = F.floor(n * 100 + 0.5).cast("long")
    return F.regexp_replace(F.regexp_replace(F.format_string("%s%d.%02d", F.when(r < 0, "-").otherwise(""), F.floor(F.abs(r) / 100), F.abs(r) % 100), "0+$", ""), "\\.$", "")


def mark_svg(x: Column, y: Column, size: Column) -> Column:
    """A ring and two lines."""
    text = lambda t, *c: F.format_string(t, *map(number, c))
    return F.concat(text(CIRCLE, x, y, size / 2), text(LINE, x - size, y, x + size, y), text(LINE, x, y - size, x, y + size))


def marks_svg(width: Column, height: Column) -> Column:
    """The group of the four corner marks of a raster."""
    size = F.greatest(F.lit(8), half_up(F.least(width, height) * 0.04)).cast("double")
    inset = size * 1.5
    marks = [mark_svg(x, y, size) for y in (inset, height - inset) for x in (inset, width - inset)]
    return F.format_string(MARKS, number(F.greatest(F.lit(0.4), F.least(width, height) * 0.002)), F.concat_ws("\n    ", *marks))


def _bodies(paths: DataFrame, layers: DataFrame) -> DataFrame:
    """``layers`` with ``body``, their paths in row order; a layer without open cells has none."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x1", "d")))
    body = F.array_join(F.transform(ordered, lambda p: F.format_string(PATH, p["d"])), "\n")
    found = paths.groupBy("image_id", "layer").agg(body.alias("body"))
    return layers.join(found, ["image_id", "layer"], "left").fillna({"body": ""})


def layer_svg(paths: DataFrame, layers: DataFrame, marks: bool | Column = False) -> DataFrame:
    """One SVG text for each of ``layers(image_id, layer, width, height, width_mm, height_mm, fill)``; with ``marks`` in the corners of all, or of those for which the column is true."""
    return sheet_svg(_bodies(paths, layers), marks)


def drawn_svg(layers: DataFrame, marks: bool | Column = False) -> DataFrame:
    """:func:`layer_svg` of layers that have their path ``d`` with them."""
    return sheet_svg(layers.withColumn("body", F.when(F.col("d") != "", F.format_string(PATH, "d")).otherwise("")), marks)


def sheet_svg(out: DataFrame, marks: bool | Column = False) -> DataFrame:
    """The SVG text of layers with a ``body``."""
    head = F.format_string(HEADER, number(F.col("width_mm")), number(F.col("height_mm")), F.col("width").cast("int"), F.col("height").cast("int"))
    corner = marks_svg(F.col("width"), F.col("height")) if marks is not False else F.lit("")
    if isinstance(marks, Column):
        corner = F.repeat(corner, F.coalesce(marks, F.lit(False)).cast("int"))  # a branch would keep its parts from being shared
    return out.select("image_id", "layer", F.concat(head, F.format_string(GROUP, safe_color(F.col("fill")), F.col("body")), corner, F.lit("</svg>\n")).alias("svg"))


def combined_svg(paths: DataFrame, layers: DataFrame, marks: bool = False) -> DataFrame:
    """One SVG text for each image: a group for each layer in spray order (size and marks of the first)."""
    own = _bodies(paths, layers).select("image_id", "layer", "width", "height", "width_mm", "height_mm", F.format_string(GROUP, safe_color(F.col("fill")), F.col("body")).alias("group"))
    every = F.array_sort(F.collect_list(F.struct("layer", "group")))
    size = [F.min_by(c, "layer").alias(c) for c in ("width", "height", "width_mm", "height_mm")]
    out = own.groupBy("image_id").agg(F.array_join(F.transform(every, lambda g: g["group"]), "").alias("groups"), *size)
    head = F.format_string(HEADER, number(F.col("width_mm")), number(F.col("height_mm")), F.col("width").cast("int"), F.col("height").cast("int"))
    return out.select("image_id", F.concat(head, "groups", marks_svg(F.col("width"), F.col("height")) if marks else F.lit(""), F.lit("</svg>\n")).alias("svg"))


def export_layers(svgs: DataFrame, path: str, overwrite: bool = True) -> None:
    """Writes ``layer_svg`` rows as files ``<image_id>/layer-N.svg``."""
    from pixelweave.sources.files import write_files

    name = F.concat(_folder("image_id"), F.lit("/layer-"), F.col("layer") + 1, F.lit(".svg"))
    write_files(svgs.select(name.alias("name"), F.col("svg").alias("content")), path, overwrite)


def export_zips(zips: DataFrame, path: str, overwrite: bool = True) -> None:
    """Writes ``zipped`` rows as files ``<image_id>.zip``."""
    from pixelweave.sources.files import write_files

    write_files(zips.select(F.concat(_folder("image_id"), F.lit(".zip")).alias("name"), "content"), path, overwrite)


def _folder(column: str) -> Column:
    """A name without folders for an id: all but plain letters, digits, dots and dashes percent-encoded; null is ``null``."""
    encoded = F.url_encode(F.coalesce(F.col(column).cast("string"), F.lit("null")))
    return F.regexp_replace(F.regexp_replace(encoded, r"^\.", "%2E"), "^_", "%5F")


def zipped(svgs: DataFrame) -> DataFrame:
    """A row for each image: its layers' files ``layer-N.svg`` as one ZIP (``content``), the same bytes each time."""

    def run(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            files = []
            for layers in batch["layers"].to_pylist():
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    for row in layers:
                        z.writestr(zipfile.ZipInfo(f"layer-{row['layer'] + 1}.svg"), row["svg"])
                files.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([batch["image_id"], pa.array(files, pa.binary())], names=["image_id", "content"])

    every = svgs.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("layer", "svg"))).alias("layers"))
    return every.mapInArrow(run, f"image_id {svgs.schema['image_id'].dataType.simpleString()}, content binary")


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = x2 - x1, y2 - y1
    long_ = dx * dx + dy * dy
    t = F.when(long_ > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / F.when(long_ > 0, long_)))).otherwise(0.0)
    return F.hypot(x - (x1 + t * dx), y - (y1 + t * dy))


def path_text(segments: Column) -> Column:
    """SVG path of an array of segments (type, x1, y1, x2, y2, x3, y3; the last two null for lines)."""
    start = F.concat(F.lit("M "), number(segments[0]["x1"]), F.lit(" "), number(segments[0]["y1"]), F.lit(" "))
    third = lambda s: F.when(s["x3"].isNotNull(), F.concat(number(s["x3"]), F.lit(" "), number(s["y3"]), F.lit(" "))).otherwise("")
    each = F.transform(segments, lambda s: F.concat(s["type"], F.lit(" "), number(s["x2"]), F.lit(" "), number(s["y2"]), F.lit(" "), third(s)))
    return F.when(F.size(segments) > 0, F.concat(start, F.array_join(each, ""), F.lit("Z"))).otherwise("")


def mask_image(mask: DataFrame) -> DataFrame:
    """``mask`` as pixels: open is black, material white, all of them opaque."""
    v = F.when(F.col("open") == 1, 0).otherwise(255)
    return mask.withColumns({"r": v, "g": v, "b": v, "a": F.lit(255)})


def blank(rows: DataFrame, open_: int = 0) -> DataFrame:
    """A mask of one value for each of rows (image_id, width, height)."""
    cells = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("width").cast("int") * F.col("height").cast("int") - 1)))
    return cells.select("image_id", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), F.lit(open_).alias("open"))
