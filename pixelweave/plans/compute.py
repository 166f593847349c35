"""The whole flow from colour pixels to cut files: gray, thresholds, layers, ties burnt, outlines, SVG.

Each step is a plan over rows; a raster is a group of its own only where floods and searches need it.
The layers feed several results, so persist or write them where more than one is taken.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.operators import bridges, contours, layout, tone
from pixelweave.operators.bridges import Build
from pixelweave.operators.grids import is_packed


@dataclass(frozen=True)
class Look:
    """How colour becomes gray, and the number of layers; ``build`` says how layers are made."""

    layers: int = 2
    contrast: float = 0
    brightness: float = 0
    invert: bool = False
    smooth: int = 0
    auto_levels: bool = True
    mirror: bool = False
    vflip: bool = False
    build: Build = field(default_factory=Build)


def gray(pixels: DataFrame, width: int | Column, height: int | Column, look: Look) -> DataFrame:
    """Gray pixels, packed where ``pixels`` are; contrast and brightness are controls from -100 to 100."""
    out = tone.prepared_gray(pixels, width, height, look.contrast * 2, look.brightness * 1.2, look.invert, look.smooth, look.auto_levels, look.mirror, look.vflip)
    return out if is_packed(out, "lum") else out.select("image_id", "y", "x", "lum")


def layers(gray_pixels: DataFrame, look: Look, levels: DataFrame | None = None) -> DataFrame:
    """Layers with ties (:func:`bridges.build_layers`); ``levels(image_id, thresholds)`` are found unless given."""
    return bridges.build_layers(gray_pixels, levels if levels is not None else look.layers, look.build)


def work_masks(built: DataFrame) -> DataFrame:
    """image_id, layer, is_edge, y, x, ``open`` with the ties burnt; of layers with a row for each line."""
    return bridges.layer_pixels(built, "work")


def outlines(built: DataFrame, tolerance: float = 0.0, omit: float = 0.0) -> DataFrame:
    """Outlines of the finished layers; those shorter than ``omit`` go, and corners within ``tolerance``."""
    loops = contours.contours(bridges.open_cells(built) if "y" in built.columns else built.select("image_id", "layer", "height", "width", F.col("work").alias("open")))
    return loops if tolerance <= 0 and omit <= 0 else contours.simplify(loops, tolerance, omit)


def sheets(built: DataFrame, target_mm: float, colors: DataFrame | None = None) -> DataFrame:
    """A row for each layer: image_id, layer, width, height, width_mm, height_mm and ``fill`` (of ``colors(image_id, layer, fill)``, else black)."""
    one = built.filter("y = 0") if "y" in built.columns else built  # packed layers have a row each
    path = ["d"] if "d" in built.columns else []
    out = one.select("image_id", "layer", "width", "height", F.lit(float(target_mm)).alias("width_mm"), (F.lit(float(target_mm)) / F.col("width") * F.col("height")).alias("height_mm"), *path)
    if colors is None:
        return out.withColumn("fill", F.lit("#111111"))
    return out.join(colors.select("image_id", "layer", "fill"), ["image_id", "layer"], "left")


def cut_files(built: DataFrame, target_mm: float, marks: bool = False, colors: DataFrame | None = None, tolerance: float = 0.0, omit: float = 0.0) -> DataFrame:
    """One SVG for each image and layer; packed layers are drawn where they are."""
    if "y" not in built.columns:
        return layout.drawn_svg(sheets(contours.drawn(built, "work", tolerance, omit), target_mm, colors), marks)
    return layout.layer_svg(contours.contour_paths(outlines(built, tolerance, omit)), sheets(built, target_mm, colors), marks)


def proofs(built: DataFrame, target_mm: float, marks: bool = False, colors: DataFrame | None = None, tolerance: float = 0.0, omit: float = 0.0) -> DataFrame:
    """One SVG for each image, all layers stacked."""
    return layout.combined_svg(contours.contour_paths(outlines(built, tolerance, omit)), sheets(built, target_mm, colors), marks)
