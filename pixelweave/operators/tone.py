"""Tone mapping: gray from colour, flips, flat test, local contrast, edge-preserving smoothing, edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.functions.numbers import byte
from pixelweave.operators import morphology
from pixelweave.operators.grids import each, is_packed, mapped

BRIGHT = 210
# fixed values: radius of smoothing by level, and its range
SMOOTH_RADIUS = (0, 4, 6, 8)
SMOOTH_RANGE = 40.0


def gray(pixels: DataFrame, contrast: float = 0, brightness: float = 0, invert: bool = False) -> DataFrame:
    """``pixels`` with ``lum``: weighted channels, contrast about the middle, brightness, inversion."""
    factor = 259 * (contrast + 255) / (255 * (259 - contrast))
    lum = F.lit(factor) * ((0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")) - 128) + 128 + brightness
    return pixels.withColumn("lum", byte(255 - lum if invert else lum))


def flip(pixels: DataFrame, width: int | Column, horizontal: bool = True) -> DataFrame:
    axis = "x" if horizontal else "y"
    return pixels.withColumn(axis, (F.lit(width) if isinstance(width, int) else width) - 1 - F.col(axis))


def flat(pixels: DataFrame) -> DataFrame:
    """Whether an image's tones span less than four levels."""
    return pixels.groupBy("image_id").agg((F.max("lum") - F.min("lum") < 4).alias("flat"))


def bright(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("bright", (F.col("lum") >= BRIGHT).cast("int"))


def clahe(pixels: DataFrame, tiles: int = 8, clip: float = 2.5) -> DataFrame:
    """Contrast-limited local equalisation: clipped histograms of tiles, blended between tile centres."""
    return each(pixels, "lum", "lum", lambda grid: equalised(grid, tiles, clip))


def equalised(grid: np.ndarray, tiles: int, clip: float, at_once: int = 1 << 20) -> np.ndarray:
    """Of rasters (…, height, width), so many at a time that their tiles have ``at_once`` levels."""
    h, w = grid.shape[-2:]
    tw, th = max(1, -(-w // tiles)), max(1, -(-h // tiles))
    nx, ny = -(-w // tw), -(-h // th)
    stack, out, of = grid.reshape(-1, h, w), np.empty((*grid.shape,), np.int32), nx * ny * 256
    step = max(1, at_once // max(1, of))
    if len(stack) > step:
        for i in range(0, len(stack), step):
            out.reshape(-1, h, w)[i : i + step] = equalised(stack[i : i + step], tiles, clip)
        return out
    tile = (np.arange(h) // th)[:, None] * nx + (np.arange(w) // tw)[None]
    first = np.arange(len(stack))[:, None] * of
    counts = np.bincount((first[..., None] + tile * 256 + stack).ravel(), minlength=len(stack) * of).reshape(-1, 256)
    size = np.tile(np.bincount(tile.ravel(), minlength=nx * ny), len(stack))
    held = np.minimum(counts, np.maximum(1, np.floor(clip * size / 256)).astype(np.int64)[:, None])
    total = held.sum(1)
    extra = (size - total) // 256
    upto, scale = held.cumsum(1).ravel(), 255 / (total + 256 * extra)

    def between(size: int, step: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(size) + 0.5) / step - 0.5
        low = np.floor(at).astype(np.int64)
        share = np.where(low < 0, 0.0, at - low)
        low = np.maximum(low, 0)
        return np.minimum(low, n - 1), np.minimum(n - 1, low + 1), share

    def to(row: int, col: np.ndarray, level: np.ndarray) -> np.ndarray:
        at = first + (row * nx + col) * 256 + level
        return np.minimum(255, np.floor((upto[at] + extra[at >> 8] * (level + 1)) * scale[at >> 8] + 0.5))

    (y0, y1, wy), (x0, x1, wx) = between(h, th, ny), between(w, tw, nx)
    made = out.reshape(-1, h, w)
    for i in range(h):  # a row at a time, so that the blend needs little memory
        level = stack[:, i].astype(np.int64)
        a, b, c, d = (to(r, col, level) for r in (y0[i], y1[i]) for col in (x0, x1))
        top, low = a + (b - a) * wx, c + (d - c) * wx
        made[:, i] = np.clip(np.rint(top + (low - top) * wy[i]), 0, 255)
    return out


def bilateral(pixels: DataFrame, radius: int, sigma_range: float = 32.0, sigma_space: float | None = None) -> DataFrame:
    """Mean of the neighbours inside the raster, weighted by distance and difference."""
    return each(pixels, "lum", "lum", lambda grid: smoothed(grid, radius, sigma_range, sigma_space or radius / 1.5)) if radius > 0 else pixels


def smoothed(grid: np.ndarray, radius: int, sigma_range: float, sigma_space: float, at_once: int = 1 << 16) -> np.ndarray:
    """Of rasters (…, height, width), so many rows at a time that they hold ``at_once`` pixels; neighbours are added up in row order."""
    h, w = grid.shape[-2:]
    stack, out = grid.reshape(-1, h, w).astype(np.int16), np.empty(grid.shape, np.int32)
    near = np.exp(-(np.arange(256.0) ** 2) / (2 * sigma_range * sigma_range)).astype(np.float32).astype(float)
    near = near[abs(np.arange(-255, 256))]
    d = np.arange(-radius, radius + 1)
    space = np.exp(-(d[:, None] ** 2 + d[None] ** 2) / (2 * sigma_space * sigma_space)).astype(np.float32).astype(float)
    rows = max(1, at_once // max(1, w))
    step = max(1, at_once // max(1, w * min(h, rows)))
    for i in range(0, len(stack), step):
        some, made = stack[i : i + step], out.reshape(-1, h, w)[i : i + step]
        for y in range(0, h, rows):
            own = some[:, y : y + rows]
            share, value = np.zeros(own.shape), np.zeros(own.shape)
            for j, dy in enumerate(d.tolist()):
                a, b = max(0, -dy - y), min(own.shape[1], h - dy - y)
                for k, dx in enumerate(d.tolist()):
                    left, right = max(0, -dx), min(w, w - dx)
                    if a >= b or left >= right:
                        continue
                    there = some[:, y + a + dy : y + b + dy, left + dx : right + dx]
                    weight = near[there - own[:, a:b, left:right] + 255]
                    weight *= space[j, k]
                    share[:, a:b, left:right] += weight
                    weight *= there
                    value[:, a:b, left:right] += weight
            made[:, y : y + rows] = np.clip(np.rint(value / share), 0, 255)
    return out


def weighed(r: np.ndarray, g: np.ndarray, b: np.ndarray, contrast: float | np.ndarray = 0, brightness: float | np.ndarray = 0, invert: bool | np.ndarray = False) -> np.ndarray:
    """:func:`gray` of rasters (…, height, width); the values may be arrays with one for each raster."""
    contrast, brightness, invert = (v[:, None, None] if np.ndim(v) else v for v in (contrast, brightness, invert))
    factor = 259 * (contrast + 255) / (255 * (259 - contrast))
    lum = factor * ((0.2126 * r + 0.7152 * g + 0.0722 * b) - 128) + 128 + brightness
    return np.clip(np.rint(np.where(invert, 255 - lum, lum)), 0, 255).astype(np.int32)


def grayed(r: np.ndarray, g: np.ndarray, b: np.ndarray, contrast: float = 0, brightness: float = 0, invert: bool = False, smooth: int = 0, auto_levels: bool = True, mirror: bool = False, vflip: bool = False) -> np.ndarray:
    """:func:`prepared_gray` of rasters (…, height, width)."""
    lum = weighed(r, g, b, contrast, brightness, invert)
    radius = SMOOTH_RADIUS[smooth]
    lum = smoothed(lum, radius, SMOOTH_RANGE, radius / 1.5) if radius else lum
    lum = equalised(lum, 8, 2.5) if auto_levels else lum
    return lum[..., :: -1 if vflip else 1, :: -1 if mirror else 1]


def prepared_gray(pixels: DataFrame, width: int | Column, height: int | Column, contrast: float = 0, brightness: float = 0, invert: bool = False, smooth: int = 0, auto_levels: bool = True, mirror: bool = False, vflip: bool = False) -> DataFrame:
    """``lum`` by every step of the intake, in its order: gray, smoothing, local contrast, then the flips; packed rasters in one pass."""
    if is_packed(pixels, "r"):
        return mapped(pixels, ("r", "g", "b"), ("lum",), lambda r, g, b: (grayed(r, g, b, contrast, brightness, invert, smooth, auto_levels, mirror, vflip),))
    out = gray(pixels, contrast, brightness, invert)
    out = bilateral(out, SMOOTH_RADIUS[smooth], SMOOTH_RANGE)
    out = clahe(out) if auto_levels else out
    out = flip(out, width) if mirror else out
    return flip(out, height, horizontal=False) if vflip else out


def lines(stack: np.ndarray, beyond: float) -> np.ndarray:
    """Where the Sobel gradient of rasters (…, height, width) is beyond a threshold; nowhere along the border."""
    p = stack.astype(np.int32)
    out = np.zeros(p.shape, np.uint8)
    if min(p.shape[-2:]) > 2:
        across = p[..., 2:] - p[..., :-2]
        gx = across[..., :-2, :] + 2 * across[..., 1:-1, :] + across[..., 2:, :]
        down = p[..., 2:, :] - p[..., :-2, :]
        gy = down[..., :-2] + 2 * down[..., 1:-1] + down[..., 2:]
        out[..., 1:-1, 1:-1] = abs(gx) + abs(gy) > beyond
    return out


def edges(pixels: DataFrame, amount: float = 55, thicken: int = 0) -> DataFrame:
    """``open``: Sobel gradient beyond a threshold, inside the raster only; lines are thickened by ``thicken`` pixels."""
    beyond = (100 - min(100, max(0, amount))) * 4 + 20
    if is_packed(pixels, "lum"):
        return morphology.dilate(mapped(pixels, ("lum",), ("open",), lambda lum: (lines(lum, beyond),)), thicken)
    row, col = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    lum = F.col("lum")
    part = pixels.withColumns({"dx": F.lead(lum).over(row) - F.lag(lum).over(row), "sx": F.lag(lum).over(row) + 2 * lum + F.lead(lum).over(row)})
    gx = F.lag("dx").over(col) + 2 * F.col("dx") + F.lead("dx").over(col)
    gy = F.lead("sx").over(col) - F.lag("sx").over(col)
    return morphology.dilate(part.select("image_id", "y", "x", F.coalesce((F.abs(gx) + F.abs(gy) > beyond).cast("int"), F.lit(0)).alias("open")), thicken)
