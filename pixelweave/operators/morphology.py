"""Binary morphology on masks(image_id, y, x, open): box windows by row, then by column; packed masks in stacks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.operators.grids import is_packed, mapped


def boxed(stack: np.ndarray, r: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest value about each cell of (…, height, width), by row, then by column."""
    for axis in (-1, -2):
        line = np.moveaxis(stack, axis, -1)
        out = line.copy()
        for d in range(1, min(r, line.shape[-1] - 1) + 1):
            pick(out[..., d:], line[..., :-d], out=out[..., d:])
            pick(out[..., :-d], line[..., d:], out=out[..., :-d])
        stack = np.moveaxis(out, -1, axis)
    return stack


def shrunk(stack: np.ndarray, r: int) -> np.ndarray:
    """What lies outside is material, so the border erodes."""
    least, out = boxed(stack, r, np.minimum), np.zeros_like(stack)
    inner = (..., slice(r, max(r, stack.shape[-2] - r)), slice(r, max(r, stack.shape[-1] - r)))
    out[inner] = least[inner]
    return out


def _packed(mask: DataFrame, kernel) -> DataFrame:
    return mapped(mask, ("open",), ("open",), lambda grid: (kernel(grid),))


def _box(mask: DataFrame, r: int, pick) -> DataFrame:
    row = Window.partitionBy("image_id", "y").orderBy("x").rangeBetween(-r, r)
    col = Window.partitionBy("image_id", "x").orderBy("y").rangeBetween(-r, r)
    return mask.withColumn("open", pick("open").over(row)).withColumn("open", pick("open").over(col))


def dilate(mask: DataFrame, r: int = 1) -> DataFrame:
    if r <= 0:
        return mask
    return _packed(mask, lambda grid: boxed(grid, r, np.maximum)) if is_packed(mask, "open") else _box(mask, r, F.max)


def erode(mask: DataFrame, width: int, height: int, r: int = 1) -> DataFrame:
    """What lies outside is material, so the border erodes."""
    if r <= 0:
        return mask
    if is_packed(mask, "open"):
        return _packed(mask, lambda grid: shrunk(grid, r))
    inside = F.col("x").between(r, width - r - 1) & F.col("y").between(r, height - r - 1)
    return _box(mask, r, F.min).withColumn("open", F.when(inside, F.col("open")).otherwise(0))


def opened(mask: DataFrame, width: int, height: int, r: int = 1) -> DataFrame:
    return dilate(erode(mask, width, height, r), r)


def closed(mask: DataFrame, width: int, height: int, r: int = 1) -> DataFrame:
    return erode(dilate(mask, r), width, height, r)


def frame(mask: DataFrame, width: int, height: int, px: int) -> DataFrame:
    b = min(px, min(width, height) // 2)
    edge = (F.col("x") < b) | (F.col("y") < b) | (F.col("x") >= width - b) | (F.col("y") >= height - b)
    return mask.withColumn("open", F.when(edge, 0).otherwise(F.col("open")))


def border(width: int, height: int) -> Column:
    return (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == width - 1) | (F.col("y") == height - 1)
