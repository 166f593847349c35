"""Rasters at another size: each pixel is the mean of what it covers, by whole-number overlaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweave.functions.numbers import half_up
from pixelweave.operators.grids import column, is_packed, schema_of, stacks


def fitted(most: Column | int) -> tuple[Column, Column]:
    """Width and height clamped to a long edge, of columns width and height."""
    share = F.least(F.lit(1.0), most / F.greatest("width", "height"))
    return tuple(F.greatest(F.lit(1), half_up(F.col(c) * share)).cast("int") for c in ("width", "height"))


def along(values: np.ndarray, new: int) -> np.ndarray:
    """Sums of whole numbers (…, old) by overlap at a new length: differences of running sums at the new ends."""
    upto = np.zeros((*values.shape[:-1], values.shape[-1] + 1), np.int64)
    np.cumsum(values, axis=-1, out=upto[..., 1:])
    at, rest = np.divmod(np.arange(new + 1) * values.shape[-1], new)
    part = values[..., np.minimum(at, values.shape[-1] - 1)] * rest  # nothing is left at the last end
    return np.diff(upto[..., at] * new + part)


def resized(stack: np.ndarray, width: int, height: int) -> np.ndarray:
    """Rasters (…, height, width) at a new size."""
    h, w = stack.shape[-2:]
    if (width, height) == (w, h):
        return stack
    sums = along(along(stack.astype(np.int64), width).swapaxes(-1, -2), height).swapaxes(-1, -2)
    return (2 * sums + w * h) // (2 * w * h)


def _resized(rows: DataFrame, width: Column, height: Column, channels: tuple[str, ...]) -> DataFrame:
    own = [f.name for f in rows.schema.fields if f.name not in ("height", "width") and not isinstance(f.dataType, T.BinaryType)]

    def run(batches):
        for batch in batches:
            made = []
            for part, arrays in stacks(batch, channels, ("nw", "nh")):
                w, h = part["nw"][0].as_py(), part["nh"][0].as_py()
                size = [pa.array(np.full(part.num_rows, v, np.int32)) for v in (h, w)]
                made.append(pa.RecordBatch.from_arrays([*(part[c] for c in own), *size, *(column(c) for c in resized(np.stack(arrays), w, h))], names=[*own, "height", "width", *channels]))
            if made:  # few rasters have one size, so many sizes make a batch
                yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    base = rows.withColumns({"nw": width.cast("int"), "nh": height.cast("int")}).filter("nw >= 1 and nh >= 1 and width >= 1 and height >= 1")
    return base.mapInArrow(run, schema_of(rows, own, channels))


def resize_area(pixels: DataFrame, width: Column | int, height: Column | int, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Rows (image_id, width, height, y, x, channels…) at a new size, which may differ from image to image.

    Both sizes cut an axis of ``width * new width`` units into whole numbers of units, so the overlap
    of an old pixel and a new one is a whole number, sums are exact, and a value is its mean, halves
    up. Along a row first, then along a column; each step adds up overlaps of neighbours within
    partial sums. Images that keep their size pass by. Rows without a place, size or new size go,
    as do other columns; where a place is repeated, its rows count together. A null value counts as 0.
    Packed rasters stay packed and keep other columns.
    """
    number = lambda v: F.lit(v) if isinstance(v, int) else v
    if is_packed(pixels, channels[0]):
        return _resized(pixels, number(width), number(height), channels)
    base = pixels.select("image_id", *[F.col(c).cast("long") for c in ("width", "height", "y", "x")], *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in channels], number(width).cast("long").alias("nw"), number(height).cast("long").alias("nh"))
    base = base.filter("nw >= 1 and nh >= 1 and x >= 0 and x < width and y >= 0 and y < height")
    same = (F.col("nw") == F.col("width")) & (F.col("nh") == F.col("height"))
    named = lambda df: df.select("image_id", F.col("nw").cast("int").alias("width"), F.col("nh").cast("int").alias("height"), F.col("y").cast("int"), F.col("x").cast("int"), *[F.col(c).cast("int") for c in channels])

    def step(rows: DataFrame, at: str, old: str, new: str) -> DataFrame:
        own = ["image_id", "width", "height", "nw", "nh", "y" if at == "x" else "x"]
        to = rows.withColumn("to", F.explode(F.expr(f"sequence({at} * {new} div {old}, (({at} + 1) * {new} - 1) div {old})")))
        overlap = F.expr(f"least(({at} + 1) * {new}, (to + 1) * {old}) - greatest({at} * {new}, to * {old})")
        return to.groupBy(*own, "to").agg(*[F.sum(F.col(c) * overlap).alias(c) for c in channels]).withColumnRenamed("to", at)

    made = step(step(base.filter(~same), "x", "width", "nw"), "y", "height", "nh")
    made = made.withColumns({c: F.expr(f"(2 * {c} + width * height) div (2 * width * height)") for c in channels})
    return named(base.filter(same)).union(named(made))
