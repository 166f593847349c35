"""Rasters as dense grids, for what needs a whole raster: floods, searches, and filters of many neighbours.

Rasters of bytes may also come packed: a row for each raster, with its ``height``, ``width`` and a binary
column for each channel, row by row. Packed rasters need no shuffle and no group of their own: tasks take
them in stacks of one shape, as many as :data:`AT_ONCE` cells, and work on a whole stack.

A raster (of one layer, where rows have one) is one Arrow group and one task; the source's pixel limit
bounds it. Grids hold 32-bit integers. Rows without a place keep their row and get no result; a null
value counts as 0; where a place is repeated the greatest value counts, and its rows get equal results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keys(rows: DataFrame) -> list[str]:
    return ["image_id", *(["layer"] if "layer" in rows.columns else [])]


def dense(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The raster, the rows' places in it, and which rows have one."""
    placed = np.asarray(pc.and_(table["y"].is_valid(), table["x"].is_valid()))
    y, x = (np.asarray(pc.fill_null(table[c], 0)).astype(np.int32) for c in ("y", "x"))
    value = np.asarray(pc.fill_null(table[column], 0)).astype(np.int32)
    y, x = np.where(placed, y, 0), np.where(placed, x, 0)
    if not placed.any():
        return np.zeros((0, 0), np.int32), y, x, placed
    grid = np.full((int(y.max()) + 1, int(x.max()) + 1), np.iinfo(np.int32).min, np.int32)
    np.maximum.at(grid, (y[placed], x[placed]), value[placed])
    grid[grid == np.iinfo(np.int32).min] = 0
    return grid, y, x, placed


def each(rows: DataFrame, value: str, result: str, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``rows`` with column ``result`` (int), which ``kernel`` makes of each raster of column ``value``."""

    def run(table: pa.Table) -> pa.Table:
        grid, y, x, placed = dense(table, value)
        made = kernel(grid)[y, x] if placed.any() else np.zeros(len(y), np.int32)
        own = pa.array(made.astype(np.int32), pa.int32(), mask=~placed)
        return table.set_column(table.column_names.index(result), result, own) if result in table.column_names else table.append_column(result, own)

    base = rows.withColumn(result, F.col(result).cast("int")) if result in rows.columns else rows
    schema = base.schema if result in base.columns else base.withColumn(result, F.lit(0)).schema
    return base.groupBy(*keys(base)).applyInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]))


#: Cells of a stack; a larger raster is a stack of its own.
AT_ONCE = 1 << 18


def is_packed(rows: DataFrame, channel: str) -> bool:
    return isinstance(rows.schema[channel].dataType, T.BinaryType)


def packed(pixels: DataFrame, *channels: str) -> DataFrame:
    """Rows for each pixel as a row for each raster: keys, height, width, channels (0 to 255). Rows without a place go."""
    own = keys(pixels)

    def run(table: pa.Table) -> pa.Table:
        made = [dense(table, c)[0] for c in channels]
        if any(((m < 0) | (m > 255)).any() for m in made):
            raise ValueError("packed rasters hold values from 0 to 255")
        h, w = made[0].shape
        return pa.table({c: table[c].slice(0, 1) for c in own} | {"height": pa.array([h], pa.int32()), "width": pa.array([w], pa.int32())} | {c: column(m[None]) for c, m in zip(channels, made)})

    rows = pixels.filter("y >= 0 and x >= 0").select(*own, "y", "x", *channels)
    return rows.groupBy(*own).applyInArrow(run, schema_of(pixels, own, channels))


def schema_of(rows: DataFrame, held: list[str], channels: tuple[str, ...] | list[str]) -> T.StructType:
    return T.StructType([*[rows.schema[c] for c in held], *[T.StructField(c, T.IntegerType()) for c in ("height", "width")], *[T.StructField(c, T.BinaryType()) for c in channels]])


def column(stack: np.ndarray) -> pa.Array:
    """A stack of rasters as a binary column."""
    n = len(stack)
    ends = (np.arange(n + 1) * (stack[0].size if n else 0)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(stack, np.uint8).tobytes())])


def _bytes(values: pa.Array) -> np.ndarray:
    """The bytes of a binary column, one value after the other."""
    if not len(values) or not values.buffers()[2]:
        return np.zeros(0, np.uint8)
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[ends[0] : ends[-1]]


def stacks(batch: pa.RecordBatch, channels: tuple[str, ...] | list[str], also: tuple[str, ...] = (), at_once: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The rows of a batch in parts of one shape, and one value of the columns ``also``, and each part's channels as arrays of (rasters, height, width)."""
    if not batch.num_rows:
        return
    own = np.stack([np.asarray(batch[c]) for c in ("height", "width", *also)])
    if (own != own[:, :1]).any():
        order = np.lexsort(own[::-1])
        batch, own = batch.take(pa.array(order)), own[:, order]
    begin = np.flatnonzero(np.append(True, (np.diff(own) != 0).any(0))).tolist()
    for a, b in zip(begin, [*begin[1:], batch.num_rows]):
        high, wide = own[:2, a].tolist()
        step = max(1, (at_once or AT_ONCE) // max(1, high * wide))
        for i in range(a, b, step):
            part = batch.slice(i, min(step, b - i))
            yield part, [_bytes(part[c]).reshape(-1, high, wide) if high * wide else np.zeros((part.num_rows, high, wide), np.uint8) for c in channels]


def mapped(rows: DataFrame, takes: tuple[str, ...], gives: tuple[str, ...], kernel: Callable[..., tuple[np.ndarray, ...]]) -> DataFrame:
    """Packed ``rows`` with the channels ``gives``, which ``kernel`` makes of stacks of the channels ``takes``; other channels go, other columns stay."""
    held = [f.name for f in rows.schema.fields if f.name not in ("height", "width") and not isinstance(f.dataType, T.BinaryType)]

    def run(batches):
        for batch in batches:
            for part, arrays in stacks(batch, takes):
                made = kernel(*arrays)
                yield pa.RecordBatch.from_arrays([part[c] for c in (*held, "height", "width")] + [column(m) for m in made], names=[*held, "height", "width", *gives])

    return rows.mapInArrow(run, schema_of(rows, held, gives))


def pixels(rows: DataFrame, *channels: str, kind: str = "int", size: bool = False) -> DataFrame:
    """A row for each pixel of packed ``rows``: keys, (width, height where ``size``,) y, x and the channels."""
    own = keys(rows)
    to = pa.int32() if kind == "int" else pa.int16()

    def run(batches):
        for batch in batches:
            h, w = (np.asarray(batch[c]).astype(np.int64) for c in ("height", "width"))
            ends = np.cumsum(h * w)
            total = int(ends[-1]) if len(ends) else 0
            flat = [_bytes(batch[c]) for c in channels]
            for a in range(0, total, AT_ONCE):
                at = np.arange(a, min(total, a + AT_ONCE))
                raster = np.searchsorted(ends, at, "right")
                y, x = np.divmod(at - (ends - h * w)[raster], w[raster])
                held = [batch[c].take(pa.array(raster)) for c in own]
                extent = [pa.array(v[raster].astype(np.int32)) for v in (w, h)] if size else []
                yield pa.RecordBatch.from_arrays([*held, *extent, pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), *(pa.array(f[a : a + AT_ONCE]).cast(to) for f in flat)], names=names)

    extent = ["width", "height"] if size else []
    names = [*own, *extent, "y", "x", *channels]
    fields = [*[rows.schema[c] for c in own], *[T.StructField(c, T.IntegerType()) for c in (*extent, "y", "x")], *[T.StructField(c, T.IntegerType() if kind == "int" else T.ShortType()) for c in channels]]
    return rows.mapInArrow(run, T.StructType(fields))
