"""Connected components of masks, speckles and islands.

``components`` and what flips cells label a raster in one task, which keeps all columns of its rows.
``components_by_tile``, ``islands_by_tile`` and ``count_by_tile`` need no task that holds a raster: tiles are
labelled apart and packed, a row for each; the rows of labels along their sides tell which parts
belong together (:func:`~pixelweave.functions.lineage.joined_lows`), and sizes and sums are added up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweave.functions.lineage import checkpointed, joined_lows
from pixelweave.operators.grids import dense, each, keys

#: Cells of a tile's side.
TILE = 1024


def labelled(grid: np.ndarray, value: int) -> np.ndarray:
    """4-connected components of the cells that equal ``value``, numbered from 1 by their first cell in row order; 0 elsewhere.

    Those of a stack (rasters, height, width) are numbered on from raster to raster; see :func:`own_numbers`.
    """
    if grid.ndim == 3:
        n, h, w = grid.shape
        tall = np.zeros((n, h + 1, w), np.bool_)  # a line between rasters keeps them apart
        tall[:, :h] = grid == value
        return labelled(tall.reshape(-1, w), True).reshape(n, h + 1, w)[:, :h]
    h, w = grid.shape
    if not h * w:
        return np.zeros((h, w), np.int64)
    inside = grid == value
    # runs of a row are nodes; a run and one of the row below that overlaps it are joined
    first, last = inside.copy(), inside.copy()
    first[:, 1:] &= ~inside[:, :-1]
    last[:, :-1] &= ~inside[:, 1:]
    run = np.cumsum(first.ravel()).reshape(h, w) - 1  # of each cell inside
    both = inside[:-1] & inside[1:]
    both[:, 1:] &= ~(both[:, :-1] & inside[:-1, 1:] & inside[1:, 1:])  # once for each overlap
    a, b = run[:-1][both], run[1:][both]
    root = np.arange(int(first.sum()))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while ((up := root[root]) < root).any():
            root = up
    # a component's least run holds its first cell in row order
    number = np.cumsum(root == np.arange(len(root)))
    out = np.zeros((h, w), np.int64)
    out[inside] = number[root[run[inside]]]
    return out


def own_numbers(label: np.ndarray) -> np.ndarray:
    """Labels of a stack, which run on from raster to raster, numbered in each raster from 1."""
    before = np.append(0, np.maximum.accumulate(label.reshape(len(label), -1).max(1, initial=0)))[:-1]
    return np.where(label > 0, label - before[:, None, None], 0)


def rasters_of(label: np.ndarray) -> np.ndarray:
    """Of each label of a stack the raster that it lies in."""
    ends = np.maximum.accumulate(label.reshape(len(label), -1).max(1, initial=0))
    return np.searchsorted(ends, np.arange(int(ends[-1])) + 1) if len(label) else np.zeros(0, np.int64)


def components(mask: DataFrame, value: int = 1) -> DataFrame:
    """``mask`` with ``label``."""
    return each(mask, "open", "label", lambda grid: labelled(grid, value))


def sizes(labels: DataFrame) -> DataFrame:
    return labels.filter("label > 0").groupBy(*keys(labels), "label").agg(F.count("*").alias("size"))


def without_small(grid: np.ndarray, value: int, least: float | np.ndarray) -> np.ndarray:
    """``grid`` with components of less than ``least`` cells flipped; a stack may have a least size for each raster."""
    if not np.size(least) or np.max(least) <= 1:
        return grid
    label = labelled(grid, value)
    size = np.bincount(label.ravel())
    small = np.append(False, size[1:] < (least[rasters_of(label)] if np.ndim(least) else least))
    return np.where(small[label], 1 - value, grid)


def despeckled(grid: np.ndarray, least: float | np.ndarray) -> np.ndarray:
    return without_small(without_small(grid, 1, least), 0, least)


def remove_small(mask: DataFrame, value: int, least: int) -> DataFrame:
    return each(mask, "open", "open", lambda grid: without_small(grid, value, least))


def despeckle(mask: DataFrame, least: int) -> DataFrame:
    """Small open components are closed, then small material ones opened."""
    return each(mask, "open", "open", lambda grid: despeckled(grid, least))


def island_labels(grid: np.ndarray) -> np.ndarray:
    """Material components that touch no border, numbered anew; those of a stack on from raster to raster."""
    label = labelled(grid, 0)
    if not label.size:
        return label
    inner = np.ones(int(label.max()) + 1, np.int64)
    inner[0] = 0
    for edge in (label[..., 0, :], label[..., -1, :], label[..., 0], label[..., -1]):
        inner[edge] = 0
    return (np.cumsum(inner) * inner)[label]


PARTS = ("first", "size", "sum_y", "sum_x", "y1", "y2", "x1", "x2")


def tiles(mask: DataFrame, value: int, tile: int = TILE) -> DataFrame:
    """A row for each tile of each mask: its labels, and of each label its first cell, size, sums and extent.

    Columns: the mask's keys, ty, tx, ``labels`` (32-bit, row by row, ``w`` to a row), the labels of its
    four sides, and an array for each of ``PARTS``. A first cell is y << 32 | x, and so unique in its
    raster. Rows without a place go; of repeated places the greatest value counts.
    """
    own = keys(mask)
    rows = mask.filter("y >= 0 and x >= 0").select(*own, F.col("y").cast("int"), F.col("x").cast("int"), F.coalesce(F.col("open"), F.lit(0)).cast("int").alias("open"))
    rows = rows.withColumns({"ty": F.expr(f"y div {tile}").cast("int"), "tx": F.expr(f"x div {tile}").cast("int")})
    fields = [mask.schema[c] for c in own] + [T.StructField(c, T.IntegerType()) for c in ("ty", "tx", "w")] + [T.StructField("labels", T.BinaryType())]
    fields += [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("north", "south", "west", "east")] + [T.StructField(c, T.ArrayType(T.LongType())) for c in PARTS]

    def run(table: pa.Table) -> pa.Table:
        ty, tx = table["ty"][0].as_py() * tile, table["tx"][0].as_py() * tile
        moved = table.set_column(table.column_names.index("y"), "y", pa.array(table["y"].to_numpy() - ty)).set_column(table.column_names.index("x"), "x", pa.array(table["x"].to_numpy() - tx))
        grid, y, x, _ = dense(moved, "open")
        there = np.zeros(grid.shape, np.bool_)  # what has no row is neither open nor material
        there[y, x] = True
        label = labelled(np.where(there, grid, value + 1), value)
        n, (ys, xs) = int(label.max()), np.nonzero(label)
        k = label[ys, xs] - 1
        low = lambda c: (m := np.full(n, 1 << 31), np.minimum.at(m, k, c))[0]
        high = lambda c: (m := np.full(n, -1), np.maximum.at(m, k, c))[0]
        total = lambda c: np.bincount(k, c, n).astype(np.int64)
        first = np.full(n, (1 << 62))
        np.minimum.at(first, k, (ys + ty) << 32 | (xs + tx))
        parts = (first, np.bincount(k, minlength=n), total(ys + ty), total(xs + tx), low(ys) + ty, high(ys) + ty, low(xs) + tx, high(xs) + tx)
        h, w = label.shape
        side = lambda full, line: pa.array([line.tolist() if full else []], pa.list_(pa.int32()))
        return pa.table(
            {c: table[c].slice(0, 1) for c in (*own, "ty", "tx")}
            | {"w": pa.array([w], pa.int32()), "labels": pa.array([label.astype("<i4").tobytes()], pa.binary())}
            | {"north": side(True, label[0]), "south": side(h == tile, label[-1]), "west": side(True, label[:, 0]), "east": side(w == tile, label[:, -1])}
            | {c: pa.array([v.tolist()], pa.list_(pa.int64())) for c, v in zip(PARTS, parts)}
        )

    return rows.groupBy(*own, "ty", "tx").applyInArrow(run, T.StructType(fields))


def _roots(packed: DataFrame, own: list[str]) -> DataFrame:
    """Of each label of each tile: its number ``k`` there, its parts' figures, and ``root``, the first cell of the whole component."""
    each_ = F.transform(F.sequence(F.lit(1), F.size("first")), lambda k: F.struct(k.alias("k"), *[F.col(c)[k - 1].alias(c) for c in PARTS]))
    labels = packed.filter(F.size("first") > 0).select(*own, "ty", "tx", F.inline(each_))
    at = lambda rows, dy, dx, mine, name: rows.select(*own, (F.col("ty") + dy).alias("ty"), (F.col("tx") + dx).alias("tx"), F.transform(mine, lambda k: F.when(k > 0, F.get("first", k - 1))).alias(name))
    pairs = []
    for dy, dx, mine, theirs in ((1, 0, "south", "north"), (0, 1, "east", "west")):
        met = at(packed.filter(F.size(mine) > 0), dy, dx, mine, "a").join(at(packed, 0, 0, theirs, "b"), [*own, "ty", "tx"])
        pairs.append(met.select(*own, F.inline(F.arrays_zip("a", "b"))).filter("a is not null and b is not null"))
    lows = joined_lows(pairs[0].union(pairs[1]), own)
    return labels.join(lows.withColumnRenamed("node", "first"), [*own, "first"], "left").withColumn("root", F.coalesce("low", "first")).drop("low")


def _wholes(mask: DataFrame, value: int, tile: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tiles, the labels of tiles with their roots, and a row for each whole component with its size, sums and extent. A raster without a key is none."""
    own = keys(mask)
    packed = checkpointed(tiles(mask.na.drop(subset=own), value, tile))
    roots = _roots(packed, own)
    add, low, high = ("size", "sum_y", "sum_x"), ("y1", "x1"), ("y2", "x2")
    wholes = roots.groupBy(*own, "root").agg(*[F.sum(c).alias(c) for c in add], *[F.min(c).alias(c) for c in low], *[F.max(c).alias(c) for c in high])
    return packed, roots, wholes


def components_by_tile(mask: DataFrame, value: int = 1, tile: int = TILE) -> DataFrame:
    """The mask's keys, y, x and ``label`` as in :func:`components`, without a task that holds a raster."""
    own = keys(mask)
    packed, roots, wholes = _wholes(mask, value, tile)
    number = wholes.select(*own, "root", F.row_number().over(Window.partitionBy(*own).orderBy("root")).alias("label"))
    named = roots.join(number, [*own, "root"]).groupBy(*own, "ty", "tx").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "label"))), lambda s: s["label"]).alias("names"))
    rows = packed.select(*own, "ty", "tx", "w", "labels").join(named, [*own, "ty", "tx"], "left")
    schema = T.StructType([mask.schema[c] for c in own] + [T.StructField(c, T.IntegerType()) for c in ("y", "x", "label")])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                w, names = batch["w"][i].as_py(), np.array([0, *(batch["names"][i].as_py() or [])])
                label = np.frombuffer(batch["labels"][i].as_py(), "<i4")
                y, x = np.divmod(np.arange(len(label)), w)
                held = [pa.array([batch[c][i].as_py()] * len(label), batch[c].type) for c in own]
                cols = (y + batch["ty"][i].as_py() * tile, x + batch["tx"][i].as_py() * tile, names[label])
                yield pa.RecordBatch.from_arrays([*held, *(pa.array(c.astype(np.int32)) for c in cols)], names=schema.names)

    return rows.mapInArrow(run, schema)


def islands_by_tile(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """As :func:`islands`, and each island's extent y1, y2, x1, x2, without a task that holds a raster."""
    own = keys(mask)
    _, _, wholes = _wholes(mask, 0, tile)
    size = mask.filter("y >= 0 and x >= 0").groupBy(*own).agg(F.max("y").alias("h"), F.max("x").alias("w"))
    inner = wholes.join(size, own).filter("y1 > 0 and x1 > 0 and y2 < h and x2 < w")
    label = F.row_number().over(Window.partitionBy(*own).orderBy("root"))
    return inner.select(*own, label.alias("label"), "size", "sum_x", "sum_y", (F.col("sum_x") / F.col("size")).alias("cx"), (F.col("sum_y") / F.col("size")).alias("cy"), "y1", "y2", "x1", "x2")


def count_by_tile(mask: DataFrame, value: int = 1, tile: int = TILE) -> DataFrame:
    """As :func:`component_count`, without a task that holds a raster."""
    own = keys(mask)
    packed, _, wholes = _wholes(mask, value, tile)
    return packed.select(*own).distinct().join(wholes.groupBy(*own).agg(F.count("*").alias("n")), own, "left").select(*own, F.coalesce("n", F.lit(0)).cast("long").alias("components"))


def islands(mask: DataFrame) -> DataFrame:
    """Columns image_id (and layer, where masks have it), label, size, sum_x, sum_y, cx, cy of each island."""
    found = each(mask, "open", "label", island_labels).filter("label > 0")
    return found.groupBy(*keys(mask), "label").agg(F.count("*").alias("size"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def component_count(mask: DataFrame, value: int = 1) -> DataFrame:
    """Number of components of each raster."""
    return components(mask, value).groupBy(*keys(mask)).agg(F.coalesce(F.max("label"), F.lit(0)).cast("long").alias("components"))
