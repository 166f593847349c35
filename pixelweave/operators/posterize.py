"""Multilevel thresholds and nested layers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cuts(counts: np.ndarray, k: int) -> np.ndarray:
    """``k`` cuts of 256 bins that maximise the sum of squared class sums over class sizes; ties go to the lowest.

    Where more than ``k`` levels occur, no class of the best cuts is empty and each ends at a level that occurs, the
    lowest of equal places, so that these levels alone are tried.
    """
    level = np.flatnonzero(counts)
    if len(level) <= k:
        level = np.arange(256)
    n, counts = len(level), counts[level]
    weight, total = np.append(0, counts.cumsum()).astype(float), np.append(0, (counts * level).cumsum()).astype(float)
    w, s = weight[1:, None] - weight[None, :-1], total[1:, None] - total[None, :-1]
    gain = np.divide(s * s, w, out=np.zeros_like(s), where=w > 1e-12)  # of a class to its last bin (row) from its first (column)
    best, back = gain[:, 0], []
    after = np.where(np.arange(n - 1)[None] < np.arange(n)[:, None], gain[:, 1:], -np.inf)  # a class up to v (row) after the last bin u (column) before it
    for m in range(2, k + 2):
        score = best[None, :-1] + after
        score[:, : m - 2] = -np.inf
        back.append(score.argmax(1))
        best = score[np.arange(n), back[-1]]
    out, v = np.zeros(k, np.int64), n - 1
    for i in range(k - 1, -1, -1):
        v = int(back[i][v])
        out[i] = level[v] + 1
    return np.minimum(out, 255)


def cuts_of(stack: np.ndarray, k: int) -> np.ndarray:
    """:func:`cuts` of each raster of a stack."""
    counts = np.bincount((np.arange(len(stack))[:, None] * 256 + stack.reshape(len(stack), -1)).ravel(), minlength=len(stack) * 256)
    return np.array([cuts(c, k) for c in counts.reshape(-1, 256)]).reshape(len(stack), k)


def thresholds(histogram: DataFrame, k: int) -> DataFrame:
    """Columns image_id and ``thresholds`` (k ascending levels) from ``histogram(image_id, lum, n)``."""
    bins = histogram.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("lum", "n"))), lambda s: s["n"]).alias("bins"))

    def run(batches):
        for batch in batches:
            found = [cuts(bins, k).astype(np.int32) for bins in np.array(batch.column(1).flatten()).reshape(-1, 256)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["image_id", "thresholds"])

    kind = histogram.schema["image_id"].dataType.simpleString()
    return bins.mapInArrow(run, f"image_id {kind}, thresholds array<int>")


def rising(levels: Column) -> Column:
    """Levels in order, each at least one above the one before, none above 255."""
    step = lambda done, t: F.concat(done, F.array(F.when(F.size(done) > 0, F.greatest(t, F.element_at(done, -1) + 1)).otherwise(t)))
    sorted_ = F.array_sort(levels)
    return F.when(F.size(sorted_) == 0, sorted_).otherwise(F.transform(F.aggregate(F.slice(sorted_, 2, F.greatest(F.size(sorted_) - 1, F.lit(0))), F.slice(sorted_, 1, 1), step), lambda t: F.least(t, F.lit(255))))


def layers(pixels: DataFrame, levels: DataFrame) -> DataFrame:
    """A row for each pixel and layer, light to dark: ``open`` where lum is under the layer's threshold."""
    stack = levels.select("image_id", F.posexplode(F.reverse(F.array_sort("thresholds"))).alias("layer", "t"))
    return pixels.join(stack, "image_id").select("image_id", "layer", "y", "x", (F.col("lum") < F.col("t")).cast("int").alias("open"))


def open_area(masks: DataFrame) -> DataFrame:
    return masks.groupBy("image_id", "layer").agg(F.sum("open").alias("open_area"))


def bands(pixels: DataFrame, levels: DataFrame) -> DataFrame:
    """``tone``: gray of the preview, darker with each layer that covers a pixel."""
    over = F.size(F.filter("thresholds", lambda t: t > F.col("lum")))
    return pixels.join(levels, "image_id").select("image_id", "y", "x", F.floor(255 * (1 - over / F.greatest(F.size("thresholds"), F.lit(1))) + 0.5).cast("int").alias("tone"))


def line_art(edges: DataFrame) -> DataFrame:
    """``tone`` of the preview of line art: dark lines on paper."""
    return edges.select("image_id", "y", "x", F.when(F.col("open") == 1, 38).otherwise(236).alias("tone"))
