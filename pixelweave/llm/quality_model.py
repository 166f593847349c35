"""Operator 2, quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of the whole text (see ``STATISTICS``) are standardised and mapped by random Fourier
features that approximate a Gaussian kernel. Each task adds up its share of the normal equations,
the shares are summed by row of the matrix in Spark, and the driver solves one small system. A
fifth of the labelled rows is kept from the fit; its scores, binned in Spark, are calibrated by
isotonic regression (pool adjacent violators).

All labelled rows that are given are used; nothing here grows with them but Spark's own sums.

Cases: null or empty texts have statistics (all zero) and a score; null labels are left out; a
document with several labels has their mean; without labels of both kinds every score is the mean
label (0.5 without any); repeated rows get equal results; clashing columns of the input are not
returned; empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweave.llm._common import attach, column, encoded, sampled, stage

STATISTICS = [
    "log_words", "log_lines", "word_length", "long_words", "upper", "digits", "symbols", "marks", "bangs", "pipes", "beyond_ascii",
    "distinct_words", "distinct_pairs", "repeated_words", "distinct_lines", "short_lines", "spaces", "notices",
]
FEATURES = 256
CLASSES = np.full(256, 0, np.int64)
for _set, _k in ((range(65, 91), 1), (range(97, 123), 2), (range(48, 58), 3), (b"#*$%&<>", 4), (b".,;:'\"-()", 5), (b"!?", 6), (b"|", 7), (range(128, 256), 8), (b" \t\n\r\x0b\x0c", 9)):
    CLASSES[list(_set)] = _k


def statistics(text: bytes) -> list[float]:
    size = len(text)
    if not size:
        return [0.0] * len(STATISTICS)
    kind = np.bincount(CLASSES, np.bincount(np.frombuffer(text, np.uint8), minlength=256), 10)
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    letters = max(1.0, kind[1] + kind[2] + kind[8])
    return [
        math.log1p(len(words)), math.log1p(len(lines)), min(30.0, sum(map(len, words)) / n), sum(map((14).__lt__, map(len, words))) / n, kind[1] / letters, kind[3] / size,
        kind[4] / size, kind[5] / size, min(1.0, 10 * kind[6] / size), kind[7] / n, kind[8] / size, len(set(words)) / n, len(set(zip(words, words[1:]))) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, len(set(lines)) / m, sum(len(x) < 20 for x in lines) / m, kind[9] / size,
        float(min(3, sum(text.lower().count(x) for x in (b"license", b"copyright", b"cookie", b"http", b"lorem ipsum", b"@")))),
    ]


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``doc_id`` and ``stats``."""
    lone = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"))

    def kernel():
        return lambda part: [pa.array([statistics(t) for t in encoded(part.column(1))], pa.list_(pa.float64()))]

    return attach(lone, [T.StructField("stats", T.ArrayType(T.DoubleType()))], kernel).drop("text")


class Scorer:
    """Standardisation, random Fourier features, ridge weights and calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = 2.0, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / (width * math.sqrt(len(mean))), (len(mean), features - 1))
        self.b = rng.uniform(0, 2 * math.pi, features - 1)
        self.weights = np.zeros(features)
        self.knots, self.values = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def isotonic(at: np.ndarray, label_sum: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the pooled non-decreasing fit; shrunk by half a case of either label."""
    blocks: list[list[float]] = []
    for x, s, k in zip(at, label_sum, n):
        blocks.append([s, k, x * k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, k2, x2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + k2, blocks[-1][2] + x2]
    return np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks])


def vectors(rows: DataFrame, fn, out: str) -> DataFrame:
    """``fn(stats matrix, labels)`` gives record batches; rows have ``stats`` and ``label``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).flatten()).reshape(batch.num_rows, -1)
                yield from fn(x, batch.column(1).to_numpy())

    return rows.select("stats", "label").mapInArrow(run, out)


def fit(labelled: DataFrame, features: int = FEATURES, ridge: float = 1e-3, bins: int = 2000) -> Scorer:
    """A scorer from ``labelled(doc_id, stats, label)``; rows must be at hand (staged), they are read thrice."""
    k = len(STATISTICS)
    sums = [f(F.col("stats")[i]) for i in range(k) for f in (F.avg, F.stddev_pop)]
    r = labelled.agg(F.count("*"), F.avg("label"), *sums).first()
    if not r[0]:
        return Scorer(np.zeros(k), np.ones(k), features)
    mean, dev = np.array(r[2::2], float), np.array(r[3::2], float)
    scorer = Scorer(mean, np.where(dev > 1e-9, dev, 1.0), features)
    scorer.values = np.array([r[1], r[1]])
    if r[1] in (0.0, 1.0):
        return scorer
    shared = labelled.sparkSession.sparkContext.broadcast(scorer)
    kept = sampled(F.col("doc_id"), 0.2, seed=3)

    def equations(x: np.ndarray, y: np.ndarray):
        z = shared.value.features(x)
        full = np.hstack([z.T @ z, (z.T @ y)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(full)), pa.int32()), pa.array(full.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    def added(table: pa.Table) -> pa.Table:
        v = np.array(table["v"].combine_chunks().flatten()).reshape(table.num_rows, -1).sum(0)
        return pa.table({"i": table["i"][:1], "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    parts = vectors(labelled.filter(~kept), equations, "i int, v array<double>")
    total = parts.groupBy("i").applyInArrow(added, "i int, v array<double>").toArrow().sort_by("i")
    if not total.num_rows:
        return scorer
    full = np.array(total["v"].combine_chunks().flatten()).reshape(total.num_rows, -1)
    a, b = full[:, :-1], full[:, -1]
    scorer.weights = np.linalg.solve(a + ridge * a[-1, -1] * np.eye(len(a)) / len(a), b)
    shared = labelled.sparkSession.sparkContext.broadcast(scorer)

    def binned(x: np.ndarray, y: np.ndarray):
        raw = shared.value.raw(x)
        at = np.clip((raw + 0.5) * (bins / 2), 0, bins - 1).astype(np.int64)
        own, inverse = np.unique(at, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(inverse, raw)), pa.array(np.bincount(inverse, y)), pa.array(np.bincount(inverse).astype(np.int64))], names=["bin", "x", "y", "n"])

    by_bin = vectors(labelled.filter(kept), binned, "bin long, x double, y double, n long")
    cells = by_bin.groupBy("bin").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("n").alias("n")).orderBy("bin").collect()
    if cells:
        x, y, n = (np.array([c[i] for c in cells], float) for i in (1, 2, 3))
        scorer.knots, scorer.values = isotonic(x / n, y, n)
    return scorer


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``doc_id`` and ``score`` for each row of ``docs``; ``labels(doc_id, <label>)`` are learned."""
    stats = stage(measured(docs, doc_id, text), "quality")
    marks = labels.filter(column(label).isNotNull()).groupBy(column("doc_id").alias("doc_id")).agg(F.avg(column(label).cast("double")).alias("label"))
    labelled = stage(stats.join(marks, "doc_id"), "quality-labelled")
    shared = docs.sparkSession.sparkContext.broadcast(fit(labelled))

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).flatten()).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(shared.value.score(x), 0, 1), pa.float64())], names=["doc_id", "score"])

    return stats.mapInArrow(run, T.StructType([stats.schema["doc_id"], T.StructField("score", T.DoubleType())]))
