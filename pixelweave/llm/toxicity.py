"""Operator 4, toxicity: linear classifier over character n-grams with naive Bayes log-count ratios.

Features are the byte n-grams of three to six characters of the lower-cased text, hashed, present
or absent. Each is scaled by its log-count ratio between toxic and clean documents; features
whose ratio is not beyond chance are dropped, and a logistic regression over the scaled rest is
fitted by gradient descent. Document frequencies are summed in Spark; the regression runs on the
driver over a bounded sample (about ``most`` documents of each label, of any length) of which only
selected features are collected.

Cases: null and empty texts have no features and the score of the intercept; null labels are left
out, several labels of a document count as toxic if any does; without labels of both kinds every
score is 0; repeated rows get equal results; extra columns pass through, one named as a result is
replaced; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweave.llm._common import attach, chunks, column, encoded, sampled, stage

SHORTEST, LONGEST = 3, 6
BITS = 20
PAD = b"\0" * LONGEST
FIELDS = [T.StructField("score", T.DoubleType())]


def buckets(texts: list[bytes]):
    """Buckets of the n-grams of each length of the texts laid end to end, then where texts start."""
    joined = PAD + PAD.join(texts) + PAD
    b = np.frombuffer(joined.lower(), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(np.append(LONGEST, lengths + LONGEST))[:-1]
    key = b.copy()
    for n in range(2, LONGEST + 1):
        key = key[:-1] * np.uint32(0x01000193) + b[n - 1 :]
        if n >= SHORTEST:
            yield ((key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)) >> np.uint32(32 - BITS), starts


class Model:
    """``slot`` maps buckets to selected features (from 1); ``weights`` has one for each, after the intercept."""

    def __init__(self, slot: np.ndarray, weights: np.ndarray) -> None:
        self.slot, self.weights = slot, weights

    def present(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature) pairs."""
        doc, feature = [], []
        for own, starts in buckets(texts):
            f = self.slot[own]
            at = np.flatnonzero(f)
            doc.append(np.searchsorted(starts, at + LONGEST - 1, side="right") - 1)
            feature.append(f[at])
        pairs = np.unique(np.concatenate(doc).clip(0, max(0, len(texts) - 1)) << 32 | np.concatenate(feature))
        return pairs >> 32, pairs & 0xFFFFFFFF

    def score(self, texts: list[bytes]) -> np.ndarray:
        doc, feature = self.present(texts)
        z = self.weights[0] + np.bincount(doc, self.weights[feature], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def frequencies(rows: DataFrame) -> DataFrame:
    """Columns bucket, pos, neg: toxic and clean documents of ``rows(label, text)`` that have it."""

    def run(batches):
        size = 1 << BITS
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            for part in chunks(batch, 1, 1 << 20):
                for label, t in zip(part.column(0).to_pylist(), encoded(part.column(1)), strict=True):
                    total[label, np.unique(np.concatenate([x for x, _ in buckets([t])]))] += 1
        at = np.flatnonzero(total.any(0))
        for i in range(0, len(at), 100_000):
            k = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[1, k]), pa.array(total[0, k])], names=["bucket", "pos", "neg"])

    return rows.select("label", "text").mapInArrow(run, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", most: int = 4000, features: int = 4000, beyond: float = 5.0) -> Model | None:
    """A model from ``labels(doc_id, <label>)`` and their documents, or nothing without both labels."""
    marks = labels.filter(column(label).isNotNull()).groupBy(column("doc_id").alias("doc_id")).agg((F.max(column(label)) > 0).cast("int").alias("label"))
    sizes = {r[0]: r[1] for r in marks.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    share = {k: min(1.0, most / n) for k, n in sizes.items()}
    some = marks.filter(F.when(F.col("label") == 1, sampled(F.col("doc_id"), share[1])).otherwise(sampled(F.col("doc_id"), share[0])))
    own = docs.select(column("doc_id").alias("doc_id"), column(text).alias("text")).filter(F.col("text").isNotNull())
    rows = stage(own.join(F.broadcast(some), "doc_id"), "toxicity")  # at most about 2 * most ids
    count = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if len(count) < 2:
        return None
    p, q = F.col("pos") / count[1], F.col("neg") / count[0]
    pool = (F.col("pos") + F.col("neg")) / (count[0] + count[1])
    chance = F.abs(p - q) / F.sqrt(pool * (1 - pool) * (1 / count[0] + 1 / count[1]) + 1e-12)
    table = frequencies(rows).filter("pos + neg >= 3").withColumn("z", chance).filter(F.col("z") >= beyond).orderBy(F.desc("z"), "bucket").limit(features).toArrow()
    if not table.num_rows:
        return None
    at, pos, neg = (table[c].to_numpy() for c in ("bucket", "pos", "neg"))
    ratio = np.log((pos + 0.5) / (count[1] + 1)) - np.log((neg + 0.5) / (count[0] + 1))
    slot = np.zeros(1 << BITS, np.int64)
    slot[at] = np.arange(1, len(at) + 1)
    model = Model(slot, np.zeros(len(at) + 1))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def selected(batches):
        for batch in batches:
            for part in chunks(batch, 1, 1 << 20):
                doc, feature = shared.value.present(encoded(part.column(1)))
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([feature[a:b].tolist() for a, b in zip(cut, cut[1:])], pa.list_(pa.int64()))], names=["label", "features"])

    seen = rows.select("label", "text").mapInArrow(selected, "label int, features array<long>").toArrow()
    y = seen["label"].to_numpy().astype(float)
    lists = seen["features"].combine_chunks()
    doc = np.repeat(np.arange(len(y)), np.diff(np.array(lists.offsets)))
    feature = lists.flatten().to_numpy() - 1
    value = ratio[feature]
    w, bias = np.zeros(len(at)), 0.0
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * 0.7 + 0.3 / len(y)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, 301):
        z = bias + np.bincount(doc, value * w[feature], len(y))
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        gw = np.bincount(feature, value * g[doc], len(at)) + 1e-4 * w
        gb = g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        a, c = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.02 * (m / a) / (np.sqrt(v / c) + 1e-8)
        bias -= 0.02 * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    model.weights = np.concatenate([[bias], w * ratio])
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Each row with ``score``, the probability that the text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    by = [c for c in docs.columns if c.lower() != "score"].index(text)

    def kernel():
        m = shared.value
        return lambda part: [pa.array(np.zeros(part.num_rows) if m is None else m.score(encoded(part.column(by))))]

    return attach(docs, FIELDS, kernel, text, 2 << 20)
