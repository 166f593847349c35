"""Operator 10, quality rules: a linear-chain CRF marks each line content or boilerplate.

Base rules count words, symbols, repeated lines and repeated word windows of the whole text.
A conditional random field with two labels then reads the lines in order; Viterbi decoding
gives each line its label, and a document stays if enough of its words are in content lines.

The field's weights come from labels of whole documents (:func:`fit`), not from rules on lines. All
lines of a good document are content. Which lines make a bad document bad is hidden: at first all
of them are taken for boilerplate, then the fitted field decodes them, lines that it takes for
content become so, as long as at least half of the document's words stay boilerplate, and the field
is fitted again. The features only describe a line; their weights are learned.

Cases: a null or blank text has no words, so ``base_failed`` and not ``kept``; a line without a
word takes no label; without labelled documents of both kinds every line is content; null labels, and labels
of documents that aren't there, say nothing; repeated rows get equal results; extra columns pass through, and a column
that has the name of a result is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweave.llm._common import WHITE, attach, column, encoded

SYMBOLS = b"#*$%&|<>"
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("content_words", T.LongType()),
    T.StructField("kept", T.BooleanType()),
]
NOTICE = re.compile(rb"\b(?:licen[sc]ed?|copyright|cookies?|rights reserved|privacy policy|subscribe)\b|lorem ipsum|<[a-z/!]", re.I)
UPPER = bytes(range(65, 91))
LETTERS = UPPER + UPPER.lower() + bytes(range(128, 256))
DIGITS = b"0123456789"
#: Features of a line, each 0 or 1.
N_FEATURES = 14
#: Labelled documents of each kind that the field is fitted on: those of least hash. A bound on labelled rows, not on the corpus.
SAMPLE = 1_000


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == n:
        return 0
    seen: dict[tuple, int] = {}
    count = np.zeros(n, np.bool_)
    for i, w in enumerate(windows):
        first = seen.setdefault(w, i)
        if first != i:
            count[first] = count[i] = True
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(count)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((cover.cumsum() > 0).sum())


def line_features(line: bytes, words: list[bytes], seen: bool) -> tuple[int, ...]:
    """Indices of the features that hold for a line."""
    n, size = len(words), len(line)
    symbols = size - len(line.translate(None, SYMBOLS))
    letters = size - len(line.translate(None, LETTERS))
    upper = size - len(line.translate(None, UPPER))
    digits = size - len(line.translate(None, DIGITS))
    out = [0]
    if symbols * 10 > size:
        out.append(1)
    if symbols * 3 > n:
        out.append(2)
    if upper * 10 > 6 * letters and letters > 8:
        out.append(3)
    if letters * 2 < size:
        out.append(4)
    if digits * 5 > size:
        out.append(5)
    if n < 4:
        out.append(6)
    if seen:
        out.append(7)
    if NOTICE.search(line):
        out.append(8)
    if line.count(b"!") * 3 > n:
        out.append(9)
    if not line.rstrip().endswith((b".", b"!", b"?")):
        out.append(10)
    if n > 12:
        out.append(11)
    if size > 9 * n:
        out.append(12)
    if size < 5 * n:
        out.append(13)
    return tuple(out)


def examined(text: bytes) -> tuple[list[tuple[int, ...]], list[int], tuple[int, int, int, int, int], bool]:
    """Features and word counts of the lines that have words; the base figures; whether they fail."""
    words = text.split()
    n = len(words)
    spaces = len(text) - len(text.translate(None, WHITE))
    chars = len(text) - spaces if text.isascii() else len(text.decode("utf-8", "replace")) - spaces
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    features, sizes, lines, dups = [], [], set(), 0
    for line in text.split(b"\n"):
        own = line.split()
        if own:
            again = line in lines
            dups += again
            lines.add(line)
            features.append(line_features(line, own, again))
            sizes.append(len(own))
    repeats = repeated_words(words)
    return features, sizes, (n, chars, symbols, dups, repeats), n < 10 or 100 * repeats > 20 * n


def viterbi(features: list[tuple[int, ...]], emit: list[float], move: list[list[float]]) -> list[int]:
    """Most likely labels (1: content); ``emit`` holds a feature's weight for content against boilerplate."""
    if not features:
        return []
    back, a, b = [], 0.0, 0.0
    (m00, m01), (m10, m11) = move
    for i, f in enumerate(features):
        e = 0.0
        for k in f:
            e += emit[k]
        if i:
            p, q = a + m00 >= b + m10, a + m01 > b + m11
            back.append((0 if p else 1, 0 if q else 1))
            a, b = (a + m00 if p else b + m10), (a + m01 if q else b + m11) + e
        else:
            b = e
    label = 0 if a > b else 1
    out = [label]
    for p in reversed(back):
        label = p[label]
        out.append(label)
    return out[::-1]


def train(features: list[list[tuple[int, ...]]], labels: list[np.ndarray], weights: list[float] | None = None, linked: bool = True, rounds: int = 60, penalty: float = 1.0) -> tuple[list[float], list[list[float]]]:
    """Weights of the field by gradient ascent on the penalised likelihood (forward-backward, all sequences at once).

    ``weights``: what each sequence counts; unless ``linked``, neighbours say nothing of each other.
    """
    order = sorted((i for i, f in enumerate(features) if f), key=lambda i: -len(features[i]))
    w, move = np.zeros(N_FEATURES), np.zeros((2, 2))
    if not order:
        return w.tolist(), move.tolist()
    length = np.array([len(features[i]) for i in order])
    steps, live = int(length[0]), np.searchsorted(-length, -np.arange(int(length[0])), side="left")  # sequences longer than each step
    start = np.cumsum(np.append(0, live[:-1]))
    x, y = np.zeros((int(live.sum()), N_FEATURES)), np.zeros(int(live.sum()), np.int64)  # step by step
    for j, i in enumerate(order):
        at = start[: length[j]] + j
        y[at] = labels[i]
        for t, ks in zip(at.tolist(), features[i]):
            x[t, list(ks)] = 1
    worth = np.ones(len(order)) if weights is None else np.array([weights[i] for i in order])
    part = [slice(a, a + n) for a, n in zip(start.tolist(), live.tolist())]
    own = np.concatenate([worth[:n] for n in live])
    total = own.sum()
    speed_w, speed_m = np.zeros(N_FEATURES), np.zeros((2, 2))
    for _ in range(rounds):
        gw, gm = -penalty * w / total, -penalty * move / total
        grow = np.exp(move)
        e = np.exp(np.stack([np.zeros(len(x)), np.clip(x @ w, -30, 30)], 1))
        fw, bw = np.empty(e.shape), np.ones(e.shape)
        fw[part[0]] = e[part[0]] / e[part[0]].sum(1, keepdims=True)
        for t in range(1, steps):
            v = (fw[part[t - 1]][: live[t]] @ grow) * e[part[t]]
            fw[part[t]] = v / v.sum(1, keepdims=True)
        for t in range(steps - 2, -1, -1):
            v = (e[part[t + 1]] * bw[part[t + 1]]) @ grow.T
            bw[part[t]][: live[t + 1]] = v / v.sum(1, keepdims=True)
        post = fw * bw
        post /= post.sum(1, keepdims=True)
        gw += x.T @ ((y - post[:, 1]) * own) / total
        for t in range(1, steps):
            n = live[t]
            pair = fw[part[t - 1]][:n, :, None] * grow * (e[part[t]] * bw[part[t]])[:, None, :]
            gm -= (pair / pair.sum((1, 2), keepdims=True) * worth[:n, None, None]).sum(0) / total
            np.add.at(gm, (y[part[t - 1]][:n], y[part[t]]), worth[:n] / total)
        speed_w, speed_m = 0.8 * speed_w + gw, 0.8 * speed_m + gm * linked
        w, move = w + 2.0 * speed_w, move + 2.0 * speed_m
    return w.tolist(), move.tolist()


def relabelled(features: list[tuple[int, ...]], sizes: list[int], emit: list[float], move: list[list[float]], share: float) -> np.ndarray:
    """Labels of a bad document's lines: as decoded, but the least content-like lines are boilerplate up to ``share`` of the words."""
    label, sizes = np.array(viterbi(features, emit, move)), np.array(sizes)
    value = np.array([sum(emit[k] for k in f) for f in features])
    order = np.argsort(value, kind="stable")
    need = np.cumsum(sizes[order]) - sizes[order] < share * sizes.sum()
    label[order[need]] = 0
    return label


def learned(sequences: list[tuple[list[tuple[int, ...]], list[int], bool]], share: float = 0.5, rounds: int = 3) -> tuple[list[float], list[list[float]]]:
    """Weights from documents (features and words of each line, and whether the document is good)."""
    sequences = [s for s in sequences if s[0]]
    good = sum(s[2] for s in sequences)
    if not 0 < good < len(sequences):
        return [1.0, *[0.0] * (N_FEATURES - 1)], [[0.0, 0.0], [0.0, 0.0]]
    features = [s[0] for s in sequences]
    labels = [np.full(len(s[0]), int(s[2])) for s in sequences]
    for i in range(rounds):
        # both kinds count alike
        lines = [sum(len(s[0]) for s in sequences if s[2] is kind) for kind in (False, True)]
        # labels of whole documents would only teach that neighbours are alike, so the first fit takes lines alone
        emit, move = train(features, labels, [sum(lines) / (2 * lines[s[2]]) for s in sequences], i > 0)
        if i < rounds - 1:
            labels = [np.ones(len(s[0]), np.int64) if s[2] else relabelled(s[0], s[1], emit, move, share) for s in sequences]
    return emit, move


def fit(docs: DataFrame, labels: DataFrame | None, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, share: float = 0.5) -> tuple[list[float], list[list[float]]]:
    """Weights from at most ``sample`` labelled documents of each kind (of a text, the least label counts)."""
    if labels is None:
        return learned([])
    own = labels.select(column(doc_id).alias("_id"), column(label).alias("_good")).filter("_good in (0, 1)").groupBy("_id").agg(F.min("_good").alias("_good"))
    hashes = docs.filter(column(text).isNotNull()).select(column(doc_id).alias("_id"), F.xxhash64(column(text)).alias("_h"))
    texts = hashes.join(own, "_id").groupBy("_h").agg(F.min("_good").alias("_good"), F.min("_id").alias("_id"))
    some = texts.filter("_good = 0").orderBy("_h", "_id").limit(sample).union(texts.filter("_good = 1").orderBy("_h", "_id").limit(sample))
    # the documents named once more, since the texts themselves aren't ordered or grouped
    chosen = docs.select(column(doc_id).alias("_id"), F.xxhash64(column(text)).alias("_h"), column(text).alias("_text")).join(F.broadcast(some), ["_id", "_h"]).select("_h", "_good", "_text")

    def run(batches):
        for batch in batches:
            rows = []
            for h, good, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                features, sizes, _, _ = examined(t.encode())
                rows.append((h, bool(good), [sum(1 << k for k in f) for f in features], sizes))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32())))] if rows else [pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()))], names=["h", "good", "features", "sizes"])

    found = {r.h: r for r in chosen.mapInArrow(run, "h long, good boolean, features array<int>, sizes array<int>").collect()}
    return learned([([tuple(k for k in range(N_FEATURES) if f >> k & 1) for f in r.features], r.sizes, r.good) for _, r in sorted(found.items())], share)


def apply_rules(docs: DataFrame, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", weights=None, share: float = 0.5) -> DataFrame:
    """Each row with its base figures, words in content lines, and ``kept``.

    ``labels``: labelled documents, from which the field learns unless ``weights`` are given; ``share``:
    least share of words in lines that the field marks as content.
    """
    emit, move = weights or fit(docs, labels, doc_id, text, share=share)
    by = [c for c in docs.columns if c.lower() not in {f.name for f in FIELDS}].index(text)

    def kernel():
        def run(part: pa.RecordBatch) -> list:
            out = []
            for t in encoded(part.column(by)):
                features, sizes, base, failed = examined(t)
                content = sum(s for s, y in zip(sizes, viterbi(features, emit, move), strict=True) if y)
                out.append((*base, failed, content, not failed and content >= share * base[0]))
            return [list(x) for x in zip(*out)] if out else [[] for _ in FIELDS]

        return run

    return attach(docs, FIELDS, kernel, text)
