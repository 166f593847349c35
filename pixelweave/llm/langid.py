"""Operator 1, language identification: interpolated Kneser-Ney character models.

A text becomes lower-case letters with single spaces for all else. Each language has an
interpolated Kneser-Ney model of order four. The models are stored side by side in sorted arrays
of n-gram hashes: one row has the log probabilities for every language, so a character costs one
binary search; n-grams that no language has seen fall back, order by order, through arrays of
context weights. The language with the lowest cross-entropy per character wins. The confidence is
a softmax over the cross-entropies whose scale is fitted on labelled documents kept from counting,
and a text is marked ``rejected`` where its cross-entropy is beyond what such documents show.

Models are fitted on about ``docs_per_language`` distinct texts of each language, of any length, and
on all texts of a language that has no more; each text counts once, however often it is copied.
Every text is scored in whole.

Cases: a null text or one without letters gets ``und``, score 0 and no rejection; a null language
is not learned; with nothing to learn from all texts get ``und``; ties go to the first language
by name; repeated rows get equal results; extra columns pass through, one named as a result is
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweave.llm._common import attach, chunks, column, sampled

ORDER = 4
BITS = 16
SPACE, EDGE = 0, 1
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Languages whose texts are counted in one task.
LANGUAGES = 8
#: Scales of the confidence that are tried.
SCALES = np.geomspace(0.1, 100, 31)
FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("cross_entropy", T.DoubleType()),
    T.StructField("rejected", T.BooleanType()),
]


@cache
def symbols() -> np.ndarray:
    """16-bit symbol of each code point: a letter's lower case, else space.

    Every letter of the basic plane has its own symbol; those beyond share the 6,400 private numbers there.
    """
    out = np.zeros(0x110000, np.uint16)
    for c in range(65, 0x40000):
        s = chr(c)
        if s.isalpha():
            low = ord(s.lower()[0])
            out[c] = low if low < 0x10000 else 0xE000 + low % 6400
    return out


def keys_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of the texts laid end to end (last symbol lowest), and where each text ends.

    A text is led by ``ORDER - 1`` edge symbols; n-grams that end in an edge are left out.
    """
    points = np.frombuffer(("\0" * (ORDER - 1)).join(["", *(t.replace("\0", " ") for t in texts)]).encode("utf-32-le", "replace"), np.uint32)
    sym = symbols()[np.minimum(points, 0x10FFFF)]
    edge = points == 0
    sym[edge] = EDGE
    keep = np.ones(len(sym), np.bool_)
    if len(sym):
        keep[1:] = (sym[1:] != SPACE) | (sym[:-1] != SPACE)
    sym = sym[keep]
    edge = edge[keep]
    key = sym.astype(np.uint64)
    for i in range(1, ORDER):
        key[i:] |= sym[:-i].astype(np.uint64) << np.uint64(BITS * i)
    inside = np.flatnonzero(~edge)
    starts = np.flatnonzero(edge)[:: ORDER - 1] if len(edge) else np.zeros(0, np.int64)
    ends = np.searchsorted(inside, np.append(starts[1:], len(sym)))
    return key[inside], ends


def counted(rows: DataFrame) -> DataFrame:
    """Columns lang, key, n: n-gram counts of ``rows(lang, text)``. A task adds up what it reads, so it gives a row for each of its n-grams."""

    def run(batches):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in chunks(batch, 1):
                by: dict[str, list[str]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    by.setdefault(lang, []).append(text or "")
                for lang, texts in by.items():
                    k, n = np.unique(keys_of(texts)[0].view(np.int64), return_counts=True)
                    if lang in total:
                        k, at = np.unique(np.concatenate([total[lang][0], k]), return_inverse=True)
                        n = np.bincount(at, np.concatenate([total[lang][1], n]), len(k)).astype(np.int64)
                    total[lang] = k, n
        for lang, (k, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n)], names=["lang", "key", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


class Model:
    """Kneser-Ney models of several languages in common sorted hash arrays."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.languages = sorted(counts)
        self.scale, self.reject = 1.0, np.inf
        counts = {lang: (k.astype(np.uint64), n.astype(np.float64)) for lang, (k, n) in counts.items()}
        mask = lambda n: np.uint64((1 << (BITS * n)) - 1)
        per = {lang: self._orders(k, n) for lang, (k, n) in counts.items()}
        size = np.uint64(max(2, len(np.unique(np.concatenate([k & mask(1) for k, _ in counts.values()])))))
        self.floor = float(-np.log(float(size) + 1))
        # probabilities of order n for all n-grams that any language has, and weights of all contexts
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.weights: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([per[lang][n - 1][0] for lang in self.languages]))
            contexts = np.unique(keys >> np.uint64(BITS))
            below = self.look_up(keys & mask(n - 1), n - 1) if n > 1 else np.full((len(keys), len(self.languages)), self.floor)
            p = np.empty((len(keys), len(self.languages)))
            w = np.zeros((len(contexts), len(self.languages)))
            for j, lang in enumerate(self.languages):
                own, c = per[lang][n - 1]
                one, two = (c == 1).sum(), (c == 2).sum()
                d = min(0.95, max(0.1, one / max(1, one + 2 * two)))
                heads, at = np.unique(own >> np.uint64(BITS), return_inverse=True)
                total, kinds = np.bincount(at, c), np.bincount(at)
                share = np.ones(len(contexts))
                share[np.searchsorted(contexts, heads)] = d * kinds / total
                w[:, j] = np.log(share)
                seen = np.zeros(len(keys))
                seen[np.searchsorted(keys, own)] = (c - d) / total[at]
                p[:, j] = np.log(seen + share[np.searchsorted(contexts, keys >> np.uint64(BITS))] * np.exp(below[:, j]))
            for table, k, v in ((self.grams, keys, p), (self.weights, contexts, w)):
                h = k * MIX
                order = np.argsort(h)
                table.append((h[order], v[order].astype(np.float32)))

    @staticmethod
    def _orders(keys: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Counts of the highest order; below, numbers of distinct symbols to the left."""
        out = [(keys, n)]
        for k in range(ORDER - 1, 0, -1):
            low, c = np.unique(out[0][0] & np.uint64((1 << (BITS * k)) - 1), return_counts=True)
            out.insert(0, (low, c.astype(np.float64)))
        return out

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = keys * MIX
        at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
        return at, table[0][at] == h

    def look_up(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Log probabilities of n-grams of an order, a column for each language."""
        if order == 0:
            return np.full((len(keys), len(self.languages)), self.floor)
        at, known = self._find(self.grams[order - 1], keys)
        out = self.grams[order - 1][1][at]
        if not known.all():
            miss = np.flatnonzero(~known)
            k = keys[miss]
            at, seen = self._find(self.weights[order - 1], k >> np.uint64(BITS))
            weight = np.where(seen[:, None], self.weights[order - 1][1][at], 0)
            out[miss] = weight + self.look_up(k & np.uint64((1 << (BITS * (order - 1))) - 1), order - 1)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character for each text and language, and the texts' lengths in symbols."""
        keys, ends = keys_of(texts)
        out = np.zeros((len(texts), len(self.languages)))
        if len(keys):
            p = self.look_up(keys, ORDER)
            total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0, dtype=np.float64)])
            starts = np.append(0, ends[:-1])
            n = np.maximum(1, ends - starts)
            return -(total[ends] - total[starts]) / n[:, None], ends - starts
        return out, ends

    def judge(self, texts: list[str]) -> list[list]:
        """Language, confidence, cross-entropy and rejection of each text."""
        has = np.array([any(map(str.isalpha, t)) for t in texts])
        h, n = self.entropies(texts)
        best = h.argmin(1)
        low = h[np.arange(len(texts)), best]
        z = np.exp(-self.scale * np.minimum(n, 2000)[:, None] ** 0.5 * (h - low[:, None])).sum(1)
        return [
            [self.languages[b] if x else "und" for b, x in zip(best, has)],
            np.where(has, 1 / z, 0.0).tolist(),
            np.where(has, low, 0.0).tolist(),
            (has & (low > self.reject)).tolist(),
        ]


def judged(held: DataFrame, model: Model) -> list[tuple[list[float], float]]:
    """For each text of ``held(lang, text)``: the summed cost of each scale of ``SCALES`` over its short pieces, and its cross-entropy."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not t or lang not in m.languages:
                    continue
                own = m.languages.index(lang)
                pieces = [t[i : i + 60] for i in range(0, len(t), 60)]  # short, so that the scale has errors to see
                cost = np.zeros(len(SCALES))
                for i in range(0, len(pieces), 1000):
                    h, n = m.entropies(pieces[i : i + 1000])
                    over = n[:, None] ** 0.5 * (h - h[:, [own]])
                    cost += [np.log(np.exp(-s * over).sum(1)).sum() for s in SCALES]
                yield pa.RecordBatch.from_arrays([pa.array([cost.tolist()]), pa.array([float(m.entropies([t])[0][0, own])])], names=["cost", "own"])

    return sorted((r[0], r[1]) for r in held.select("lang", "text").mapInArrow(run, "cost array<double>, own double").collect())


def fit(rows: DataFrame, lang: str = "lang", text: str = "text", docs_per_language: int = 400, enough: int = 50) -> Model | None:
    """Models from distinct labelled texts; a tenth of them, of languages with ``enough``, sets scale and rejection."""
    known = rows.filter(column(lang).isNotNull()).select(column(lang).cast("string").alias("lang"), column(text).alias("text"))
    sizes = [(r[0], r[1]) for r in known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02)).collect()]
    if not sizes:
        return None
    shares = rows.sparkSession.createDataFrame([(name, math.ceil(1_000_000 * min(1.0, docs_per_language / max(1, n))), n >= enough) for name, n in sizes], "lang string, share long, enough boolean")
    some = known.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1_000_000)) < F.col("share")).distinct()
    kept = F.col("enough") & sampled(F.col("text"), 0.1, seed=11)
    # the same n-grams come up in every partition: the texts, a bounded number for each language, meet in a task for so many languages
    table = counted(some.filter(~kept).coalesce(max(1, len(sizes) // LANGUAGES))).toArrow()
    names = np.array(table["lang"].to_pylist(), object)
    keys, n = table["key"].to_numpy(), table["n"].to_numpy()
    if not len(keys):
        return None
    model = Model({str(x): (keys[names == x], n[names == x]) for x in set(names)})
    held = judged(some.filter(kept), model)
    if held:
        model.scale = float(SCALES[int(np.argmin(np.sum([cost for cost, _ in held], axis=0)))])
        good = np.array([own for _, own in held])
        model.reject = float(good.mean() + 6 * good.std() + 0.5)
    return model


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Each row with ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    by = [c for c in docs.columns if c.lower() not in {f.name for f in FIELDS}].index(text)

    def kernel():
        m = shared.value

        def run(part: pa.RecordBatch) -> list:
            texts = [t or "" for t in part.column(by).to_pylist()]
            if m is None:
                return [["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [False] * len(texts)]
            return m.judge(texts)

        return run

    return attach(docs, FIELDS, kernel, text, 1 << 20)
