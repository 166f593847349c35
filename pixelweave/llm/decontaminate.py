"""Operator 9, benchmark decontamination: Wu-Manber multi-pattern search over words.

Texts become words (lower-cased ASCII letters, digits, everything beyond ASCII). A pattern is a
window of ten consecutive words of a benchmark item, or the whole item where that is shorter.
Patterns of one length share a shift table keyed by blocks of two words: a block says how far the
search may jump before a pattern could end there; blocks that end no pattern allow the longest
jump. Where the shift is zero, the bucket of the block lists the patterns to compare directly.

The patterns are broadcast. A benchmark of more than ``most_words`` words is cut into shards of items
by a hash of their text; the documents are searched for one shard after the other, and what each
finds is kept beside its document in a table, so that no worker holds more than one shard.

Cases: a null text has no words and no hits; an item without words matches nothing; equal items
under several ids all count; a null item_id counts in no list, though its words hit; repeated
document rows get equal results; extra columns pass through and a column with the name of a
result is replaced; empty tables give no hits or no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweave.llm._common import attach, column, encoded, stage, without

WINDOW = 10
#: Words of a shard of the benchmark, whose patterns are broadcast (about 300 MB in each worker).
MOST_WORDS = 1_000_000
#: Bytes of a word, lower-cased; all others part words.
WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
]
#: What a shard finds: first words and ends of occurrences in turn, and items.
FOUND = [T.StructField("_spans", T.ArrayType(T.LongType())), T.StructField("_items", T.ArrayType(T.StringType()))]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Searcher:
    """Shift tables and suffix buckets for all patterns of one length in words."""

    def __init__(self, size: int, patterns: set[tuple]) -> None:
        self.size, self.block = size, min(2, size)
        self.longest = size - self.block + 1
        self.shift: dict = {}
        self.bucket = defaultdict(set)
        for p in patterns:
            for end in range(self.block, size + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.longest), size - end)
            self.bucket[p[size - self.block :]].add(p)
        self.bucket = dict(self.bucket)

    def find(self, words: list[bytes]):
        """Start and pattern of each occurrence, in order."""
        size, n, longest, bucket = self.size, len(words), self.longest, self.bucket
        jump = self.shift.get
        i = size
        if self.block == 1:
            for at, w in enumerate(words):
                if (w,) in bucket:
                    yield at, (w,)
            return
        while i <= n:
            block = (words[i - 2], words[i - 1])
            s = jump(block, longest)
            if s:
                i += s
                continue
            window = tuple(words[i - size : i])
            if window in bucket[block]:
                yield i - size, window
            i += 1


def patterns_of(items: list[tuple], window: int = WINDOW) -> dict[tuple, set[str]]:
    """Each pattern with the ids (as text) of the items that hold it."""
    out: dict[tuple, set[str]] = defaultdict(set)
    for item_id, text in items:
        w = tuple(words_of((text or "").encode()))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            out[w[i : i + window]] |= set() if item_id is None else {str(item_id)}
    return dict(out)


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def search(words: list[bytes], searchers: list[Searcher], patterns: dict[tuple, set[str]]) -> tuple[list[tuple[int, int]], set[str]]:
    """First word and end of each occurrence, and the ids of the items found."""
    found, spans = set(), []
    for s in searchers:
        for at, pattern in s.find(words):
            spans.append((at, at + s.size))
            found |= patterns[pattern]
    return spans, found


def covered(spans: list[tuple[int, int]]) -> int:
    """Number of words inside any of the spans."""
    hit, reach = 0, 0
    for a, b in sorted(spans):
        hit += max(0, b - max(a, reach))
        reach = max(reach, b)
    return hit


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """Each row with its words, the words inside benchmark windows, and the items found."""
    size = F.sum(F.size(F.split(F.col("text"), "[^0-9A-Za-z\\x{80}-\\x{10ffff}]+")))
    shards = max(1, math.ceil((benchmark.agg(size).first()[0] or 0) / most_words))
    items = benchmark.select("item_id", "text", F.pmod(F.xxhash64("text"), F.lit(shards)).alias("shard"))
    rows, spark = without(docs, [f.name for f in FIELDS]), docs.sparkSession
    for i in range(shards):
        patterns = patterns_of([tuple(r) for r in items.filter(F.col("shard") == i).select("item_id", "text").collect()], window)
        rows = searched(rows, spark.sparkContext.broadcast(patterns), text, i > 0, i == shards - 1)
        if i < shards - 1:
            rows = stage(rows, "decontaminate")
    return rows


def searched(rows: DataFrame, shared, text: str, more: bool, last: bool) -> DataFrame:
    """The rows searched for one shard of patterns; ``more``: what earlier shards found is in ``FOUND``, ``last``: the results are due."""
    names = [f.name for f in FOUND]
    base = without(rows, [] if not more else names)
    order = base.columns
    # what earlier shards found has other names, as results replace columns of their own
    rows = rows.select(*[column(c) for c in order], *([column(n).alias(f"{n}_before") for n in names] if more else []))
    by, first = order.index(text), len(base.columns)

    def kernel():
        known = shared.value
        by_size = defaultdict(set)
        for p in known:
            by_size[len(p)].add(p)
        searchers = [Searcher(n, ps) for n, ps in by_size.items()]
        none = digest([])

        def run(part: pa.RecordBatch) -> list:
            out = []
            earlier = [part.column(first + i).to_pylist() for i in range(2)] if more else None
            for i, t in enumerate(encoded(part.column(by))):
                w = words_of(t)
                spans, found = search(w, searchers, known)
                if more:
                    spans += zip(earlier[0][i][::2], earlier[0][i][1::2])
                    found |= set(earlier[1][i])
                if last:
                    hit = covered(spans)
                    out.append((len(w), hit, len(found), digest(found) if found else none, hit > 0))
                else:
                    out.append(([x for s in spans for x in s], sorted(found)))
            return [list(x) for x in zip(*out)] if out else [[] for _ in (FIELDS if last else FOUND)]

        return run

    out = attach(rows, FIELDS if last else FOUND, kernel, text)
    return without(out, [f"{n}_before" for n in names]) if more else out
