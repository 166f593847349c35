"""Operator 6, packing: hierarchical multi-length packing of documents into training sequences.

Documents are tokenised where they lie and packed within their partition, so nothing is shuffled
and a lost task makes the same sequences again. A document's whole windows of the longest context
become sequences; what is left is routed to the smallest context tier that holds it. Longest tier
first, each piece opens a window whose gap is filled from shorter pieces (best fit), then from
the head of one more piece, cut to size. So the windows of all tiers are full; pieces that find
no partner wait for the next block, and what remains at a partition's end is laid end to end.
Full sequences of one tier form step groups of equal token counts.

Cases: a null text is empty; an empty document is its end id alone; a document longer than any
window is cut; repeated rows are packed once each; a null id passes through; other columns of the
input are not returned; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import defaultdict

import pyarrow as pa
import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweave.llm._common import chunks, encoded
from pixelweave.llm._tokens import tokenizer_path, word_ids

TIERS = (512, 1024, 2048, 4096)
END = 2
#: Tokens of a step group.
STEP = 65_536
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
    T.StructField("tier", T.IntegerType()),
    T.StructField("step_group", T.LongType()),
])
ARROW = pa.schema([(f.name, {"bigint": pa.int64(), "int": pa.int32()}[f.dataType.simpleString()]) for f in SCHEMA.fields])


class Packer:
    """Packs the documents of one partition; pieces are (length, order, document, start)."""

    def __init__(self, base: int, tiers: tuple[int, ...], step: int) -> None:
        self.base, self.tiers, self.step = base, tuple(sorted(tiers)), step
        self.longest = self.tiers[-1]
        self.pool: list[tuple] = []
        self.held: dict[int, tuple] = {}  # document: id, ids, tokens
        self.out: list[tuple] = []
        self.sequences = self.groups = self.order = 0
        self.filled: dict[int, tuple[int, int]] = {}

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        key = self.order
        self.held[key] = (doc_id, ids, n)
        self.order += 1
        at = 0
        while n - at >= self.longest:
            self.close(self.longest, [(self.longest, key, at)])
            at += self.longest
        if at < n:
            insort(self.pool, (n - at, key, at))

    def take(self, most: int) -> tuple | None:
        """The longest piece of the pool that fits."""
        i = bisect_right(self.pool, (most, 1 << 62, 0))
        return self.pool.pop(i - 1) if i else None

    def pack(self) -> None:
        """Fills windows, longest tier first, while the pool lasts."""
        for i in range(len(self.tiers) - 1, -1, -1):
            tier, below = self.tiers[i], self.tiers[i - 1] if i else 0
            while self.pool and self.pool[-1][0] > below and (window := self.window(tier)):
                self.close(tier, window)

    def window(self, tier: int) -> list[tuple] | None:
        """A full window that starts with the pool's longest piece, or nothing if the pool can't fill it."""
        window = [self.pool.pop()]
        gap = tier - window[0][0]
        while gap and (piece := self.take(gap)):
            window.append(piece)
            gap -= piece[0]
        if gap:
            if not self.pool:
                for p in window:
                    insort(self.pool, p)
                return None
            n, key, at = self.pool.pop()
            window.append((gap, key, at))
            insort(self.pool, (n - gap, key, at + gap))
        return window

    def close(self, tier: int, window: list[tuple]) -> None:
        group, room = self.filled.get(tier, (0, 0))
        if room < tier:
            group, room = self.base | self.groups, self.step
            self.groups += 1
        self.filled[tier] = (group, room - tier)
        offset = 0
        for n, key, at in window:
            doc_id, ids, total = self.held[key]
            self.out.append((doc_id, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), total, self.base | self.sequences, offset, tier, group))
            offset += n
        self.sequences += 1

    def finish(self) -> None:
        """Lays what is left end to end in windows of the longest tier; the last one may need padding."""
        window, room = [], self.longest
        for n, key, at in sorted(self.pool, reverse=True):
            while n:
                now = min(n, room)
                window.append((now, key, at))
                n, at, room = n - now, at + now, room - now
                if not room:
                    self.close(self.longest, window)
                    window, room = [], self.longest
        if window:
            self.close(self.longest, window)
        self.pool = []

    def drain(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        live = {p[1] for p in self.pool}
        self.held = {k: v for k, v in self.held.items() if k in live}
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), ARROW)], schema=ARROW)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS, end: int = END, step: int = STEP, path: str | None = None) -> DataFrame:
    """A row for each piece: where it lies in its document and in its sequence (see ``SCHEMA``)."""
    path = path or tokenizer_path()
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        coder = word_ids(path)
        packer = Packer(TaskContext.get().partitionId() << 32, tiers, step)
        for batch in batches:
            for part in chunks(batch, 1):
                *_, ends, ids = coder.encode(encoded(part.column(1)))
                raw, at = ids.astype("<u4").tobytes(), 0
                for key, to in zip(part.column(0).to_pylist(), (4 * ends).tolist(), strict=True):
                    packer.add(key, raw[at:to] + tail)
                    at = to
                packer.pack()
                if packer.out:
                    yield packer.drain()
        packer.finish()
        if packer.out:
            yield packer.drain()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
