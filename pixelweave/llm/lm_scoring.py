"""Operator 8, language-model scoring: a causal self-attention model beside a word unigram base.

A task reads each whole text once: it keeps its subword ids, and lists the distinct words of a block
of documents with their counts. The ids of all training documents are then counted, alone, after
the most frequent ids, and with the classes of their neighbours; what is summed and sent to the
driver is bounded by the vocabulary times the classes. The weights of the model
(:mod:`pixelweave.llm.lm_model`) are learned from every block of every training document, where
the kept ids lie: each block teaches in one of a few rounds, in which every task starts from the
same weights and learns from the blocks of its own documents, and Spark sums what they changed, by the
number of their blocks. The weights thus depend on how the documents lie in partitions, as the
order of any stochastic descent does. Nothing but counts and weights reaches the driver; tasks
score the kept ids in overlapping windows.

Word counts of the corpus are summed over ranges of word hashes, from one sorted array for each
block and range; each block gets the counts of its own words back, and its documents their base
score. So what is shuffled grows with the distinct words of blocks, no word's rows meet in one
task, and the only numbers that reach the driver are the corpus totals.

Cases: a null text is empty, its only token is the end; without training documents every count is
zero (V and N too); a null id is of the training share; repeated rows count each time and get equal
scores; extra columns are not returned; an empty table gives an empty result.
"""

from __future__ import annotations

import copy
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweave.llm._common import chunks, column, encoded, stage
from pixelweave.llm._tokens import tokenizer_path, word_ids
from pixelweave.llm.lm_model import BEGIN, BLOCK, HEADS, NONE, START, WINDOW, CausalModel, Trainer

VOCABULARY, END = 49_408, 49_407
ADDED = 0.1
#: Text, in bytes, whose distinct words are listed together; and characters of text for each range of hashes.
BLOCK_BYTES = 6 << 20
RANGE_CHARS = 50_000_000
#: Cells of a table of counts, or weights, that are summed together.
SLICE = 8192
#: Rounds of training, windows that are drawn in an order of their own, least steps of a trainer in a round: one that has less than a piece repeats it.
ROUNDS, PIECE, STEPS = 4, 12_800, 200
#: Ids handled together, in bytes.
IDS_BYTES = 1 << 18


def release() -> None:
    """Lets go of the words and tokenizers that a worker kept from reading, and of what Arrow holds unused: later stages need neither."""
    word_ids.cache_clear()
    pa.default_memory_pool().release_unused()


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts end to end, each closed by the end, and what stands before each id (the vocabulary's size at the start)."""
    raw = texts.to_pylist()
    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) // 2
    ends = np.cumsum(lengths + 1) - 1
    own = np.full(len(raw) + int(lengths.sum()), END, np.int64)
    inside = np.ones(len(own), np.bool_)
    inside[ends] = False
    own[inside] = np.frombuffer(b"".join(raw), "<u2")
    before = np.roll(own, 1)
    before[ends - lengths] = VOCABULARY
    return before, own


def tallied(texts: DataFrame, keys, cells: int) -> np.ndarray:
    """Counts of the numbers that ``keys(before, own)`` gives for ids and what stands before them."""

    def run(batches):
        release()
        total = np.zeros(cells, np.int32)
        for batch in batches:
            for part in chunks(batch, 0, IDS_BYTES):
                np.add.at(total, keys(*sequences(part.column(0))), np.int32(1))  # of the table's type: far faster than a number to be cast
        for i in range(0, cells, SLICE):
            at = np.flatnonzero(total[i : i + SLICE])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([total[i + at].tobytes()], pa.binary())], names=["slice", "at", "n"])

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for at, n in zip(table["at"].to_pylist(), table["n"].to_pylist(), strict=True):
            total[np.frombuffer(at, "<u2")] += np.frombuffer(n, np.int32)
        return pa.table({"slice": table["slice"][:1], "n": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(-(-cells // SLICE) * SLICE, np.int64)
    for at, n in texts.select("ids").mapInArrow(run, "slice long, at binary, n binary").groupBy("slice").applyInArrow(added, "slice long, n binary").collect():
        out[at : at + SLICE] = np.frombuffer(n, np.int64)
    return out[:cells]


def windows(raw: list[bytes], first: int = 0, every: int = 1) -> tuple[np.ndarray, int]:
    """Training windows of the blocks of texts, from the ``first`` on one of ``every``; and how many blocks there are."""
    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) // 2
    blocks = -(-(lengths + 1) // BLOCK)
    sizes = BLOCK * (blocks + 1) + 1
    start = np.cumsum(sizes) - sizes
    laid = np.full(int(sizes.sum()), NONE, "<u2")
    laid[start + BLOCK] = BEGIN
    flat = np.frombuffer(b"".join(raw), "<u2")
    laid[np.arange(len(flat)) + np.repeat(start + BLOCK + 1 - (np.cumsum(lengths) - lengths), lengths)] = flat
    laid[start + BLOCK + 1 + lengths] = END
    place = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return laid[(np.repeat(start, blocks) + place * BLOCK)[first::every, None] + np.arange(WINDOW)], len(place)


def train(texts: DataFrame) -> CausalModel:
    """A model of training documents: counts of all their ids, weights from all their blocks."""
    model, spark = CausalModel(VOCABULARY, END), texts.sparkSession
    head = model.heads(tallied(texts, lambda before, own: own, VOCABULARY))
    row, size = np.append(model.row, START), len(head)
    cls = model.classes(tallied(texts, lambda before, own: head[row[before]] * size + row[own], (HEADS + 1) * size).reshape(-1, size)).astype(np.int64)
    cells = (model.n_classes + 1) * size

    def neighbours(before, own):
        before, own = row[before], row[own]
        return np.concatenate([cls[before] * size + own, cells + cls[own] * size + before])

    found = tallied(texts, neighbours, cells + model.n_classes * size)
    model.shares(found[:cells].reshape(-1, size), found[cells:].reshape(-1, size))
    blocks = texts.agg(F.sum(F.ceil((F.length("ids") / 2 + 1) / BLOCK))).first()[0] or 0
    trainers = max(1, min(texts.rdd.getNumPartitions(), int(blocks) // (ROUNDS * PIECE)))
    some = texts.select("ids").coalesce(trainers)
    weights = model.begin()
    met = np.zeros(len(weights["e"]), np.bool_)
    light = copy.copy(model)
    light.after = light.count = None  # trainers need no shares of ids in classes
    shared = spark.sparkContext.broadcast(light)
    for i in range(ROUNDS):
        weights, new = averaged(some, shared, weights, i, blocks / (ROUNDS * trainers))
        met |= new
    shared.unpersist()
    return model.freeze(weights, met)


def averaged(some: DataFrame, model, weights: dict[str, np.ndarray], round_: int, expected: float) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """``weights`` after a round: with the mean of what the trainers of ``some`` partitions change in them, by their blocks (rows of ``e``: of those that met them), and the rows met."""
    names, d = sorted(weights), weights["e"].shape[1]
    flat = lambda w: np.concatenate([w[k].ravel() for k in names])
    now = some.sparkSession.sparkContext.broadcast(weights)

    def learn(batches):
        trainer = Trainer(model.value, now.value, round_ / ROUNDS, (round_ + 1) / ROUNDS, expected)
        held, n, all_, next_ = [], 0, 0, round_
        for batch in batches:
            for part in chunks(batch, 0, 4 * IDS_BYTES):
                found, blocks = windows(part.column(0).to_pylist(), next_, ROUNDS)
                next_ = (next_ - blocks) % ROUNDS
                held.append(found)
                n += len(held[-1])
                if n >= PIECE:
                    trainer.learn(np.concatenate(held))
                    held, n, all_ = [], 0, all_ + n
        if n:
            trainer.learn(np.concatenate(held), 0 if all_ else STEPS)
        if not all_ + n:
            return
        change = (flat(trainer.w) - flat(now.value)) * np.float32(all_ + n)
        by = flat({k: np.repeat(trainer.met, d) if k == "e" else np.ones(v.size) for k, v in trainer.w.items()}).astype(np.float32) * np.float32(all_ + n)
        at, part = range(0, len(change), SLICE), TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([part] * len(at)), *(pa.array([x[i : i + SLICE].tobytes() for i in at], pa.binary()) for x in (change, by))], names=["slice", "part", "change", "met"])

    def added(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")  # sums do not hang on the order in which tasks end
        return pa.table({"slice": table["slice"][:1], **{k: pa.array([sum(np.frombuffer(x, np.float32).astype(float) for x in table[k].to_pylist()).tobytes()], pa.binary()) for k in ("change", "met")}})

    before = flat(weights)
    change, by = np.zeros(len(before)), np.zeros(len(before))
    for i, x, n in some.mapInArrow(learn, "slice long, part long, change binary, met binary").groupBy("slice").applyInArrow(added, "slice long, change binary, met binary").collect():
        change[i : i + SLICE], by[i : i + SLICE] = np.frombuffer(x), np.frombuffer(n)
    now.unpersist()
    after, out, met, at = (before + change / np.maximum(1, by)).astype(np.float32), {}, None, 0
    for k in names:
        to_ = at + weights[k].size
        out[k] = after[at:to_].reshape(weights[k].shape)
        if k == "e":
            met = by[at:to_:d] > 0
        at = to_
    return out, met


def fitting(counts: np.ndarray) -> bytes:
    """Counts as 16-bit numbers if they fit, else as 32-bit ones."""
    return counts.astype("<u2" if not len(counts) or counts.max() < 1 << 16 else "<u4").tobytes()


def read(docs: DataFrame, ranges: int, path: str) -> DataFrame:
    """A row for each document (``r`` null) and, for each block and range of hashes, one for its distinct words.

    ``a`` and ``b``: a document's words, by their place in the block's list, and their counts; or the
    hashes of the list and their counts in training documents. ``ids``: a document's subword ids.
    """

    def run(batches):
        coder = word_ids(path)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in chunks(batch, 2, BLOCK_BYTES):
                texts = [t.lower() for t in encoded(part.column(2))]
                own = part.column(1).to_numpy(zero_copy_only=False)
                at, known, ends, id_ends, found = coder.encode(texts)
                sizes = np.diff(ends, prepend=0)
                found = found.astype("<u2").tobytes()
                ids = [found[2 * i : 2 * j] for i, j in zip([0, *id_ends[:-1].tolist()], id_ends.tolist())]
                counted = np.bincount(at, np.repeat(own, sizes), len(known)).astype(np.int64)
                a, b, start = [], [], 0
                for n in sizes.tolist():
                    mine = np.sort(at[start : start + n])
                    start += n
                    first = np.flatnonzero(np.diff(mine, prepend=-1))
                    a.append(mine[first].astype("<u4").tobytes())
                    b.append(fitting(np.diff(np.append(first, n))))
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.int64()), pa.nulls(n, pa.int32()), part.column(0), part.column(1), pa.array(sizes + 1), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(ids, pa.binary())],
                    names=names,
                )
                edge = np.searchsorted(known, np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64))
                cut = np.concatenate([[0], edge, [len(known)]]).tolist()
                have = [i for i in range(ranges) if cut[i + 1] > cut[i]]
                m = len(have)
                lists = [pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in have], pa.binary()) for x in (known, counted.astype("<u4"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * m, pa.int64()), pa.array(have, pa.int32()), pa.nulls(m, part.column(0).type), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), *lists, pa.nulls(m, pa.binary())], names=names
                )
                block += 1

    out = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("r", T.IntegerType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("training", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("ids", T.BinaryType())]
    )
    names = [f.name for f in out.fields]
    return docs.mapInArrow(run, out)


def judged_by(own: DataFrame, model) -> DataFrame:
    """The rows of documents with ``score``, without their ids."""

    def run(batches):
        release()
        for batch in batches:
            for part in chunks(batch, by, IDS_BYTES):
                raw = part.column(by).to_pylist()
                score = model.value.score(np.frombuffer(b"".join(raw), "<u2"), np.fromiter(map(len, raw), np.int64, len(raw)) // 2)
                yield pa.RecordBatch.from_arrays([*part.columns[:by], pa.array(score)], names=names)

    own = own.select("block", "doc_id", "training", "n_tokens", "a", "b", "ids")
    by = len(own.columns) - 1
    names = [*own.columns[:by], "score"]
    return own.mapInArrow(run, T.StructType([*own.schema.fields[:by], T.StructField("score", T.DoubleType())]))


def summed(table: pa.Table) -> pa.Table:
    """For a range of hashes: each block's words with their counts in all blocks, and the range's totals on one row."""
    lists = [np.frombuffer(x, np.uint64) for x in table["a"].to_pylist()]
    known, at = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(at, np.concatenate([np.frombuffer(x, "<u4") for x in table["b"].to_pylist()]), len(known)).astype(np.int64)
    cut = np.cumsum([0, *map(len, lists)]).tolist()
    rest = [0] * (len(lists) - 1)
    return pa.table(
        {
            "block": table["block"], "r": table["r"], "c": pa.array([total[at[i:j]].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
            "kinds": pa.array([int((total > 0).sum()), *rest], pa.int64()), "words": pa.array([int(total.sum()), *rest], pa.int64()),
        }
    )


def score(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Columns doc_id, training, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs``.

    Rows for which ``training`` holds are learned from, all of them in whole.
    """
    path = path or tokenizer_path()
    rows = docs.select(column(doc_id).alias("doc_id"), F.coalesce(training, F.lit(True)).alias("training"), column(text).alias("text"))
    learned, chars = rows.agg(F.sum(F.col("training").cast("long")), F.sum(F.length("text"))).first()
    learned = learned or 0
    seen = stage(read(rows, max(1, math.ceil((chars or 0) / RANGE_CHARS)), path), "lm-read")
    counts = stage(seen.filter("r is not null").select("block", "r", "a", "b").groupBy("r").applyInArrow(summed, "block long, r int, c binary, kinds long, words long"), "lm-counts")
    kinds, n = counts.agg(F.sum("kinds"), F.sum("words")).first()
    n, kinds = (n or 0) + learned, (kinds or 0) + (learned > 0)
    below = math.log10(n + ADDED * (kinds + 1))
    end = math.log10(learned + ADDED) - below

    def judged(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = right.sort_by("r")["c"].to_pylist()
        c = np.frombuffer(b"".join(lists), np.int64)
        value = np.log10(c + ADDED) - below
        base, known = [], []
        for a, b in zip(left["a"].to_pylist(), left["b"].to_pylist(), strict=True):
            at = np.frombuffer(a, "<u4")
            times = np.frombuffer(b, "<u2" if 2 * len(at) == len(b) else "<u4").astype(np.int64)
            base.append(float(value[at] @ times) + end)
            known.append(int(times[c[at] > 0].sum()) + (learned > 0))
        return pa.table({"doc_id": left["doc_id"], "training": left["training"], "n_tokens": left["n_tokens"], "n_known": pa.array(known, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": left["score"]})

    out = T.StructType([rows.schema["doc_id"], T.StructField("training", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    own = seen.filter("r is null")
    shared = docs.sparkSession.sparkContext.broadcast(train(own.filter("training")))
    scored = judged_by(own, shared).groupBy("block").cogroup(counts.select("block", "r", "c").groupBy("block")).applyInArrow(judged, out)
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))
