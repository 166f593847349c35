"""Operator 7, SimHash near-duplicates: 64-bit fingerprints linked through BK-trees.

A fingerprint bit is set if it is set in over half the XXH64 hashes (seed 42) of a text's
three-word shingles. Two fingerprints that differ in at most three bits agree in whole on one of
four 16-bit bands at least (on two of five, three of six where more documents call for longer
keys), so the shards are the values of a band. A task builds the BK-tree of each shard it reads:
children are keyed by their integer Hamming distance to the parent, and a search follows only
edges within the radius. Trees grow with the data, so they aren't broadcast as a whole: a shard's
tree meets its searches in one task. A shard beyond ``most`` is keyed once more by sub-bands of
its other bits, which again loses no pair.

Only distinct fingerprints enter the trees, and a shard returns one link for each component that a
fingerprint joins, never all pairs. A search passes by the subtrees whose values are all in its own
component already, so that a shard of near copies of one text takes no quadratic time. Components come from
:func:`pixelweave.llm._graph.components`.

Cases: a null or blank text has fingerprint zero and links like any other; fewer than three words
make one shingle of them all; repeated rows and equal texts share a component; a null doc_id gets
a fingerprint and takes part, and a component of null ids only has a null id; extra columns are
not returned by :func:`near_duplicates`; empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweave.llm._common import attach, encoded, stage
from pixelweave.llm._graph import components

RADIUS = 3
#: Fingerprints in a shard up to which it has one tree.
MOST = 20_000
#: A fingerprint is hot if it is that of more documents than this, and of more than one in ``GROUPS`` of all.
COPIES, GROUPS = 1_000, 10_000


def fingerprint(text: bytes, width: int = 3) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = (np.concatenate([[0], ends[:-width] + 1])).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        total += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """Each row with ``fp``, its fingerprint as a signed long."""
    by = [c for c in docs.columns if c.lower() != "fp"].index(text)

    def kernel():
        def run(part: pa.RecordBatch) -> list:
            values = np.array([fingerprint(t, width) for t in encoded(part.column(by))], np.uint64)
            return [pa.array(values.view(np.int64))]

        return run

    return attach(docs, [T.StructField("fp", T.LongType())], kernel, text)


class BKTree:
    """Values by their distance to the parent, and which of them are connected within the radius.

    A node is [value, {distance: child}, whole]; ``whole`` says that its subtree is one component. A value
    that already belongs to that component need not look there, so dense groups cost no pairs.
    """

    def __init__(self, radius: int = RADIUS) -> None:
        self.radius, self.root = radius, None
        self.over: dict[int, int] = {}
        #: Differences of an edge to a distance that a search follows, the largest first.
        self.edges = sorted(range(-radius, radius + 1), key=lambda k: -abs(k))

    def component(self, value: int) -> int:
        over = self.over
        while over[value] != value:
            over[value] = over[over[value]]
            value = over[value]
        return value

    def add(self, value: int) -> list[int]:
        """Insert a value; gives one value of each component that it touches (all are one component from then on)."""
        over, radius, component = self.over, self.radius, self.component
        over[value] = own = value
        if self.root is None:
            self.root = [value, {}, True]
            return []
        found, to_see = [], [self.root]
        while to_see:
            at = to_see.pop()
            other = component(at[0])
            if at[2] and other == own:
                continue
            d = (value ^ at[0]).bit_count()
            if d <= radius:
                if other != own:
                    found.append(at[0])
                    over[other] = own
                if at[2]:
                    continue
            if at[1]:
                for k in self.edges:  # the likeliest child is pushed last and so seen first
                    if (child := at[1].get(d + k)) is not None:
                        to_see.append(child)
        node, d = self.root, (value ^ self.root[0]).bit_count()
        path = [node]
        while d in node[1]:
            node = node[1][d]
            path.append(node)
            d = (value ^ node[0]).bit_count()
        if d:
            node[1][d] = [value, {}, True]
        for at in reversed(path):
            same = component(at[0])
            at[2] = (at[2] and same == own) or all(x[2] and component(x[0]) == same for x in at[1].values())
        return found


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect what lies within the radius in one shard: one at most for each value and component."""
    tree = BKTree(radius)
    return [(v, near) for v in values for near in tree.add(v)]


def bands(n: int) -> int:
    """Bands for ``n`` fingerprints: keys of 16, about 25 or about 32 bits."""
    return 4 if n < 1 << 22 else 5 if n < 1 << 28 else 6


def links(fps: DataFrame, n: int, most: int = MOST, radius: int = RADIUS) -> DataFrame:
    """Pairs ``a``, ``b`` of distinct fingerprints that connect all within the radius."""
    k = bands(n)
    edges = [round(64 * i / k) for i in range(k + 1)]
    keys = []
    for j, held in enumerate(combinations(range(k), k - radius)):
        mask = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in held)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(j), F.col("fp").bitwiseAND(F.lit(signed).cast("long"))))
    keyed = fps.select("fp", F.posexplode(F.array(*keys)).alias("band", "key"))
    sizes = keyed.groupBy("band", "key").count().filter("count > 1")
    hot = sizes.filter(F.col("count") > most)
    few = keyed.join(sizes.filter(F.col("count") <= most), ["band", "key"], "left_semi")
    # a pair of a hot shard differs in three bits at most: one of these four cuts of the fingerprint is equal
    mixed = [F.xxhash64(F.lit(i), F.col("band"), F.col("key"), F.shiftrightunsigned("fp", 0).bitwiseAND(F.lit(_comb(i)).cast("long"))) for i in range(radius + 1)]
    split = keyed.join(hot, ["band", "key"], "left_semi").select("fp", F.posexplode(F.array(*mixed)).alias("cut", "sub"))
    split = split.select("fp", (F.col("cut") + 1000).alias("band"), F.col("sub").alias("key"))

    def run(batches):
        held: tuple | None = None
        values: list[int] = []
        for batch in batches:
            band, key, fp = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for b, k_, f in zip(band, key, fp):
                if (b, k_) != held:
                    out += shard_links(values, radius) if len(values) > 1 else []
                    held, values = (b, k_), []
                values.append(f & 0xFFFFFFFFFFFFFFFF)
            if out:
                yield _pairs(out)
        if len(values) > 1 and (out := shard_links(values, radius)):
            yield _pairs(out)

    both = few.select("band", "key", "fp").union(split.select("band", "key", "fp"))
    dealt = both.repartition("band", "key").sortWithinPartitions("band", "key", "fp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _comb(i: int, parts: int = RADIUS + 1) -> int:
    """Every fourth bit from bit ``i`` on: cuts across the bands, so that a hot band's values spread."""
    mask = sum(1 << b for b in range(i, 64, parts))
    return mask - (1 << 64) if mask >> 63 else mask


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(pairs, np.uint64).view(np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """Columns ``doc_id``, ``fp`` and ``component_id`` (least doc_id reachable), a row for each document."""
    return _grouped(docs, doc_id, text, most).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, doc_id: str, text: str, most: int = MOST) -> DataFrame:
    """Columns ``doc_id``, ``u`` (hash of id and text), ``fp`` and ``component_id``."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("u"), F.col(text).alias("text"))
    own = stage(fingerprints(own, "text").select("doc_id", "u", "fp"), "simhash")
    least = stage(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-distinct")
    different, total = least.agg(F.count("*"), F.sum("n")).first()
    parts = components(links(least.select("fp"), different, most))
    # a component's least document, by fingerprint; all others stand alone
    grouped = parts.join(least, parts.node == least.fp)
    lowest = grouped.groupBy("component").agg(F.min("first").alias("low"))
    moved = grouped.join(lowest, "component").select("fp", "low")
    final = stage(least.join(moved, "fp", "left").select("fp", "n", F.coalesce("low", "first").alias("component_id")), "simhash-components")
    # documents of hot fingerprints don't meet in one task: fewer than GROUPS fingerprints can be hot, so these are broadcast
    bound = max(COPIES, (total or 0) // GROUPS)
    hot = F.broadcast(final.filter(F.col("n") > bound).select("fp", "component_id", F.lit(True).alias("hot")))
    marked = own.join(hot, "fp", "left")
    some = marked.filter("hot").select("doc_id", "u", "fp", "component_id")
    rest = marked.filter("hot is null").select("doc_id", "u", "fp").join(final.filter(F.col("n") <= bound).select("fp", "component_id"), "fp")
    return some.union(rest.select("doc_id", "u", "fp", "component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one document of each near-duplicate group (that with the least id).

    Of repeated rows (equal id and text) one stays; rows without an id stay.
    """
    marked = stage(_grouped(docs, doc_id, text), "simhash-groups")
    u = F.xxhash64(F.col(doc_id), F.col(text))
    later = marked.filter("doc_id <> component_id").select("u")
    twice = stage(marked.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "simhash-twice")
    if twice.isEmpty():
        later = later.distinct()
        return docs.join(later, u == later.u, "left_anti").select(docs.columns)
    # one id with several texts in a group: the text of the least hash stays
    leaders = marked.filter("doc_id = component_id").join(twice, "doc_id", "left_semi")
    kept = leaders.groupBy("doc_id").agg(F.min("u").alias("kept"))
    later = later.union(leaders.join(kept, "doc_id").filter("u <> kept").select("u")).distinct()
    left = docs.join(later, u == later.u, "left_anti").select(docs.columns)
    again = twice.withColumnRenamed("doc_id", doc_id)
    return left.join(again, doc_id, "left_anti").select(docs.columns).union(left.join(again, doc_id, "left_semi").select(docs.columns).dropDuplicates([doc_id, text]))
