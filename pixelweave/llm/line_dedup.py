"""Operator 3, line deduplication: an exact set-similarity join of lines.

A line is the set of its words (parted by white space). A line is removed if an earlier line has a
Jaccard similarity of ``threshold`` or more with it; "earlier" goes by doc_id, then by line number.
Removed lines count as earlier ones too, so the result doesn't hang on the order of work.

Every class of equal sets is reduced to its first line. The words of a set are ordered by rarity;
the counts are taken over all lines into a table of fixed size by hash, which any order may use
without loss. Sets that are similar share a word in their prefixes, so prefixes meet by word, and a
pair stays if lengths, positions and a 64-bit parity map of the sets allow the overlap. Each set
meets the ``FEW`` earliest such partners of each word, and Spark joins the words of both to verify
the Jaccard similarity; only sets whose first partners all failed meet the others. Words that are more
frequent than ``HOT`` are counted and their groups cut into tiles, so no group is unbounded.

Cases: blank lines have no words and stay; a null text has no lines and stays null; a text whose
lines all go becomes empty, the row stays; rows without an id come last in the order; rows of equal
id and text are one document and lose the same lines; equal lines within a document go but the
first; extra columns pass through, one named as a result is replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweave.llm._common import attach, chunks, column, encoded, stage, without

THRESHOLD = 0.8
#: Buckets of the table of word counts, as a power of two; its size doesn't depend on the data.
COUNT_BITS = 20
#: Words seen more often are cut into tiles of so many sets.
HOT = 20_000
#: Bits of the filter that picks the lines to verify: so many for each line, within these powers of two (128 MB at most).
PICK_EACH, PICK_LEAST, PICK_MOST = 16, 16, 30
FIELDS = [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]
ORDER = ["d", "u", "line"]
EPS = 1e-9
#: Sets from this size on are compared by maps of so many 64-bit words, as 64 bits tell long sets apart no more.
LONG, WORDS = 100, 8
#: Partners of a set that are verified for each word before the question arises whether others are needed.
FEW = 32
BASE, REACH = 0x9E3779B97F4A7C15, 1 << 17
#: Bytes that are taken at once: few enough for arrays of 64-bit numbers to stay in a cache.
PIECE = 1 << 16
#: Powers of the odd number ``BASE`` modulo 2**64 from its first on, and of its inverse from its zeroth on.
POWERS = np.cumprod(np.full(REACH, BASE, np.uint64))
INVERSES = np.append(np.uint64(1), np.cumprod(np.full(REACH - 1, pow(BASE, -1, 1 << 64), np.uint64)))


def mixed(h: np.ndarray, by: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(by)
    return h ^ (h >> np.uint64(29))


def blank(b: np.ndarray) -> np.ndarray:
    """Which bytes are white space; comparisons take a tenth of the time of a table."""
    return (b == 32) | (b - np.uint8(9) < 5)


def spans(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and first byte of each word; the text is taken in pieces that end with white space."""
    b = np.frombuffer(joined, np.uint8)
    white = blank(b)
    found, at = [], 0
    while at < len(b):
        to = at + PIECE
        if to < len(b):
            own = white[at:to]
            if own.any():
                to -= int(own[::-1].argmax())
            else:  # a word longer than a piece
                rest = white[to:]
                to += int(rest.argmax()) if rest.any() else len(rest)
        h, starts = _spans(b[at:to], white[at:to])
        starts += at
        found.append((h, starts))
        at = to
    return tuple(np.concatenate(x) for x in zip(*found)) if found else _spans(b, white)


def _spans(b: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dark = ~white
    first = dark.copy()
    first[1:] &= white[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    value = ((b.astype(np.uint16) + np.uint16(1)) * dark).astype(np.uint64)
    if len(b) <= REACH:
        value *= POWERS[: len(b)]
    else:  # the same, by the place of each byte in its word
        value *= POWERS[(np.arange(len(b)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(b)]])))) % REACH]
    # a word's sum is a difference of running sums, exact modulo 2**64
    total = np.cumsum(value, out=value)
    before = total[starts[1:] - 1]
    sums = np.append(before, total[-1])
    sums[1:] -= before
    if len(b) <= REACH:
        sums *= INVERSES[starts]
    return mixed(sums, 0xBF58476D1CE4E5B9), starts


def words(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word, and the number of the line it stands in."""
    hashes, starts = spans(joined)
    ends = np.searchsorted(starts, np.flatnonzero(np.frombuffer(joined, np.uint8) == 10))
    return hashes, np.repeat(np.arange(len(ends) + 1), np.diff(np.concatenate([[0], ends, [len(starts)]])))


def word_sets(joined: bytes, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each line, rarest first: their ranks, the bounds of lines in them, the lines' numbers."""
    h, line = words(joined)
    rank = (levels[h >> np.uint64(64 - COUNT_BITS)].astype(np.uint64) << np.uint64(56)) | (h & np.uint64((1 << 56) - 1))
    cut = np.append(np.flatnonzero(np.diff(line, prepend=-1)), len(line))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        rank[a:b].sort()
    new = np.ones(len(rank), np.bool_)
    new[1:] = (rank[1:] != rank[:-1]) | (line[1:] != line[:-1])
    rank, line = rank[new], line[new]
    at = np.flatnonzero(np.diff(line, prepend=-1))
    return rank, np.append(at, len(rank)), line[at]


def laid(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The texts as one, and the number of the first line of each."""
    first = np.cumsum([0] + [t.count(b"\n") + 1 for t in texts])
    return b"\n".join(texts), first


def word_levels(rows: DataFrame, by: int = 2, block: int = 1 << 14) -> np.ndarray:
    """Rarity level of each bucket of words: eight times the binary logarithm of its count over all of ``rows``."""
    size = 1 << COUNT_BITS

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in chunks(batch, by, 1 << 19):
                h, _ = spans(laid(encoded(part.column(by)))[0])
                np.add.at(total, (h >> np.uint64(64 - COUNT_BITS)).view(np.int64), 1)  # not a table of all buckets for every chunk
        for i in range(0, size, block):
            if (own := total[i : i + block]).any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([own.tobytes()])], names=["block", "counts"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table["counts"].to_pylist())
        return pa.table({"block": table["block"][:1], "counts": pa.array([total.tobytes()])})

    out = np.zeros(size)
    for i, counts in rows.mapInArrow(count, "block long, counts binary").groupBy("block").applyInArrow(added, "block long, counts binary").collect():
        out[i : i + block] = np.frombuffer(counts, np.int64)
    return np.minimum(255, 8 * np.log2(np.maximum(out, 1))).astype(np.uint8)


def line_sets(rows: DataFrame, levels, threshold: float) -> DataFrame:
    """A row for each line with words: its place (d, u, line), size, hashes of its set, and its prefix as word keys.

    The key of a word that may be in too many sets for one group is negative. ``wide`` has the map of a long set.
    """
    limit = int(8 * math.log2(HOT))

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 2, 1 << 19):
                joined, first = laid(encoded(part.column(2)))
                rank, cut, line = word_sets(joined, levels.value)
                if not len(line):
                    continue
                n = np.diff(cut)
                doc = np.searchsorted(first, line, side="right") - 1
                spread = mixed(rank, 0xD6E8FEB86659FD93)
                bit = np.uint64(1) << (spread >> np.uint64(58))
                wide = np.flatnonzero(n >= LONG * threshold)
                inside = np.flatnonzero(np.repeat(n >= LONG * threshold, n))
                maps = np.zeros((len(wide), WORDS), np.uint64)
                if len(wide):
                    word, cuts = (spread[inside] >> np.uint64(50)) % np.uint64(WORDS), np.cumsum(n[wide]) - n[wide]
                    for i in range(WORDS):
                        maps[:, i] = np.bitwise_xor.reduceat(np.where(word == i, bit[inside], np.uint64(0)), cuts)
                widths = np.zeros(len(n), np.int64)
                widths[wide] = WORDS
                # a set is most like one with a word more; too small sets are like none but their equals
                keep = np.where(n < (threshold - EPS) * (n + 1), 0, n - np.ceil(threshold * n - EPS).astype(np.int64) + 1)
                ends = np.cumsum(keep)
                at = np.arange(ends[-1]) + np.repeat(cut[:-1] - ends + keep, keep)
                own = rank[at]
                key = (own & np.uint64(0x7FFFFFFF)).astype(np.int32) | np.where(own >> np.uint64(56) >= limit, np.int32(-(1 << 31)), np.int32(0))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)), pa.array((line - first[doc]).astype(np.int32)), pa.array(n.astype(np.int32)),
                        pa.array(np.add.reduceat(mixed(rank, 0x94D049BB133111EB), cut[:-1]).view(np.int64)), pa.array(np.bitwise_xor.reduceat(bit, cut[:-1]).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(key)),
                        pa.ListArray.from_arrays(pa.array(np.append(0, widths.cumsum()).astype(np.int32)), pa.array(maps.ravel().view(np.int64))),
                    ],
                    names=["d", "u", "line", "n", "s", "bits", "prefix", "wide"],
                )

    return rows.mapInArrow(run, "d long, u long, line int, n int, s long, bits long, prefix array<int>, wide array<long>")


def compare(key: np.ndarray, ids: np.ndarray, n: np.ndarray, pos: np.ndarray, opened: np.ndarray, bits: np.ndarray, threshold: float, every: bool) -> pa.Table:
    """Pairs (x after y) that a shared prefix word and the filters allow; ``bits`` has a row of words for each set.

    For each word and x the ``FEW`` earliest y, and whether there are ``more``; with ``every`` all of them for the x in ``opened``.
    """
    order = np.lexsort((ids, key))
    key, ids, n, pos, bits = (c[order] for c in (key, ids, n.astype(np.int64), pos.astype(np.int64), bits))
    size = len(key)
    new = np.ones(size, np.bool_)
    new[1:] = key[1:] != key[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(size), 0))
    live, k = np.flatnonzero(opened[order]) if every else np.arange(size), 0
    count = np.zeros(size, np.int64)
    found = [np.zeros((2, 0), np.int64)]
    while len(live := live[live > start[live] + k]):  # against the earliest of the group, the next one, and so on
        other = start[live] + k
        k += 1
        small, large = np.minimum(n[live], n[other]), np.maximum(n[live], n[other])
        need = np.ceil(threshold / (1 + threshold) * (small + large) - EPS)
        ok = (small >= threshold * large - EPS) & (np.minimum(n[live] - pos[live], n[other] - pos[other]) >= need)
        x, y = live[ok], other[ok]
        ok = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) <= n[x] + n[y] - 2 * need[ok]
        x, y = x[ok], y[ok]
        if len(x):
            count[x] += 1
            found.append(np.stack([x, y])[:, count[x] <= FEW] if not every else np.stack([x, y]))
            live = live if every else live[count[live] <= FEW]
    x, y = np.concatenate(found, axis=1)
    more = (count[x] > FEW) & (not every)
    return pa.table({"x": ids[x], "y": ids[y], "more": pa.array(more)})


PAIR = "x long, y long, more boolean"
KINDS = {"key": np.int32, "id": np.int64, "n": np.int32, "pos": np.int32, "open": np.bool_, "map": np.uint64}


def partners(firsts: DataFrame, threshold: float, hot: int, cells=None, in_range: int = 300_000) -> DataFrame:
    """Pairs x, y (with ``more``) from the prefixes of ``firsts(id, n, bits, wide, prefix, open)``.

    Words that can't be too frequent travel packed, by ranges of their keys; all others as rows, in tiles.
    Short and long sets meet apart, sets near the bound in either way. ``cells`` (a bitmap of key buckets)
    narrows the words; then the ``open`` sets get all their partners.
    """
    total = firsts.agg(F.sum(F.size("prefix"))).first()[0] or 0
    ranges, every = max(1, math.ceil(total / in_range)), cells is not None

    def packed(parts: list[pa.RecordBatch]):
        own = pa.Table.from_batches(parts).combine_chunks()
        lists, wide = own["prefix"].combine_chunks(), own["wide"].combine_chunks()
        count, ids, n, opened, bits = np.diff(lists.offsets.to_numpy()), own["id"].to_numpy(), own["n"].to_numpy(), own["open"].to_numpy(), own["bits"].to_numpy().view(np.uint64)
        key = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(count)), count)
        pos = (np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
        cold = key >= 0
        if every:
            cold &= cells.value[key & 0xFFFF]
        has = np.diff(wide.offsets.to_numpy()) > 0
        line = np.cumsum(has) - 1
        maps = wide.flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
        for long_, some in ((False, cold & (n < LONG)[row]), (True, cold & has[row])):
            k, i, q = key[some], row[some], pos[some]
            r = (k.astype(np.int64) * ranges) >> 31
            order = np.argsort(r, kind="stable")
            cut = np.searchsorted(r[order], np.arange(ranges + 1)).tolist()
            k, i, q = k[order], i[order], q[order]
            cols = [k, ids[i], n[i], q, opened[i], maps[line[i]] if long_ else bits[i]]
            have = [j for j in range(ranges) if cut[j + 1] > cut[j]]
            numbers = pa.array([j + long_ * ranges for j in have], pa.int32())
            yield pa.RecordBatch.from_arrays([numbers, *(pa.array([c[cut[j] : cut[j + 1]].tobytes() for j in have], pa.binary()) for c in cols)], names=["r", *KINDS])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(4).flatten())
            if size >= 1 << 20:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    def met(table: pa.Table) -> pa.Table:
        c = {k: np.frombuffer(b"".join(table[k].to_pylist()), t) for k, t in KINDS.items()}
        width = WORDS if table["r"][0].as_py() >= ranges else 1
        return compare(*(c[k] for k in list(KINDS)[:-1]), c["map"].reshape(-1, width), threshold, every)

    rows = firsts.select("id", "n", "bits", "wide", "prefix", "open")
    packs = rows.mapInArrow(run, "r int, key binary, id binary, n binary, pos binary, open binary, map binary")
    return packs.groupBy("r").applyInArrow(met, PAIR).union(in_tiles(rows, threshold, hot, every))


def in_tiles(rows: DataFrame, threshold: float, hot: int, every: bool) -> DataFrame:
    """The pairs that meet by words with negative keys: the sets of a word are cut into tiles any two of which meet."""
    frequent = rows.filter(F.array_min("prefix") < 0).select("id", "n", "open", "wide", "bits", F.posexplode("prefix").alias("pos", "key")).filter("key < 0")
    short = frequent.filter(F.col("n") < LONG).select("id", "n", "open", "pos", "key", F.array("bits").alias("map"))
    both = short.union(frequent.filter(F.size("wide") > 0).select("id", "n", "open", "pos", "key", "wide")).withColumn("width", F.size("map"))
    postings = stage(both, "lines-tiles")
    sizes = postings.groupBy("key", "width").count().select("key", "width", F.ceil(F.col("count") / hot).cast("int").alias("m"))
    own = F.pmod(F.xxhash64("id"), F.col("m")).cast("int")
    tile = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.least("own", j) * F.col("m") + F.greatest("own", j))
    cut = postings.join(sizes, ["key", "width"]).withColumn("own", own).withColumn("tile", F.explode(tile))

    def met(table: pa.Table) -> pa.Table:
        c = [table[k].to_numpy() for k in list(KINDS)[:-1]]
        return compare(*c, np.array(table["map"].combine_chunks().flatten()).view(np.uint64).reshape(table.num_rows, -1), threshold, every)

    return cut.select("key", "width", "tile", "id", "n", "pos", "open", "map").groupBy("key", "width", "tile").applyInArrow(met, PAIR)


def picked(places: DataFrame) -> np.ndarray:
    """A filter over the places ``u, line``: bits by hash, in bytes, sized by the number of places."""
    power = min(PICK_MOST, max(PICK_LEAST, math.ceil(math.log2(PICK_EACH * places.count() + 1))))
    mask = (1 << power) - 1
    at = (F.col("u").bitwiseAND(F.lit(mask)) + F.col("line").cast("long") * 7919).bitwiseAND(F.lit(mask))
    cells = places.select(F.shiftright(at, 6).alias("i"), _bit(at).alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (power - 6), np.int64)
    table = cells.toArrow()  # at most 2**(PICK_MOST - 6) rows
    out[table["i"].to_numpy()] = table["b"].to_numpy()
    return out.view(np.uint8)


def _bit(at):
    return F.element_at(F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]), (at.bitwiseAND(F.lit(63)) + 1).cast("int"))


def sets_of(rows: DataFrame, levels, wanted) -> DataFrame:
    """Columns u, line, words: the word sets of the lines that the filter ``wanted`` lets through."""

    def run(batches):
        mask = 8 * len(wanted.value) - 1
        for batch in batches:
            for part in chunks(batch, 2, 1 << 19):
                joined, first = laid(encoded(part.column(2)))
                u = part.column(1).to_numpy()
                doc = np.repeat(np.arange(len(u)), np.diff(first))
                number = np.arange(first[-1]) - first[doc]
                spot = ((u[doc] & mask) + number * 7919) & mask
                take = np.flatnonzero(wanted.value[spot >> 3] >> (spot & 7).astype(np.uint8) & 1)
                if not len(take):
                    continue
                lines = joined.split(b"\n")
                rank, cut, at = word_sets(b"\n".join([lines[i] for i in take.tolist()]), levels.value)
                if len(at):
                    at = take[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(u[doc[at]]), pa.array(number[at].astype(np.int32)), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(rank.view(np.int64)))], names=["u", "line", "words"]
                    )

    return rows.mapInArrow(run, "u long, line int, words array<long>").groupBy("u", "line").agg(F.first("words").alias("words"))


def verified(pairs: DataFrame, firsts: DataFrame, rows: DataFrame, levels, threshold: float) -> DataFrame:
    """Column id: the x of the pairs whose Jaccard similarity reaches the threshold."""
    spark = rows.sparkSession
    ids = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    places = stage(firsts.select("id", "u", "line", "n").join(ids, "id"), "lines-places")
    found = sets_of(rows, levels, spark.sparkContext.broadcast(picked(places)))
    sets = stage(places.join(found, ["u", "line"]).select("id", "n", "words"), "lines-words")
    x, y = (sets.select(*[F.col(c).alias(p + c) for c in ("id", "n", "words")]) for p in "xy")
    both = pairs.join(x, pairs.x == F.col("xid")).join(y, pairs.y == F.col("yid"))
    shared = F.size(F.array_intersect("xwords", "ywords"))
    near = both.filter(shared * (1 + threshold) >= threshold * (F.col("xn") + F.col("yn")) - EPS)
    return near.select(F.col("x").alias("id")).distinct()


def near_removed(firsts: DataFrame, rows: DataFrame, levels, threshold: float, hot: int) -> DataFrame:
    """Column id: the sets that an earlier, unequal set is similar to."""
    pairs = stage(partners(firsts.withColumn("open", F.lit(True)), threshold, hot).groupBy("x", "y").agg(F.max("more").alias("more")), "lines-pairs")
    closed = stage(verified(pairs, firsts, rows, levels, threshold), "lines-near")
    # sets whose earliest partners all failed, though others are left
    left = stage(pairs.filter("more").select(F.col("x").alias("id")).distinct().join(closed, "id", "left_anti").withColumn("open", F.lit(True)), "lines-open")
    if left.isEmpty():
        return closed
    marked = firsts.join(left, "id", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    cells = np.zeros(1 << 16, np.bool_)
    for (cell,) in firsts.join(left, "id").select(F.explode("prefix").alias("key")).select(F.col("key").bitwiseAND(F.lit(0xFFFF))).distinct().collect():  # 65,536 at most
        cells[cell] = True
    rest = partners(marked, threshold, hot, rows.sparkSession.sparkContext.broadcast(cells)).select("x", "y").distinct()
    rest = stage(rest.join(pairs, ["x", "y"], "left_anti"), "lines-rest")
    if rest.isEmpty():
        return closed
    return closed.union(stage(verified(rest, firsts, rows, levels, threshold), "lines-near")).distinct()


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """Columns d, u (place of a document) and lines (numbers, from 0, of the lines to remove)."""
    rows = keyed(docs, doc_id, text).select("_d", "_u", column(text))
    levels = docs.sparkSession.sparkContext.broadcast(word_levels(rows))
    lines = stage(line_sets(rows, levels, threshold), "lines")
    firsts = lines.groupBy("s", "n", "bits").agg(F.min(F.struct(*ORDER, "prefix", "wide")).alias("f"))
    # numbered in their order
    firsts = stage(firsts.select("s", "n", "bits", "f.*").orderBy(*ORDER).withColumn("id", F.monotonically_increasing_id()), "lines-first")
    near = near_removed(firsts, rows, levels, threshold, hot)
    classes = firsts.drop("prefix", "wide").join(near.withColumn("near", F.lit(True)), "id", "left").select("s", "n", "bits", F.col("d").alias("fd"), F.col("u").alias("fu"), F.col("line").alias("fl"), "near")
    gone = lines.drop("prefix", "wide").join(classes, ["s", "n", "bits"]).filter("near or d <> fd or u <> fu or line <> fl")
    return gone.groupBy("d", "u").agg(F.collect_set("line").alias("lines"))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with ``_d``, by which documents are ordered, and ``_u``, a hash of id and text."""
    d = F.coalesce(column(doc_id).cast("long"), F.lit((1 << 63) - 1))
    return docs.withColumns({"_d": d, "_u": F.xxhash64(column(doc_id), column(text))})


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """Each row with the lines left in its text, ``n_lines`` before and ``n_removed``."""
    base = without(docs, [f.name for f in FIELDS])
    rest = [c for c in base.columns if c != text]
    rows = base.select(F.struct(*map(column, rest)).alias("row"), column(doc_id).alias("doc_id"), column(text).alias("text"))  # so that no name of theirs meets one of ours
    gone = removed_lines(rows, "doc_id", "text", threshold, hot).select(F.col("d").alias("_d"), F.col("u").alias("_u"), F.col("lines").alias("gone"))
    both = keyed(rows, "doc_id", "text").join(gone, ["_d", "_u"], "left").select("row", "text", "gone")

    def kernel():
        def run(part: pa.RecordBatch) -> list:
            texts, n, less = [], [], []
            for t, gone in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                lines = [] if t is None else t.split("\n")
                n.append(len(lines))
                less.append(len(gone or ()))
                if gone:
                    drop = set(gone)
                    t = "\n".join([x for i, x in enumerate(lines) if i not in drop])
                texts.append(t)
            return [texts, n, less]

        return run

    out = attach(both, [T.StructField("left", T.StringType()), *FIELDS], kernel, "text")
    return out.select(*[F.col("left").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in base.columns], *[f.name for f in FIELDS])
