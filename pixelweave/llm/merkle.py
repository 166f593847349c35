"""A Merkle manifest of a dataset: a digest of every row, a tree over them, and a proof for each row.

The rows of a group (a language) are leaves in the order of their key; runs of ``FAN`` nodes become
their parent until one is left, the group's subroot; subroots, in the order of the groups, become
the root the same way. The lower tree is cut into blocks of ``FAN ** levels`` leaves, which tasks
reduce to one node each. ``levels`` grows with the number of rows so that at most ``TOP`` block
nodes, and one more for each group, reach the driver. It builds the upper tree and broadcasts it,
each node once; the path above a block is a slice of each of its levels. With it the tasks finish
the proofs of their block's rows and fold every row up to the root again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweave.llm._common import column
from pixelweave.llm._ordered import running

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
#: Characters of a digest.
WIDE = 64
#: Blocks at most; the driver holds 64 bytes for each.
TOP = 131_072
#: Groups at most; they stand beside the blocks in the broadcast tree (64 MB).
GROUPS = 1_000_000


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """The digest of a row, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def manifest(
    rows: DataFrame,
    claims: dict[str, Column] | None = None,
    key: str = "doc_id",
    group: str = "lang",
    fields: tuple[str, ...] = FIELDS,
    levels: int | None = None,
    proofs: bool = False,
) -> DataFrame:
    """For each row its key, group, place, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.

    ``claims`` says how the rows look that are held against the manifest (field to value); their
    leaves are folded along the proofs of the rows as they are. ``proofs`` adds the proof itself
    (array of the digests that stand before and after the row's own node, level by level).
    A null group comes first, a null key first in its group; rows of equal key come in the order
    of their digests, and equal rows are leaves of their own next to each other, counted before
    they are moved. No row gives no row. Columns beside key, group and ``fields`` play no part.
    """
    claims = claims or {}
    own = leaf([column(f) for f in fields])
    claimed = leaf([claims.get(f, column(f)) for f in fields]) if claims else F.lit(None).cast("binary")
    counted = rows.select(column(key).alias("k"), column(group).alias("g"), own.alias("leaf"), claimed.alias("claim"))
    counted = counted.groupBy("g", "k", "leaf", F.expr("nullif(claim, leaf)").alias("claim")).agg(F.count("*").alias("n"))
    placed = running(counted, ["g"], ["k", "leaf", "claim"], ["n"], "leaves")
    size = placed.groupBy("g").agg(F.sum("n").alias("n")).agg(F.sum("n"), F.count("*")).first()
    total, groups = size[0] or 0, size[1]
    if groups > GROUPS:
        raise ValueError(f"{groups} groups: the upper tree is broadcast, which holds {GROUPS}")
    if levels is None:
        levels = 3
        while total > TOP * FAN**levels:
            levels += 1
    block = FAN**levels
    blocks = placed.withColumn("block", F.explode(F.expr(f"sequence(before_n div {block}, (before_n + n - 1) div {block})")))
    blocks = blocks.selectExpr("g", "k", "leaf", "claim", "block", f"greatest(before_n, block * {block}) as at", f"least(before_n + n, (block + 1) * {block}) - greatest(before_n, block * {block}) as n")

    def reduced(table: pa.Table) -> pa.Table:
        node = _Block(table, levels).up[-1]
        return table.select(["g", "block"]).slice(0, 1).append_column("node", pa.array([node.decode()]))

    nodes = blocks.select("g", "block", "at", "n", "leaf").groupBy("g", "block").applyInArrow(reduced, T.StructType([placed.schema["g"], T.StructField("block", T.LongType()), T.StructField("node", T.StringType())]))
    upper = rows.sparkSession.sparkContext.broadcast(Upper([tuple(r) for r in nodes.orderBy("g", "block").collect()]))

    out = T.StructType([
        T.StructField(key, placed.schema["k"].dataType), T.StructField(group, placed.schema["g"].dataType), T.StructField("place", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), T.StructField("verified", T.BooleanType()),
        *([T.StructField("proof", T.ArrayType(T.StringType()))] if proofs else []),
    ])

    def finished(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_finish(table, upper.value, levels, out.names))

    return blocks.groupBy("g", "block").applyInArrow(finished, out)


def parents(nodes: bytes) -> bytes:
    """The digests of all runs of ``FAN`` digests, concatenated as they are."""
    step = WIDE * FAN
    return b"".join([hashlib.sha256(nodes[i : i + step]).hexdigest().encode() for i in range(0, len(nodes), step)])


def tree(nodes: bytes, levels: int | None = None) -> list[bytes]:
    """``nodes`` and the levels above, up to the one node left or ``levels`` of them."""
    up = [nodes]
    while len(up) <= levels if levels is not None else len(up[-1]) > WIDE:
        up.append(parents(up[-1]))
    return up


def siblings(nodes: bytes, at: int) -> tuple[bytes, bytes]:
    """What stands before and after a node in its run."""
    a = at // FAN * FAN * WIDE
    return nodes[a : at * WIDE], nodes[(at + 1) * WIDE : a + FAN * WIDE]


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf leads to along a proof."""
    for before, after in path:
        node = hashlib.sha256(before + node + after).hexdigest().encode()
    return node


class Upper:
    """The tree above the blocks: of each group the levels up to its subroot, and the levels above those."""

    def __init__(self, nodes: list[tuple]) -> None:
        by: dict = {}
        for g, block, node in nodes:
            by.setdefault(g, []).append(node.encode())
        self.place = {g: i for i, g in enumerate(by)}
        self.groups = {g: tree(b"".join(own)) for g, own in by.items()}
        self.top = tree(b"".join(levels[-1] for levels in self.groups.values())) if by else []

    def path(self, group, block: int) -> list[tuple[bytes, bytes]]:
        out = []
        for levels, at in ((self.groups[group], block), (self.top, self.place[group])):
            for nodes in levels[:-1]:
                out.append(siblings(nodes, at))
                at //= FAN
        return out


class _Block:
    """The leaves of a block in order, and the levels above them."""

    def __init__(self, table: pa.Table, levels: int) -> None:
        at, n = (table[c].to_numpy() for c in ("at", "n"))
        order = np.argsort(at)
        self.at, self.row = int(at.min()), np.repeat(order, n[order])
        digests = [x.hex().encode() for x in table["leaf"].to_pylist()]
        leaves = b"".join([digests[i] for i in self.row.tolist()])
        alone = self.at == 0 and len(self.row) < FAN**levels  # a group of one block: no level more than it takes
        self.up = tree(leaves) if alone else tree(leaves, levels)


def _finish(table: pa.Table, upper: Upper, levels: int, names: list[str], at_once: int = 4096) -> Iterator[pa.RecordBatch]:
    block = _Block(table, levels)
    group, number = table["g"][0].as_py(), table["block"][0].as_py()
    above = upper.path(group, number)
    above_text = b"".join([x for pair in above for x in pair])
    subroot, root = upper.groups[group][-1].decode(), upper.top[-1].decode()
    claims, keys = table["claim"].to_pylist(), table["k"].combine_chunks()
    lower, leaves = block.up[:-1], block.up[0]
    run, shared, shared_text = -1, [], b""
    rows = block.row.tolist()
    for start in range(0, len(rows), at_once):
        own, out = rows[start : start + at_once], []
        for i, r in enumerate(own, start):
            if i // FAN != run:  # what the rows of a run share
                run, at, shared = i // FAN, i // FAN, []
                for nodes in lower[1:]:
                    shared.append(siblings(nodes, at))
                    at //= FAN
                shared += above
                shared_text = b"".join([x for pair in shared[: len(shared) - len(above)] for x in pair]) + above_text
            first = [siblings(leaves, i)] if lower else []
            leaf = leaves[i * WIDE : (i + 1) * WIDE]
            claim = claims[r]
            folded = fold(leaf if claim is None else claim.hex().encode(), first + shared).decode()
            row = (block.at + i, leaf.decode(), subroot, root, hashlib.sha256(b"".join([*first[0], shared_text]) if first else shared_text).hexdigest(), folded, folded == root)
            out.append(row if len(names) == 9 else (*row, [x.decode() for pair in first + shared for x in pair]))
        cols = [pa.array(c) for c in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(own)), pa.array([group] * len(own), table["g"].type), *cols], names=names)
