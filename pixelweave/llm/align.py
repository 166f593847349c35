"""Which tokens of one vocabulary cover the same bytes as which of another, over a whole corpus.

Both tokenizers see a space and the text; the bytes get a label string: ``.`` inside tokens, ``a``
or ``b`` where a token of A or B alone ends, ``|`` where both end. A regular expression cuts it after
every ``|``; the labels of such a span say how many tokens of A and of B form a group. Every label
that is no dot is also the end of one overlap of an A token with a B token, a link.

Neither vocabulary joins what stands before a space with it, unless that is white space itself.
So texts are cut there, each distinct part is encoded, labelled and scanned once, and a document is
put together from its parts. Per document the distinct linked id pairs are staged with their
numbers; Spark adds these up over the corpus and hands the sums back to the documents.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweave.llm._common import attach, column, stage
from pixelweave.llm._tokens import tokenizer_path

#: Rows of pair counts that may be broadcast, about 100 MB; beyond that they are joined by shuffles.
BROADCAST = 2_000_000

SPAN = re.compile(rb"[^|]*\|")
LABELS = np.frombuffer(b".ab|", np.uint8)
#: Texts in which a plain cut at spaces would be wrong (it leaves empty parts at two spaces), and the cuts that are right in any text.
ODD = re.compile(r"[^\S ] \s")
CUT = re.compile(r"(?<=\S)(?= )|(?<=[^\S ])(?= \S)")

FIELDS = [
    *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")),
    T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.ArrayType(T.LongType())),
]


def align(docs: DataFrame, text: str = "text", a: str | None = None, b: str | None = None, broadcast: int = BROADCAST) -> tuple[DataFrame, DataFrame]:
    """Documents with what their alignment says, and the corpus's linked id pairs.

    Adds ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` (of ``a1,a2|b1;a3|b2``; '' without
    tokens), ``n_best`` (links whose pair has the highest count of its B id) and ``count_sum`` (over
    the links, of their pairs' counts). The pairs are rows (a_id, b_id, n, best). A text that is null
    or empty, or that either tokenizer changes, has no tokens: zeros. Repeated rows count as often as
    they come. The text stays out; further columns pass through, and those named as a new one are
    replaced.
    """
    paths = a or tokenizer_path("byte_bpe_50k.tiktoken"), b or tokenizer_path("piece_bpe_32k.model")
    new = {text.lower(), *(f.name for f in FIELDS), "n_best", "count_sum"}
    kept = [c for c in docs.columns if c.lower() not in new]
    own = docs.select(F.struct(*map(column, kept)).alias("d") if kept else F.lit(0).alias("d"), F.monotonically_increasing_id().alias("r"), column(text).alias("text"))

    def kernel():
        return aligner(*paths).batch

    found = stage(attach(own, FIELDS, kernel).drop("text"), "alignment")
    each = found.select("r", F.explode("links").alias("l")).selectExpr("r", f"l & {(1 << BITS) - 1} as pair", f"shiftright(l, {BITS}) as k")
    counts = each.groupBy("pair").agg(F.sum("k").alias("n")).selectExpr("pair", f"shiftright(pair, {B_BITS}) as a_id", f"pair & {(1 << B_BITS) - 1} as b_id", "n")
    highest = counts.groupBy("b_id").agg(F.max("n").alias("top"))
    pairs = stage(counts.join(highest, "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("top")).alias("best")), "pairs")
    table = pairs.select("pair", "n", "best")
    if pairs.count() <= broadcast:
        table = F.broadcast(table)
    sums = each.join(table, "pair").groupBy("r").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
    told = found.drop("links").join(sums, "r", "left")
    late = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    out = told.select(*(column("d").getField(c).alias(c) for c in kept), *(f.name for f in FIELDS if f.name != "links"), *late)
    return out, pairs.select("a_id", "b_id", "n", "best")


#: A link is packed as its number, the A id and the B id; a text is too short for a number over 32 bits.
A_BITS, B_BITS = 16, 15
BITS = A_BITS + B_BITS


class Aligner:
    """Parts of texts met so far, and what their alignment says."""

    #: Parts, and characters of them, that are kept; beyond that only those of the texts at hand stay.
    KEEP, KEEP_CHARS = 300_000, 12_000_000

    def __init__(self, a_path: str, b_path: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path, "rb") as f:
            ranks = {base64.b64decode(token): int(i) for token, i in map(bytes.split, f)}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        if len(self.a_bytes) > 1 << A_BITS or len(self.b_bytes) > 1 << B_BITS:
            raise ValueError(f"a vocabulary has over {1 << A_BITS} (A) or {1 << B_BITS} (B) ids")
        self.space = self.b.piece_to_id("\u2581")
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        # the decimal ids with what follows them: within a group, after the last A id, after the last B id
        self.written = [f"{i}{sep}" for sep in ",|;" for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.numbers = np.zeros((0, 5), np.int64)  # A tokens, B tokens, groups, links, 1 if a tokenizer changes the part
        self.links = np.zeros(0, np.int64)

    def batch(self, rows: pa.RecordBatch) -> list:
        texts = rows["text"].to_pylist()
        parts = [_parts(t) if t else [] for t in texts]
        if len(self.place) > self.KEEP or self.chars > self.KEEP_CHARS:
            self._forget()
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        every = list(chain.from_iterable(parts))
        at = list(map(self.place.get, every))
        new = [i for i, k in enumerate(at) if k is None]
        if new:
            self._learn(list(dict.fromkeys([every[i] for i in new])))
            for i in new:
                at[i] = self.place[every[i]]
        at = np.array(at, np.int64)
        ends = np.cumsum(size)
        begins = ends - size
        upto = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(self.numbers[at], axis=0)])
        numbers = upto[ends] - upto[begins]
        fine = (numbers[:, 4] == 0) & (size > 0)
        numbers[~fine] = 0
        groups, digests = self.groups, []
        for i, ok in enumerate(fine.tolist()):
            own = "".join([groups[k] for k in at[begins[i] : ends[i]].tolist()])[:-1] if ok else ""
            digests.append(hashlib.sha256(own.encode()).hexdigest() if own else "")
        links, offsets = self._linked(at, np.repeat(np.arange(len(size)), size), fine)
        return [*(pa.array(numbers[:, k]) for k in range(4)), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(links))]

    def _linked(self, at: np.ndarray, text: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text its distinct id pairs, with their numbers above their bits."""
        at, text = at[fine[text]], text[fine[text]]
        size = self.numbers[at, 3]
        to = np.cumsum(size)
        total = int(to[-1]) if len(to) else 0
        pairs = self.links[np.repeat(self.start[at] - to + size, size) + np.arange(total)] if total else np.zeros(0, np.int64)
        found, number = np.unique(np.repeat(text, size) << BITS | pairs, return_counts=True)
        return (found & ((1 << BITS) - 1)) | number << BITS, np.searchsorted(found, np.arange(len(fine) + 1) << BITS)

    def _learn(self, parts: list[str]) -> None:
        parts = [p for p in parts if not p[-1].isspace()] + [p for p in parts if p[-1].isspace()]
        ids = [self._ids(parts[i : i + 1000]) for i in range(0, len(parts), 1000)]
        flat_a, n_a, flat_b, n_b, size, changed = (np.concatenate(x) for x in zip(*ids, strict=True))
        label = np.zeros(int(size.sum()), np.uint8)
        label[np.cumsum(self.a_size[flat_a]) - 1] += 1
        label[np.cumsum(self.b_size[flat_b]) - 1] += 2
        ends = np.cumsum(np.fromiter(map(len, SPAN.findall(LABELS[label].tobytes())), np.int64))
        marks = np.flatnonzero(label)  # the last byte of each link
        kind = label[marks].astype(np.int64)
        upto_a, upto_b = np.cumsum(kind & 1), np.cumsum(kind >> 1)
        links = flat_a[upto_a - (kind & 1)] << B_BITS | flat_b[upto_b - (kind >> 1)]
        last = np.searchsorted(marks, ends - 1)  # of each span, its | among the marks
        written = self._written(flat_a, np.diff(upto_a[last], prepend=0), flat_b, np.diff(upto_b[last], prepend=0))
        to = np.cumsum(size)
        n_groups, n_links = (np.diff(np.searchsorted(x, to), prepend=0) for x in (ends - 1, marks))
        token_to = np.append(0, np.cumsum(n_a + n_b)).tolist()
        base = len(self.groups)
        self.groups += ["".join(written[i:j]) for i, j in zip(token_to, token_to[1:])]
        self.place.update(zip(parts, range(base, base + len(parts))))
        self.chars += sum(map(len, parts))
        self.numbers = np.concatenate([self.numbers, np.stack([n_a, n_b, n_groups, n_links, changed], axis=1)])
        self.links = np.concatenate([self.links, links])
        self.start = np.cumsum(self.numbers[:, 3]) - self.numbers[:, 3]

    def _ids(self, parts: list[str]) -> tuple[np.ndarray, ...]:
        """A ids and their number in each part, B ids and theirs, bytes of each part, 1 for those that a tokenizer changes (and no ids)."""
        raw = [p.encode() for p in parts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        if not parts[-1][-1].isspace():  # what ends in white space may join with a space
            to, whole, counts, flats, fine = np.cumsum(size), "".join(parts), [], [], False
            flat_b = self.b.encode(whole[1:], num_threads=1)
            for flat, sizes in ((self.a.encode_ordinary(whole), self.a_size), (flat_b, self.b_size)):
                flats.append(np.array(flat, np.int64))
                ends = np.cumsum(sizes[flats[-1]])
                counts.append(np.searchsorted(ends, to, side="right"))
                if ends[-1] != to[-1] or (ends[counts[-1] - 1] != to).any():
                    break
            else:
                fine = b"".join(map(self.b_bytes.__getitem__, flat_b)) == b"".join(raw)  # A's tokens always join to the text
            if fine:
                return flats[0], np.diff(counts[0], prepend=0), flats[1], np.diff(counts[1], prepend=0), size, np.zeros(len(raw), np.int64)
        out: list[list[list[int]]] = [[], []]
        changed = np.zeros(len(raw), np.int64)
        b = self.b.encode([p[1:] for p in parts], num_threads=1)
        for i, (p, own, other) in enumerate(zip(raw, map(self.a.encode_ordinary, parts), b, strict=True)):
            other = other or [self.space]  # a part that is one space
            changed[i] = any(b"".join(map(table.__getitem__, ids)) != p for table, ids in ((self.a_bytes, own), (self.b_bytes, other)))
            for k, ids in enumerate((own, other)):
                out[k].append([] if changed[i] else ids)
        flat = [np.fromiter(chain.from_iterable(x), np.int64) for x in out]
        n = [np.fromiter(map(len, x), np.int64, len(x)) for x in out]
        return flat[0], n[0], flat[1], n[1], np.where(changed, 0, size), changed

    def _written(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> list[str]:
        """All ids as they are written, group by group, from the ids and the numbers of A and B ids in each group."""
        many = len(self.written) // 3
        last_a, last_b = np.cumsum(n_a) - 1, np.cumsum(n_b) - 1
        out = np.zeros(len(a) + len(b), np.int64)
        before = last_b + 1 - n_b  # B ids of the groups before
        out[np.arange(len(a)) + np.repeat(before, n_a)] = a
        out[np.arange(len(b)) + np.repeat(last_a + 1, n_b)] = b
        out[last_a + before] += many
        out[last_b + last_a + 1] += 2 * many
        return [self.written[i] for i in out.tolist()]


def _parts(text: str) -> list[str]:
    """A space and the text, cut before spaces where neither tokenizer joins."""
    whole = " " + text
    if "  " in whole or ODD.search(whole):
        return CUT.split(whole)
    return [" " + p for p in text.split(" ")] if " " in text else [whole]


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker."""
    return Aligner(a_path, b_path)
