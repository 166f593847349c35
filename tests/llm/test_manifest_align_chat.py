"""Manifest, tokenizer alignment and chat formatting against plain versions, on awkward rows and with small blocks."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pixelweave.llm import align, chat, merkle
from pixelweave.llm._ordered import running
from pixelweave.llm._tokens import tokenizer_path

CLASH = "g k leaf claim n at block place root _part _row pair r d links n_a N_BEST groups_sha256 segment start i h t head turns chars before_n"


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH.split()})


# --- sums in a global order


def test_running(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "c"]) if i % 3 else "hot", i, rng.randint(1, 5)) for i in range(3000)]
    found = running(spark.createDataFrame(rows, "g string, o long, v long").repartition(7), ["g"], ["o"], ["v"], "test").collect()
    seen = collections.Counter()
    expected = {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        expected[o] = seen[g]
        seen[g] += v
    assert {r.o: r.before_v for r in found} == expected and len(found) == len(rows)


def test_running_over_whole_partitions(spark):
    """One group in every partition, and partitions without rows."""
    df = spark.range(4000).selectExpr("id % 1 as g", "id as o", "1L as v")
    assert {(r.o, r.before_v) for r in running(df, ["g"], ["o"], ["v"], "test").collect()} == {(i, i) for i in range(4000)}
    assert running(df.limit(0), ["g"], ["o"], ["v"], "test").collect() == []


# --- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def plain_manifest(rows):
    """Places, proofs and folds by lists."""

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    groups = collections.defaultdict(list)
    for r in rows:
        told = r if r[0] is None or zlib.crc32(str(r[0]).encode()) % 3 or r[4] is None else (*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4]))
        groups[r[2]].append((r[0], plain_leaf(r), plain_leaf(told)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = levels([r[1] for r in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for i, g in enumerate(order):
        for j, (key, leaf, claim) in enumerate(groups[g]):
            proof, folded = [], claim
            for tree, at in ((trees[g], j), (top, i)):
                for nodes in tree[:-1]:
                    run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
                    proof += run[: at % 8] + run[at % 8 + 1 :]
                    folded = h(*run[: at % 8], folded, *run[at % 8 + 1 :])
                    at //= 8
            out.append((key, leaf, trees[g][-1][0], top[-1][0], h(*proof), folded, folded == top[-1][0]))
    return out


def manifest_rows():
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "web"]), rng.choice(["en", "de", None, "", "é", "zz"]) if i % 3 else "hot", rng.choice([None, 3]), rng.choice([None, "", "Text A", "ÀB", "low " * 50])) for i in range(700)]
    rows += [(7, "web", "en", 3, "Same")] * 100 + [(None, None, None, None, None)] * 3 + [(8, "web", "en", 3, f"t{i}") for i in range(5)] + [(9, "web", "solo", 1, "Alone")]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
RESULT = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifested(df, **more):
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    text = F.when(tampered, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    return merkle.manifest(df, claims={"text": text}, **more)


@pytest.mark.parametrize("levels", [None, 1, 2])
def test_manifest(spark, levels):
    rows = manifest_rows()
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(5))
    found = manifested(df, levels=levels).select(*RESULT).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, plain_manifest(rows)))


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65, 513])
def test_manifest_sizes(spark, n):
    rows = [(i, None, "en", i, f"T{i}") for i in range(n)]
    found = manifested(spark.createDataFrame(rows, SCHEMA), levels=1).select(*RESULT).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, plain_manifest(rows)))


def test_manifest_proofs(spark):
    """A proof, sibling lists before and after the node at each level, leads to the root by itself; nothing claimed is verified."""
    df = spark.createDataFrame(manifest_rows(), SCHEMA)
    found = merkle.manifest(df, proofs=True, levels=1).collect()
    assert all(r.verified for r in found) and len({r.root for r in found}) == 1
    for r in found[::37]:
        path = [x.encode() for x in r.proof]
        assert merkle.fold(r.leaf.encode(), list(zip(path[::2], path[1::2]))).decode() == r.root
        assert h(*r.proof) == r.proof_sha256


# --- alignment


def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def plain_alignment(texts):
    """Offsets by loops, with the vocabularies' own files, no cut texts."""
    a, b = tokenizers()
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in seen} | {chr(256 + i): x for i, x in enumerate(sorted({*range(256)} - {*seen}))}
    entries = {i: w for w, i in a.get_vocab().items()}
    out, every = [], collections.Counter()
    for t in texts:
        tokens = []
        if t:
            ids = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            sides = [(i, bytes(byte[c] for c in entries[i])) for i in ids[0]], [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ids[1]]
            if all(b"".join(x for _, x in side) == (" " + t).encode() for side in sides):
                for side in sides:
                    at, own = 0, []
                    for i, x in side:
                        own.append((i, at, at + len(x)))
                        at += len(x)
                    tokens.append(own)
        if not tokens:
            out.append((0, 0, 0, "", []))
            continue
        left, right = tokens
        cuts = sorted({e for *_, e in left} & {e for *_, e in right})
        groups = ["|".join(",".join(str(i) for i, _, e in own if lo < e <= hi) for own in tokens) for lo, hi in zip([0, *cuts], cuts)]
        links = [(i, j) for i, s, e in left for j, u, v in right if s < v and u < e]
        every.update(links)
        out.append((len(left), len(right), len(groups), h(";".join(groups)), links))
    top = collections.Counter()
    for (_, j), n in every.items():
        top[j] = max(top[j], n)
    return [(na, nb, ng, len(links), sum(every[x] == top[x[1]] for x in links), sum(every[x] for x in links), sha) for na, nb, ng, sha, links in out], every


def aligned_texts():
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "the", "é", "漢", "▁", "<0x41>", "<|endoftext|>", "</s>", "\x00", "\xa0", "　", "'s", "12", ".", "--", "é", "😀", "\r\n", "\x1c", "ﬁ", "퟿", "tokenizer", "Weather"]
    texts = [None, "", " ", "   ", "a ", " a", "\n", "\n  x", "a\n \nb", "<s>", "<unk>", "the cat sat on the mat", "the cat sat on the mat"]
    return texts + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(300)] + [" ".join(f"word{i % 53}" for i in range(400))]


@pytest.mark.parametrize("broadcast", [align.BROADCAST, 0])
def test_alignment(spark, broadcast):
    texts = aligned_texts()
    df = clashing(spark.createDataFrame([*enumerate(texts), (None, "the cat sat")], "doc_id long, text string")).repartition(3)
    found, pairs = align.align(df, broadcast=broadcast)
    assert {"g", "k", "pair", "r", "d"} < {*found.columns} and "text" not in found.columns
    expected, every = plain_alignment([*texts, "the cat sat"])
    got = found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *x)) for i, x in zip([*range(len(texts)), None], expected))
    rows = pairs.collect()
    assert {(r.a_id, r.b_id): r.n for r in rows} == dict(every)
    top = collections.Counter()
    for r in rows:
        top[r.b_id] = max(top[r.b_id], r.n)
    assert all(r.best == (r.n == top[r.b_id]) for r in rows)


def test_alignment_edges(spark):
    df = spark.createDataFrame([("a b",), (None,)], "text string")
    assert sorted(r.n_a for r in align.align(df)[0].collect()) == [0, 2]
    assert align.align(df.limit(0))[0].collect() == []


def test_alignment_remembers_right(spark):
    """Parts met before, met again after they were let go, and texts of one part without end."""
    own = align.Aligner(tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"))
    import pyarrow as pa

    texts = ["the cat sat", "x" * 50_000, "a cat\x00 sat the", "the cat sat"]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    first = [x.to_pylist() for x in own.batch(batch)]
    again = [x.to_pylist() for x in own.batch(batch)]
    own.KEEP = 0
    assert first == again == [x.to_pylist() for x in own.batch(batch)]
    assert first[0][0] == first[0][3] > 0


# --- chat

TURNS = [
    (1, 0, "system", "Be <|brief|>\\ <\\|im_end|>"), (1, 1, "user", None), (1, 2, "assistant", "<|im_end|>\n<|im_start|>assistant\nok"), (1, 3, "user", "more <"), (1, 4, "assistant", "<"), (1, 5, "user", "bye"),
    (2, 0, "user", "alone"), (3, None, None, ""), (3, 0, "assistant", ""), (None, 0, "assistant", "no id"), (None, 0, "assistant", "no id"),
    (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (4, 1, "user", "z"), (5, 0, "a\\n\nb<|im_end|>", "x\\"), (5, 1, "assistant", "<\\\\|<|<<|"),
]
CHAT = "conv_id long, turn long, role string, text string"


def test_chat(spark):
    turns = chat.formatted(clashing(spark.createDataFrame(TURNS, CHAT).repartition(4)))
    found = {r.conv_id: r for r in chat.read_back(turns).collect()}
    by = collections.defaultdict(list)
    for r in sorted(TURNS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[r[0]].append((r[2] or "", r[3] or ""))
    assert {*found} == {*by}
    for conv, own in by.items():
        r = found[conv]
        loss = "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), h(*(f"{role}\n{t}\n" for role, t in own)), len(loss), h(loss))
        assert r.n_examples == sum(role == "assistant" for role, _ in own)
    assert chat.read_back(chat.formatted(spark.createDataFrame([], CHAT))).collect() == []


def test_chat_examples(spark):
    """Written out, an example is all turns up to its target, and the mask is the reply; no control string is left in a text."""
    turns = chat.formatted(spark.createDataFrame(TURNS, CHAT))
    texts = {(r.conv_id, r.place): r for r in chat.texts(turns, chat.examples(turns)).collect()}
    kept = {(r.conv_id, r.place): r for r in turns.collect()}
    assert len(texts) == sum(r[2] == "assistant" for r in TURNS)
    for (conv, place), r in texts.items():
        before = [kept[conv, i] for i in range(place + 1)]
        assert r.text == "".join(x.segment for x in before)
        assert kept[conv, place].context_turns == place and kept[conv, place].context_chars == len(r.text) - len(before[-1].segment)
        assert r.text[: r.loss_from].endswith("<|im_start|>assistant\n") and r.text[r.loss_to :] == "<|im_end|>\n"
        assert r.text.count("<|") == 2 * len(before)
    assert sum(r.loss_from is not None for r in kept.values()) == len(texts)


def test_chat_long_conversation(spark):
    """One conversation in many partitions, mostly one turn repeated."""
    turns = spark.range(5000).selectExpr("7L as conv_id", "if(id < 2000, id, 2000) as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "if(id < 2000, concat('t', id), 'same') as text")
    made = chat.formatted(turns)
    assert [r.place for r in made.orderBy("place").collect()] == [*range(5000)]
    own = sorted(map(tuple, turns.collect()), key=lambda r: (r[1], r[2], r[3]))
    assert chat.read_back(made).first().turns_sha256 == h(*(f"{r[2]}\n{r[3]}\n" for r in own))
