"""The registered queries against brute force over whole small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def result(spark, name):
    return entry.queries()[name](spark, SF).toPandas()


def fold(doc_id, parts=3):
    return zlib.crc32(str(doc_id).encode()) % parts


def line_brute(docs, threshold=0.8):
    places = sorted((d, i, frozenset(x.encode().split())) for d, t in docs for i, x in enumerate(t.split("\n")))
    seen, gone = [], defaultdict(set)
    for d, i, w in places:
        if not w:
            continue
        if any(len(w & o) >= threshold * len(w | o) - 1e-9 for o in seen):
            gone[d].add(i)
        seen.append(w)
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}


def test_line_dedup(spark, docs):
    assert dict(result(spark, "op3_line_dedup")[["doc_id", "text"]].itertuples(index=False)) == line_brute(docs)


def test_language_accuracy(spark):
    found = result(spark, "op1_language_id").merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = found[found.held_out & found.lang.notna()]
    assert (held.held_out == held.doc_id.map(lambda d: fold(d) == 1)).all()
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert found.score.between(0, 1).all()


@pytest.mark.parametrize(("name", "label", "cut"), [("op2_quality_classifier", "quality", 0.5), ("op4_toxicity", "toxic", 0.7)])
def test_classifiers(spark, name, label, cut):
    sf = "/root/testdata/sf0.1"  # enough labels to learn from
    found = entry.queries()[name](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = found[found.held_out]
    assert ((found.score >= cut).astype(int) == found.predicted).all()
    pos, neg = held[held[label] == 1].score, held[held[label] == 0].score
    auc = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    assert auc > 0.9


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    from pixelweave.llm._tokens import tokenizer_path

    coder = Tokenizer.from_file(tokenizer_path())
    found = result(spark, "op6_packing")
    pieces = {d: g.sort_values("start") for d, g in found.groupby("doc_id")}
    for d, t in docs:
        ids = np.array([*coder.encode(t, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in pieces[d].itertuples():
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, g in found.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all()
        assert g.length.sum() <= 4096
    total = found.groupby("sequence_id").length.sum()
    used = sum(1 << max(0, (n - 1).bit_length()) for n in total)
    assert total.sum() / used > 0.9


def test_simhash(spark, docs):
    prints = {}
    for d, t in docs:
        w = WORD.findall(t.translate(LOWER))
        hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    found = result(spark, "op7_simhash")
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found.itertuples()} == {d: (f"{prints[d]:016x}", find(d)) for d in ids}


def test_lm_scoring(spark, docs):
    tokens = {d: [*WORD.findall(t.translate(LOWER)), None] for d, t in docs}
    c = Counter(x for d, ts in tokens.items() if fold(d, 10) for x in ts)
    n, v = sum(c.values()), len(c)
    found = result(spark, "op8_lm_scoring").set_index("doc_id")
    assert len(found) == len(docs)
    for d, ts in tokens.items():
        r = found.loc[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(d, 10) == 0, len(ts), sum(c[x] > 0 for x in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts))
        assert r.score < 0


def decontamination_brute(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, t in items:
        w = word.findall((t or "").translate(LOWER))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(item))
    sizes = sorted({len(k) for k in windows})
    out = {}
    for d, t in docs:
        w = word.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for s in sizes:
            for i in range(len(w) - s + 1):
                if (k := tuple(w[i : i + s])) in windows:
                    hit |= set(range(i, i + s))
                    found |= windows[k]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = result(spark, "op9_decontamination")
    assert {r[0]: tuple(r[1:]) for r in found[["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]].itertuples(index=False)} == decontamination_brute(docs, items)


def test_quality_rules(spark, docs):
    found = result(spark, "op10_quality_rules").set_index("doc_id")
    for d, t in docs:
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        r = found.loc[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert not (r.base_failed and r.kept)
    assert found.kept.mean() > 0.6


def test_pipeline(spark, docs):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    now = table
    for name, function in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in now.collect()}
        now = spark.createDataFrame(function(spark, now, SF).toPandas(), table.schema)
        assert now.columns == table.columns
        after = {r.doc_id: r.text for r in now.collect()}
        assert set(after) <= set(before)
        if name == "line_dedup":
            assert after == line_brute(list(before.items()))
        else:
            assert all(before[d] == t for d, t in after.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF).toPandas()
    assert set(packed.doc_id) == set(after)
