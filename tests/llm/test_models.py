"""The trained models against plain loops over their definitions."""

import itertools
import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from pixelweave.llm import langid, quality_model, quality_rules, simhash, toxicity

TEXTS = {
    "aa": ["the cat sat on the mat", "The  cat, the rat!", "a", "на the 中文 cat"],
    "bb": ["der hund und die katze", "und der Hund", "日本語のテキスト", "die ratte"],
}


def symbols(text):
    out = ["^"] * 3
    for c in text:
        c = c.lower() if c.isalpha() else " "
        if c != " " or out[-1] != " ":
            out.append(c)
    return out


def kneser_ney(texts, size):
    """p(gram of any order up to four, as a tuple) by definition, for one language."""
    grams = [None] * 5
    grams[4] = Counter(tuple(s[i - 3 : i + 1]) for s in map(symbols, texts) for i in range(3, len(s)))
    for n in (3, 2, 1):
        grams[n] = Counter({g: len({x[0] for x in grams[n + 1] if x[1:] == g}) for g in {x[1:] for x in grams[n + 1]}})

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / (size + 1)
        c = grams[n]
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(0.95, max(0.1, one / max(1, one + 2 * two)))
        context = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
        if not context:
            return p(gram[1:])
        total = sum(context.values())
        return max(context.get(gram, 0) - d, 0) / total + d * len(context) / total * p(gram[1:])

    return p


def counts(texts):
    k, n = np.unique(langid.keys_of(texts)[0].view(np.int64), return_counts=True)
    return k, n


def test_kneser_ney_by_definition():
    model = langid.Model({lang: counts(texts) for lang, texts in TEXTS.items()})
    size = len({c for texts in TEXTS.values() for t in texts for c in symbols(t)[3:]})
    by = [kneser_ney(TEXTS[lang], size) for lang in model.languages]
    tried = ["the dog sat", "katze", "q", "中国", "日本 cat", "УНД", "x" * 30, " . the", *TEXTS["aa"]]
    found, lengths = model.entropies(tried)
    for t, own, n in zip(tried, found, lengths):
        s = symbols(t)
        assert n == len(s) - 3
        for j, p in enumerate(by):
            assert own[j] == pytest.approx(-sum(math.log(p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))) / n, rel=1e-4)


def test_counting_makes_a_row_for_each_gram_of_a_task(spark, monkeypatch):
    """However finely the texts are dealt, and however many batches a task reads, each n-gram of a language comes up once."""
    rows = spark.createDataFrame([("a", f"the same words {i % 3}x") for i in range(60)] + [("b", "other ones")], "lang string, text string").distinct().repartition(40)
    made = []
    whole = langid.counted
    monkeypatch.setattr(langid, "counted", lambda some: made.append(some) or whole(some))
    model = langid.fit(rows, enough=99)
    assert model.languages == ["a", "b"] and made[0].rdd.getNumPartitions() == 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        texts = spark.createDataFrame([("a", "abab")] * 20, "lang string, text string").coalesce(1)
        counts = {r.key: r.n for r in whole(texts).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    keys = langid.keys_of(["abab"])[0].view("int64")
    assert counts == {int(k): 20 * int((keys == k).sum()) for k in keys}


def test_scripts_keep_their_letters():
    s = langid.symbols()
    for first, last in ((0x4E00, 0x9FA5), (0x3041, 0x3096), (0xAC00, 0xD7A3), (0x0531, 0x0556)):
        assert len(np.unique(s[first : last + 1])) == last - first + 1
    assert s[ord("A")] == s[ord("a")] == ord("a")
    assert not s[[ord(c) for c in "7 .-\t"]].any()
    assert 0xE000 <= s[0x20000] < 0xE000 + 6400


def test_languages_that_share_a_script(spark):
    rng = random.Random(3)
    own = {"x": range(0x4E00, 0x4E00 + 300), "y": range(0x7000, 0x7000 + 300)}  # no letter in common
    docs = spark.createDataFrame([("".join(map(chr, rng.choices(own[lang], k=20))), lang) for lang in own for _ in range(150)], "text string, lang string")
    found = langid.identify(docs, langid.fit(docs)).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in found) == len(found)


def pooled(y, n):
    """Largest of the least means: the non-decreasing fit by its min-max formula."""
    mean = lambda i, j: sum(y[i : j + 1]) / sum(n[i : j + 1])
    return [max(min(mean(i, j) for j in range(k, len(y))) for i in range(k + 1)) for k in range(len(y))]


def test_isotonic_by_min_max():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = rng.integers(1, 6, 12).astype(float)
        y = np.minimum(n, rng.integers(0, 6, 12)).astype(float)
        at = np.arange(12.0)
        knots, values = quality_model.isotonic(at, y, n)
        want = pooled(y, n)
        groups = [list(g) for _, g in itertools.groupby(range(12), key=lambda k: round(want[k], 9))]
        assert knots == pytest.approx([sum(at[k] * n[k] for k in g) / sum(n[k] for k in g) for g in groups])
        assert values == pytest.approx([(sum(y[k] for k in g) + 0.5) / (sum(n[k] for k in g) + 1) for g in groups])


def test_ridge_by_loops(spark):
    rng = np.random.default_rng(5)
    k = len(quality_model.STATISTICS)
    rows = [(i, rng.normal(0, 1, k).tolist(), float(rng.integers(0, 2))) for i in range(300)]
    labelled = spark.createDataFrame(rows, "doc_id long, stats array<double>, label double").repartition(5)
    scorer = quality_model.fit(labelled, features=24)
    kept = {r.doc_id for r in labelled.filter(quality_model.sampled(quality_model.F.col("doc_id"), 0.2, seed=3)).collect()}
    assert 0 < len(kept) < 300
    x = np.array([r[1] for r in rows])
    assert scorer.mean == pytest.approx(x.mean(0)) and scorer.scale == pytest.approx(x.std(0))
    a, b = np.zeros((24, 24)), np.zeros(24)
    for doc, stats, label in rows:
        if doc not in kept:
            z = [math.sqrt(2 / 23) * math.cos(sum(np.clip((s - m) / d, -5, 5) * w for s, m, d, w in zip(stats, scorer.mean, scorer.scale, ws)) + c) for ws, c in zip(scorer.w.T, scorer.b)] + [1.0]
            a += np.outer(z, z)
            b += np.array(z) * label
    want = np.linalg.solve(a + 1e-3 * a[-1, -1] / 24 * np.eye(24), b)
    assert scorer.weights == pytest.approx(want, rel=1e-6, abs=1e-8)


def grams(text):
    b = b"\0" * 6 + text.lower().encode() + b"\0" * 6
    return {b[i : i + n] for n in range(3, 7) for i in range(len(b) - n + 1)}


def test_log_count_ratios_by_counting(spark):
    rng = random.Random(6)
    words = ["calm", "river", "stone", "meadow", "lamp", "paper"]
    rows = [(i, " ".join(rng.choices(words, k=8)) + (" vile scum" if i % 4 == 0 else "") + (" filler" * 12_000 if i in (0, 1) else ""), int(i % 4 == 0)) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    found = {r.bucket: (r.pos, r.neg) for r in toxicity.frequencies(spark.createDataFrame([(r[2], r[1]) for r in rows], "label int, text string")).collect()}
    bucket = {}
    for g in set().union(*(grams(r[1]) for r in rows)):
        key = 0
        for c in g:
            key = (key * 0x01000193 + c) & 0xFFFFFFFF
        bucket[g] = ((((key ^ (key >> 15)) * 0x85EBCA6B + len(g)) & 0xFFFFFFFF) >> (32 - toxicity.BITS))
    want = defaultdict(lambda: [0, 0])
    for _, text, label in rows:
        for h in {bucket[g] for g in grams(text)}:
            want[h][1 - label] += 1
    assert found == {h: tuple(v) for h, v in want.items()}  # the two texts of over 80,000 bytes as well
    model = toxicity.fit(docs, labels)
    ratio = lambda h: math.log((want[h][0] + 0.5) / 31) - math.log((want[h][1] + 0.5) / 91)
    chosen = np.flatnonzero(model.slot)
    # every feature chosen is beyond chance, and a plain toxic word's are among them
    assert {bucket[g] for g in (b"vile s", b"scum")} <= set(chosen.tolist())
    assert all(ratio(h) != 0 for h in chosen)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((scores[i] >= 0.7) == bool(label) for i, _, label in rows)


def likelihood(features, labels, w, move):
    """Log likelihood by all paths, and the penalty."""
    total, n = 0.0, 0
    for f, y in zip(features, labels):
        worth = lambda path: sum(sum(w[k] for k in ks) * p for ks, p in zip(f, path)) + sum(move[a][b] for a, b in itertools.pairwise(path))
        total += worth(list(y)) - math.log(sum(math.exp(worth(p)) for p in itertools.product((0, 1), repeat=len(f))))
        n += len(f)
    return total / n - 0.5 * (sum(x * x for x in w) + sum(x * x for r in move for x in r)) / n


def test_field_gradient_by_all_paths():
    rng = np.random.default_rng(7)
    features = [[tuple(rng.choice(quality_rules.N_FEATURES, 3, replace=False).tolist()) for _ in range(n)] for n in (1, 4, 6, 2)]
    labels = [rng.integers(0, 2, len(f)) for f in features]
    one = [np.array(x) for x in quality_rules.train(features, labels, rounds=1)]
    two = [np.array(x) for x in quality_rules.train(features, labels, rounds=2)]
    # a step is twice the speed, the speed is the gradient and 0.8 of the speed before
    first = [x / 2 for x in one]
    second = [(b - a) / 2 - 0.8 * g for a, b, g in zip(one, two, first)]
    for at, grad in (([x * 0 for x in one], first), (one, second)):
        for which in (0, 1):
            for place in np.ndindex(at[which].shape):
                up, down = ([x.copy() for x in at] for _ in range(2))
                up[which][place] += 1e-5
                down[which][place] -= 1e-5
                want = (likelihood(features, labels, *up) - likelihood(features, labels, *down)) / 2e-5
                assert grad[which][place] == pytest.approx(want, abs=1e-6)


def groups(values, links):
    over = {v: v for v in values}

    def top(x):
        while over[x] != x:
            x = over[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        over[b] = a
    return {v: top(v) for v in values}


def test_tree_links_by_all_pairs():
    rng = random.Random(8)
    for _ in range(100):
        seeds = [rng.getrandbits(64) for _ in range(rng.choice([1, 3, 30]))]
        values = set()
        for _ in range(rng.choice([2, 60, 250])):
            v = rng.choice(seeds)
            for _ in range(rng.randint(0, 7)):
                v ^= 1 << rng.randrange(rng.choice([12, 64]))
            values.add(v)
        links = simhash.shard_links(sorted(values))
        assert all((a ^ b).bit_count() <= simhash.RADIUS for a, b in links)
        near = [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= simhash.RADIUS]
        assert groups(values, links) == groups(values, near)
        assert len(links) < len(values)


def test_dense_shard_in_near_linear_time():
    rng = random.Random(9)
    centre, values = rng.getrandbits(64), set()
    while len(values) < 100_000:
        v = centre
        for b in rng.sample(range(64), rng.randint(1, 4)):
            v ^= 1 << b
        values.add(v)
    began = time.time()
    links = simhash.shard_links(sorted(values))
    assert time.time() - began < 60
    assert len(links) == len(values) - 1  # all are one component
