"""Operators learn from, and keep, all of what they are given."""

import itertools
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelweave.llm import decontaminate, html_text, langid, line_dedup, lm_model, lm_scoring, quality_rules, simhash
from pixelweave.llm._common import fold
from pixelweave.llm._graph import components


def test_lm_learns_long_texts(spark):
    rows = [(0, "zebra quokka " * 2_000), *((i, f"the cat sat on the mat {i}") for i in range(1, 6)), (9, "zebra quokka zebra quokka")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in lm_scoring.score(docs, F.col("doc_id") < 9).collect()}
    assert found[9].score > -12  # ids never seen cost over 4.6 each


def test_lm_counts_all_ids(spark):
    texts = [bytes([1, 0, 2, 0]), bytes([2, 0, 2, 0]), b""] * 3
    table = spark.createDataFrame([(x,) for x in texts], "ids binary").repartition(4)
    group = np.zeros(lm_scoring.VOCABULARY + 1, np.int64)
    group[2], group[-1] = 1, 2
    n = lm_scoring.tallied(table, lambda before, own: group[before] * lm_scoring.VOCABULARY + own, 3 * lm_scoring.VOCABULARY).reshape(3, -1)
    assert {(int(g), int(i)): int(n[g, i]) for g, i in zip(*n.nonzero())} == {(2, 1): 3, (0, 2): 3, (1, lm_scoring.END): 6, (2, 2): 3, (1, 2): 3, (2, lm_scoring.END): 3}


def small_model(rng, vocabulary=60, end=59):
    model = lm_model.CausalModel(vocabulary, end, width=8, hidden=8, single=12, clusters=5)
    texts = [rng.choice(40, rng.integers(0, 120)) for _ in range(50)]
    before, own = lm_scoring.sequences(pa.array([x.astype("<u2").tobytes() for x in texts]))
    before, own = np.where(before == lm_scoring.VOCABULARY, vocabulary, before), np.where(own == lm_scoring.END, end, own)
    head = model.heads(np.bincount(own, minlength=vocabulary))
    row, size = np.append(model.row, lm_model.START), len(head)
    b, o = row[before], row[own]
    cls = model.classes(np.bincount(head[b] * size + o, minlength=(lm_model.HEADS + 1) * size).reshape(-1, size)).astype(int)
    model.shares(np.bincount(cls[b] * size + o, minlength=(model.n_classes + 1) * size).reshape(-1, size), np.bincount(cls[o] * size + b, minlength=model.n_classes * size).reshape(-1, size))
    weights = {k: v + rng.normal(0, 0.5, v.shape).astype(np.float32) for k, v in model.begin().items()}
    return model, weights


@pytest.mark.parametrize("factor", [1, 40])
def test_lm_probabilities_sum_to_one(factor):
    """After any context, seen ids or not, near or far, with weights small or huge."""
    rng = np.random.default_rng(1)
    model, weights = small_model(rng)
    weights["c"] = weights["c"] * factor
    model.freeze(weights, np.ones(len(weights["e"]), bool))
    for n in (0, 1, 5, 31, 32, 33, 70):
        context = rng.choice(59, n)
        texts = [np.append(context, i) for i in range(59)]
        log, begin = model.logs(np.concatenate(texts), np.array([n + 1] * 59))
        ended, _ = model.logs(context, np.array([n]))
        assert np.exp(log[begin + n]).sum() + np.exp(ended[n]) == pytest.approx(1, abs=1e-3)


def test_lm_scores_do_not_hang_on_neighbours():
    rng = np.random.default_rng(2)
    model, weights = small_model(rng)
    model.freeze(weights, np.ones(len(weights["e"]), bool))
    texts = [rng.choice(59, n) for n in (0, 3, 200, 32, 31, 64, 1, 0, 500)]
    lengths = np.array([len(x) for x in texts])
    alone = [model.score(x, np.array([len(x)]))[0] for x in texts]
    assert model.score(np.concatenate(texts), lengths) == pytest.approx(alone, rel=1e-4)
    assert model.score(np.concatenate(texts), lengths, at_once=3) == pytest.approx(alone, rel=1e-4)


def test_lm_attention_by_loops():
    """The score of each id by the formulas of the model, one position at a time."""
    rng = np.random.default_rng(3)
    model, w = small_model(rng)
    counts = model.next.copy()
    model.freeze(w, np.ones(len(w["e"]), bool))
    text = np.append(rng.choice(59, 90), 59)
    x = np.append(lm_model.START, model.row[text[:-1]])
    total = 0.0
    for i, y in enumerate(text):
        block = i // lm_model.BLOCK
        seen = range(max(0, (block - 1) * lm_model.BLOCK), i + 1)
        e = w["e"][x]
        s = np.array([e[i] @ w["q"] @ (e[j] @ w["k"]) / 8**0.5 + w["near"][i % lm_model.BLOCK, j - (block - 1) * lm_model.BLOCK] for j in seen])
        a = np.exp(s - s.max())
        h = e[i] + (a / a.sum()) @ (e[list(seen)] @ w["v"])
        z = h + np.maximum(h @ w["w1"] + w["b1"], 0) @ w["w2"]
        logits = z @ w["c"] + w["c0"] + counts[x[i]]
        before = model.n_classes if i == 0 else model.cls[text[i - 1]]
        total += logits[model.cls[y]] - np.log(np.exp(logits).sum()) + model.after[before, model.row[y]] * (model.cls[y] >= model.single) + model.rest[y]
    assert model.score(text[:-1], np.array([90]))[0] == pytest.approx(total / np.log(10), rel=0.02)


def test_lm_gradient_by_differences():
    """The gradient is the slope of the mean loss, over more positions than are held at once; what is held doesn't grow with the batch."""
    rng = np.random.default_rng(8)
    model, w = small_model(rng)
    block, n, scale = lm_model.BLOCK, 24, 8**-0.5
    x = rng.integers(1, len(w["e"]), (n, 2 * block))
    x[:4, :block] = lm_model.PAD
    y = rng.integers(-1, model.n_classes, (n, block))

    def loss(w):
        e = w["e"][x]
        s = e[:, block:] @ w["q"] @ (e @ w["k"]).transpose(0, 2, 1) * scale + w["near"] + np.where(model.causal < 0, -1e9, 0) + np.where(x == lm_model.PAD, -1e9, 0)[:, None]
        s = np.exp(s - s.max(2, keepdims=True))
        h = e[:, block:] + s / s.sum(2, keepdims=True) @ (e @ w["v"])
        z = h + np.maximum(h @ w["w1"] + w["b1"], 0) @ w["w2"]
        logits = z @ w["c"] + w["c0"] + model.next[x[:, block:]]
        log = logits - np.log(np.exp(logits).sum(2, keepdims=True))
        return -np.take_along_axis(log, np.maximum(y, 0)[..., None], 2)[..., 0][y >= 0].mean()

    held = {}
    g, rows = model._gradient(w, x, y, held)
    assert sum(v.size for v in held.values()) < n * block * model.n_classes
    assert rows.tolist() == np.unique(x).tolist()
    g["e"], own = np.zeros_like(w["e"]), g["e"]
    g["e"][rows] = own
    exact = {k: v.astype(float) for k, v in w.items()}
    for k in w:
        for _ in range(6):
            at = tuple(rng.integers(0, m) for m in w[k].shape)
            if k == "e":
                at = (max(1, at[0]), at[1])
            slopes = []
            for step in (1e-5, -1e-5):
                moved = exact[k].copy()
                moved[at] += step
                slopes.append(loss(exact | {k: moved}))
            assert g[k][at] == pytest.approx((slopes[0] - slopes[1]) / 2e-5, rel=2e-3, abs=2e-6), (k, at)


def test_lm_gain_over_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = lm_scoring.score(docs, fold(parts=10) != 0).filter("not training and n_tokens > 20").toPandas()
    assert (held.score > held.base_score).mean() > 0.75  # of a few hundred documents to learn from
    assert held.score.sum() > held.base_score.sum()


def test_lm_windows_hold_every_id_once():
    rng = np.random.default_rng(4)
    texts = [rng.choice(500, n).astype("<u2") for n in (0, 3, 31, 32, 33, 64, 5_000, 1)]
    raw = [x.tobytes() for x in texts]
    found, n = lm_scoring.windows(raw)
    assert n == len(found) and sorted(x.tobytes() for i in range(3) for x in lm_scoring.windows(raw, i, 3)[0]) == sorted(x.tobytes() for x in found)
    own = found[:, lm_model.BLOCK + 1 :]
    assert own[own != lm_model.NONE].tolist() == [i for x in texts for i in [*x.tolist(), lm_scoring.END]]
    assert (found[:, : lm_model.BLOCK + 1] == lm_model.BEGIN).sum() == sum(1 + (len(x) + 1 > lm_model.BLOCK) for x in texts)


def test_lm_weights_meet_every_block(spark, monkeypatch):
    """Of more blocks than any share or least number of them would hold, every one teaches, in whatever partition it lies."""
    met = spark.sparkContext.accumulator(0)

    class Counting(lm_model.Trainer):
        def learn(self, windows, least=0):
            met.add(len(windows))

    monkeypatch.setattr(lm_scoring, "Trainer", Counting)
    rows = spark.range(4_000).repartition(7).selectExpr("id as doc_id", "unhex(repeat('01000200', 32 * 8)) as ids")
    lm_scoring.train(rows)
    assert met.value == 4_000 * 17


def page(number, url, body):
    return (number, url, f"<html><body>{body}</body></html>")


def extracted(spark, rows):
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_copied_pages_are_no_template(spark):
    rows = [page(i, f"http://a.b/{i}", "<article><div><p>The only story</p></div></article>") for i in range(8)]
    assert set(extracted(spark, rows).values()) == {"The only story"}


def test_template_of_a_large_host(spark):
    promo = "<div><p>Buy our almanac</p></div>"
    rows = [page(i, f"http://a.b/{i}", f"<p>Story {i}</p>{promo if i < 8 else ''}") for i in range(300)]
    assert extracted(spark, rows) == {i: f"Story {i}" for i in range(300)}


def test_names_count_as_a_whole(spark):
    inside = '<article><h2 id="search">Search</h2><section id="search-methods" data-id="search"><div aria-hidden="false" title="hidden">Methods</div></section><p class="notice">Sale</p></article>'
    rows = [page(1, "http://a.b/1", f'<div class="site has-sidebar">{inside}</div>'), page(2, "http://a.c/2", f'<div class="sidebar">Menu{inside}</div>'), page(3, "http://a.d/3", '<div class="no-sidebar"><p>Text</p></div><div class="main sidebar">Menu</div>')]
    assert extracted(spark, rows) == {1: "Search\n\nMethods", 2: "Search\n\nMethods", 3: "Text"}


def test_articles_stay_and_furniture_goes(spark):
    bodies = {
        '<article class="post" data-comment-count="12"><p>a</p></article>': "a",
        '<article class="post allow-comments"><p>a</p></article><p>next to it</p>': "a",
        '<p>One</p><svg viewBox="0 0 1 1"/><p>Two</p><math/><p>Three</p>': "One\n\nTwo\n\nThree",
        '<article><div class="search"><p>real</p></div><p class="related">too</p><section class="comments"><p>c</p></section><article class="comment"><p>d</p></article></article>': "real\n\ntoo",
    }
    bodies |= {f"<div {n}><p>gone</p></div><p>text</p>": "text" for n in ('class="post-comments"', 'id="comments-section"', 'class="main-navigation"', 'class="advert-box"', 'id="sidebar-right"', 'class="sidebar__inner"')}
    bodies |= {f"<div {n}><p>text</p></div>": "text" for n in ('class="has-sidebar"', 'class="content-sidebar-wrap"', 'class="no-sidebar content"', 'id="page-content"')}
    rows = [page(i, f"http://host{i}.x/", b) for i, b in enumerate(bodies)]
    assert extracted(spark, rows) == dict(enumerate(bodies.values()))


def test_deep_pages_take_little_time(spark):
    deep = 20_000
    for body in ("<div>" * deep + "text", "<div>a" * deep, "<div>" * deep + "</p>" * deep + "text", "<article>" * deep + "text"):
        began = time.process_time()
        assert html_text.parsed(body).blocks
        assert time.process_time() - began < 2
    (r,) = html_text.extract(spark.createDataFrame([(1, None, "<div>a" * 3000, "clash", "clash")], "page_id long, url string, html string, row string, BLOCKS string")).collect()
    assert r.text == "\n\n".join("a" * 3000) and (r.row, r.BLOCKS) == ("clash", "clash")


def test_no_language_drops_out(spark):
    rows = [("en", f"the cat sat on the mat with number {x}") for x in "abcdefghij"]
    rows += [("fi", "kissa istui matolla ja nukkui")] * 3_000 + [("de", "die katze sitzt auf der matte und " * 700)]
    rows += [(f"x{i}", " ".join(chr(1000 + 2 * i + j) * 3 for j in range(2))) for i in range(250)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert set(model.languages) == {r[0] for r in rows}
    docs = spark.createDataFrame([("kissa nukkui",), ("die matte",), ("the mat",)], "text string")
    assert {r.text: r.lang_pred for r in langid.identify(docs, model).collect()} == {"kissa nukkui": "fi", "die matte": "de", "the mat": "en"}


def test_attributes_as_html_parts_them(spark):
    rows = [
        page(1, "http://a.b/1", "<p>One <a title=it's>link</a> para.</p><p>We don't lose this</p><p>end</p>"),
        page(2, "http://a.c/1", '<p>Two<img alt="5" tall"> three</p><p title="a > b" class=\'x\'>four</p>'),
        page(3, "http://a.d/1", "<p a='>five' =b c= d>six</p><p/>seven<p e=\"open>eight</p><p>nine</p>"),
    ]
    found = extracted(spark, rows)
    assert found[1] == "One link para.\n\nWe don't lose this\n\nend"
    assert found[2] == "Two three\n\nfour"
    assert found[3].startswith("six\n\nseven")


def test_template_without_telling_names(spark):
    """Tags and classes say nothing here: only the counts tell template from text."""
    top, side = "<div class=x1><div>Our paper</div><ul><li>World<li>Sport</ul></div>", "<section class=x2><p>Most read today</p></section>"
    rows = [page(i, f"http://a.b/{i}", f"{top}<div class=x3><h1>Title {i}</h1><p>Story {i}</p></div>{side}") for i in range(40)]
    rows += [page(100 + i, f"http://c{i}.d/", f"{top}<div class=x3><p>Story {i}</p></div>{side}") for i in range(3)]
    found = extracted(spark, rows)
    assert all(found[i] == f"Title {i}\n\nStory {i}" for i in range(40))
    assert all("World" in found[100 + i] and "Most read today" in found[100 + i] for i in range(3))


def brute_lines(docs, threshold):
    seen, left = [], {}
    for d, t in sorted(docs):
        kept = []
        for x in t.split("\n"):
            w = frozenset(x.split())
            if not (w and any(len(w & o) >= threshold * len(w | o) - 1e-9 for o in seen)):
                kept.append(x)
            if w:
                seen.append(w)
        left[d] = "\n".join(kept)
    return left


@pytest.mark.parametrize("threshold", [0.34, 0.5, 0.6, 0.75, 0.8, 0.9, 1.0])
def test_line_dedup_at_any_threshold(spark, threshold):
    rng = np.random.default_rng(4)
    docs = [(i, "\n".join(" ".join(f"w{x}" for x in np.minimum(rng.zipf(1.6, rng.integers(0, 7)), 12)) for _ in range(4))) for i in range(40)]
    found = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), threshold=threshold)
    assert {r.doc_id: r.text for r in found.collect()} == brute_lines(docs, threshold)


def test_word_hashes_in_small_pieces():
    """Hashes by one byte after the other, words longer than a piece too."""
    rng = np.random.default_rng(6)
    for text in (b"", b" \n", bytes(rng.choice([9, 11, 32, 10, 97, 200, 255, 0, 31], 3_000).astype(np.uint8)), b"a " + b"xy" * (line_dedup.REACH >> 1) + b"z\nb xy"):
        found = list(zip(*(x.tolist() for x in line_dedup.words(text))))
        plain = []
        for i, line in enumerate(text.split(b"\n")):
            for w in line.split():
                h = sum((x + 1) * pow(line_dedup.BASE, k % line_dedup.REACH + 1, 1 << 64) for k, x in enumerate(w)) & (1 << 64) - 1
                plain.append((int(line_dedup.mixed(np.array([h], np.uint64), 0xBF58476D1CE4E5B9)[0]), i))
        assert found == plain


def test_word_hashes_take_less_than_tables():
    """Words are hashed in clearly less time than looking their bytes up and summing them word by word takes."""
    rng = np.random.default_rng(7)
    text = bytes(np.where(rng.random(1 << 19) < 0.16, 32, rng.integers(97, 123, 1 << 19)).astype(np.uint8))
    space = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
    values = np.where(space, 0, np.arange(1, 257)).astype(np.uint64)

    def by_tables():
        for at in range(0, len(text), line_dedup.REACH):
            b = np.frombuffer(text[at : at + line_dedup.REACH], np.uint8)
            white = space[b]
            first, last = ~white, ~white
            first[1:] &= white[:-1]
            last[:-1] &= white[1:]
            starts = np.flatnonzero(first)
            line_dedup.mixed(np.add.reduceat(values[b] * line_dedup.POWERS[: len(b)], starts) * line_dedup.INVERSES[starts], 0xBF58476D1CE4E5B9)
            np.flatnonzero(last)

    def least(f):
        took = []
        for _ in range(15):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    assert least(lambda: line_dedup.spans(text)) < 0.85 * least(by_tables)


def test_decontamination_in_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole, cut = (sorted(map(tuple, decontaminate.decontaminate(docs, items, most_words=n).drop("text").collect())) for n in (10**6, 300))
    assert whole == cut
    assert sum(r[-1] for r in whole) > 0


def test_one_of_each_group_stays(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "red green blue white black grey")
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b), (9, c), (9, c)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == [(1, a), (5, b), (9, c)]


def test_hot_fingerprint(spark):
    docs = spark.createDataFrame([(i, "the same words in all of them" if i % 2 else f"text number {i} of many others {i * 7}") for i in range(4_000)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(found) == 4_000
    assert {found[i] for i in range(1, 4_000, 2)} == {1}


def test_components_of_a_long_chain(spark):
    edges = spark.range(3_000).selectExpr("id as a", "id + 1 as b")
    assert {tuple(r) for r in components(edges).select("component").distinct().collect()} == {(0,)}
    with pytest.raises(RuntimeError):
        components(edges, rounds=2)


def rule_documents():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(3, 9)))
    good = lambda: " ".join(word() for _ in range(14)).capitalize() + "."
    bad = lambda: " ".join(word() + str(rng.choice(["###", "", "%%%"])) for _ in range(14))
    rows = [(i, "\n".join((bad if i % 2 and j < 6 else good)() for j in range(8)), int(not i % 2)) for i in range(120)]
    return rows


def test_field_learns_from_labels_of_documents(spark):
    """Lines have no labels; bad documents hold good lines too."""
    rows = rule_documents()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 80], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality_rules.apply_rules(docs, labels).collect()}
    assert all(found[d].kept == bool(good) for d, _, good in rows)
    assert np.mean([found[d].content_words for d, _, good in rows if not good]) == pytest.approx(28, abs=10)  # the two good lines of eight


def test_neighbours_settle_a_line():
    """A line that says nothing by itself goes with those around it, which a rule on lines can't tell."""
    emit, move = quality_rules.train([[(0, 1)] * 3 + [(0,)] + [(0, 1)] * 3, [(0, 2)] * 3 + [(0,)] + [(0, 2)] * 3] * 20, [np.zeros(7, int), np.ones(7, int)] * 20)
    assert quality_rules.viterbi([(0, 1), (0,), (0, 1)], emit, move) == [0, 0, 0]
    assert quality_rules.viterbi([(0, 2), (0,), (0, 2)], emit, move) == [1, 1, 1]


def test_viterbi_by_all_paths():
    rng = np.random.default_rng(6)
    for _ in range(50):
        emit, move = rng.normal(size=quality_rules.N_FEATURES).tolist(), rng.normal(size=(2, 2)).tolist()
        features = [tuple(np.flatnonzero(rng.random(quality_rules.N_FEATURES) < 0.4).tolist()) for _ in range(rng.integers(1, 9))]

        def value(path):
            return sum(emit[k] for y, f in zip(path, features) if y for k in f) + sum(move[a][b] for a, b in zip(path, path[1:]))

        assert value(quality_rules.viterbi(features, emit, move)) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=len(features)))))


def test_held_out_quality(spark):
    """Labels that the field didn't see: nearly all good documents stay, nearly all bad ones go, more than by the base rules."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality is not null")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = quality_rules.fit(docs, labels.filter(fold(parts=3) != 1))
    held = quality_rules.apply_rules(docs.join(labels.filter(fold(parts=3) == 1), "doc_id", "left_semi"), weights=model).drop("text").join(labels, "doc_id").toPandas()
    bad, good = held[held.quality == 0], held[(held.quality == 1) & ~held.base_failed]
    assert good.kept.mean() > 0.98
    assert bad.kept.mean() < 0.05
    assert bad.base_failed.mean() < 0.7
