"""Nulls, empty texts and tables, repeated rows, clashing column names, one very long text."""

import pytest
from pyspark.sql import functions as F

from pixelweave.llm import decontaminate, html_text, langid, line_dedup, lm_scoring, packing, quality_model, quality_rules, simhash, toxicity
from pixelweave.llm._common import fold

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ROWS = [(1, "the cat sat\non the mat", "x"), (1, "the cat sat\non the mat", "x"), (2, None, None), (3, "", "x"), (None, "the cat sat", "x"), (4, LONG, "x"), (5, " \n\t\n", "x"), (6, "éÀ ß 漢字\x00 <|endoftext|> it's", "x")]
CLASH = "score lang_pred n_words n_hit kept n_lines n_removed fp label component_id bits text_ words"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("clash") for c in CLASH.split()})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, None, None), (None, 1, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "cat sat on the mat"), (2, None), (None, "the cat"), (3, "")], "item_id long, text string")


OPERATORS = {
    "langid": lambda d, l, b: langid.identify(d, langid.fit(d)),
    "quality": lambda d, l, b: quality_model.score(d, l),
    "lines": lambda d, l, b: line_dedup.dedup_lines(d),
    "toxicity": lambda d, l, b: toxicity.score(d, toxicity.fit(d, l)),
    "packing": lambda d, l, b: packing.pack(d),
    "simhash": lambda d, l, b: simhash.near_duplicates(d),
    "keep_one": lambda d, l, b: simhash.keep_one(d),
    "lm": lambda d, l, b: lm_scoring.score(d, fold(parts=10) != 0),
    "decontaminate": lambda d, l, b: decontaminate.decontaminate(d, b),
    "rules": lambda d, l, b: quality_rules.apply_rules(d, l),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(docs, labels, items, name):
    found = OPERATORS[name](docs, labels, items).collect()
    if name == "keep_one":  # 1 once; 2, 3 and 5 are one group
        assert sorted(str(r.doc_id) for r in found) == ["1", "2", "4", "6", "None"]
    elif name == "packing":
        assert {r.doc_id for r in found} == {r[0] for r in ROWS}
    else:
        assert len(found) == len(ROWS)
    if name == "lines":
        by = {r.doc_id: r.text for r in found}
        assert (by[1], by[2], by[3], by[None]) == ("the cat sat\non the mat", None, "", "")


#: Names that operators use inside, and results in capitals.
INNER = "_text _d _u _gone row gone left doc d u s n x y id _blocks _around _page _items _spans _fp _own hash host page ids piece N_LINES SCORE KEPT FP COMPONENT_ID CONTAMINATED LANG_PRED".split()


@pytest.mark.parametrize("name", ["lines", "toxicity", "langid", "decontaminate", "rules"])
def test_extra_columns_stay(spark, labels, items, name):
    """Extra columns of whatever name are neither lost nor in the way, but those named as a result."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in INNER})
    found = OPERATORS[name](df, labels, items)
    assert found.count() == len(ROWS)
    kept = [c for c in INNER if c in found.columns]
    assert {*INNER} - {*kept} <= {c for c in INNER if c.isupper()} and all(r[c] == "clash" for r in found.select(kept).collect() for c in kept)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(docs, labels, items, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0), items.limit(0)).collect() == []


def test_pages(spark):
    rows = [(1, "http://a.b/c", "<p>One &amp; two</p><nav>menu</nav>"), (2, None, None), (3, "x", ""), (3, "x", ""), (None, "x", "<p>a<p>b<!-- c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))
    found = html_text.extract(pages)
    assert sorted((str(r.page_id), r.text) for r in found.collect()) == [("1", "One & two"), ("2", ""), ("3", ""), ("3", ""), ("None", "a\n\nb")]
    assert html_text.extract(pages.limit(0)).collect() == []
