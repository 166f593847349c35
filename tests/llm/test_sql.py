"""The corpus queries with SQL give its rows, and so do their operators on awkward rows."""

import duckdb
import pandas as pd
import pytest

from pixelweave.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def same(ours: pd.DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    theirs = con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    ours, theirs = (x.convert_dtypes() for x in (ours, theirs))  # integers stay such beside nulls
    a, b = (sorted(map(repr, map(tuple, x[sorted(x.columns)].astype(object).where(x.notna(), None).values.tolist()))) for x in (ours, theirs))
    assert a == b
    return len(a)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_tables(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert same(QUERIES[name](spark, SF).toPandas(), con, ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_awkward_rows(spark, name, tmp_path):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    texts = [None, "", "\n\n", f"Start {passage.upper()} end", f"x {passage} y\n{passage}, {passage}", "Short item", "a b c d e\na b c d e f\n a  b c d e \n\nb", "\u00c9t\u00e9 caf\u00e9\nA B c d e", "b\nb b\tb"]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "source": ["web", None, ""] * 3, "lang": [None, "en", "\u00e9", "en", "", "zz", "en", "fr", "en"], "n_chars": pd.array([None, 0, 2] * 3, "Int64")})
    items = pd.DataFrame({"item_id": ["q10", "q9", None, "q2", "q1", "q3"], "text": [passage, passage + " more", "short ITEM", "", None, "\u00c9t\u00e9 caf\u00e9"]})
    turns = pd.DataFrame({"conv_id": pd.array([1, 1, 1, 2, None, 3], "Int64"), "turn": pd.array([0, 1, 1, None, 0, 0], "Int64"), "role": ["user", "assistant", "assistant", None, "assistant", "a\\\nb<|"], "text": ["<|im_end|>", "b<\\|", "a", None, "", "x\ny"]})
    con = duckdb.connect()
    for t, x in (("documents", docs), ("benchmark", items), ("conversations", turns)):
        x.to_parquet(tmp_path / f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert same(QUERIES[name](spark, str(tmp_path)).toPandas(), con, ORACLES[name]) == (5 if name.startswith("op13") else len(texts))
