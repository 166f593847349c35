"""Edit logs against a plain replay; bursts of inputs in batch, on a stream, and over a restart."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pixelweave.operators import edits
from pixelweave.plans import queries

SF = "/root/testdata/sf0.01"


def plain(rows, steps):
    """Every state kept in one list with a pointer, and cut where a new edit is made."""
    history, at, done = [[]], 0, 0
    for action, place, tie in rows:
        now = history[at]
        if action == "undo":
            ok = at > 0
            at -= ok
        elif action == "redo":
            ok = at + 1 < len(history)
            at += ok
        elif action == "add" or (action in ("move", "delete") and place is not None and 0 <= place < len(now)):
            new = list(now)
            if action == "add":
                new.append(tie)
            elif action == "move":
                new[place] = tie
            else:
                del new[place]
            history, ok = [*history[: at + 1], new], True
            at += 1
            while at > steps:
                history.pop(0)
                at -= 1
        else:
            ok = False
        done += ok
    ties = history[at]
    text = "\n".join(" ".join("-" if v is None else f"{v:.6f}" for v in t) for t in ties)
    return len(ties), hashlib.sha256(text.encode()).hexdigest(), done, at, len(history) - 1 - at


@pytest.mark.parametrize("steps", [60, 3])
def test_replay(spark, steps):
    log = queries.edit_log(spark, SF)
    by = {}
    for r in sorted(log.collect(), key=lambda r: (r.at, r.seq)):
        by.setdefault(r.drawing, []).append((r.action, r.place, tuple(r[c] for c in edits.ENDS)))
    found = {r.drawing: tuple(r)[1:6] for r in edits.replay(log.orderBy(F.rand(3)), steps).collect()}
    assert found == {k: plain(rows, steps) for k, rows in by.items()} and sum(v[0] for v in found.values()) > 300
    if steps == 60:
        assert {r.drawing: tuple(r)[1:] for r in queries.edit_replay(spark, SF).collect()} == found


def test_replay_awkward(spark):
    rows = [(1, None, 2, "add", None, 1.0), (1, None, 1, "delete", 0, None), (1, None, 3, "add", 0, None), (1, None, 3, "add", 0, None), (None, None, None, None, None, None), (2, None, 1, "undo", None, None), (2, None, 2, "move", 7, 1.0), (2, None, 3, "paint", 0, 1.0)]
    df = spark.createDataFrame(rows, "drawing long, at timestamp, seq long, action string, place int, x1 double").withColumns({c: F.lit(0.0) for c in edits.ENDS[1:]}).withColumn("extra", F.lit("clash"))
    found = {r.drawing: (r.n_ties, r.done, r.undoable, r.redoable) for r in edits.replay(df).collect()}
    assert found == {1: (3, 3, 3, 0), 2: (0, 0, 0, 0), None: (0, 0, 0, 0)}
    assert edits.replay(df.limit(0)).collect() == []


def test_pause(spark):
    rows = [("a", "2024-01-01 00:00:00.000", 1), ("a", "2024-01-01 00:00:00.100", 2), ("a", "2024-01-01 00:00:00.205", 3), ("a", "2024-01-01 00:00:00.400", 4), ("a", "2024-01-01 00:00:00.400", 5), ("b", "2024-01-01 00:00:00.050", 6), (None, "2024-01-01 00:00:00.050", 7), ("b", None, 8)]
    df = spark.createDataFrame(rows, "control string, at string, value int").withColumn("at", F.col("at").cast("timestamp"))
    assert sorted((str(r.control), r.inputs, r["last"]["value"]) for r in edits.settled(df).collect()) == [("None", 1, 7), ("a", 2, 5), ("a", 3, 3), ("b", 1, 6)]


def test_stream_over_a_restart(spark, tmp_path):
    """Files that come between two runs of one stream: bursts reach over them, and none comes twice."""
    events = queries.inputs(spark.read.parquet(f"{SF}/events.parquet")).orderBy("at").toPandas()
    random.seed(1)
    parts = [events.iloc[:4000], events.iloc[4000:7000], events.iloc[7000:]]
    def add(i):
        spark.createDataFrame(parts[i].sample(frac=1, random_state=i)).coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    def run():
        stream = edits.settled(spark.readStream.schema("control long, at timestamp, seq long, value double").option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), "6 hours")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()
    add(0)
    first = run()
    add(1)
    add(2)
    assert run() > first > 0
    key = lambda df: sorted((r.control, r.begun, r.due, r.inputs, r["last"]["seq"]) for r in df.collect())
    whole = edits.settled(spark.createDataFrame(events), "6 hours")
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(whole.filter(F.col("due") <= F.date_trunc("millisecond", F.lit(events["at"].max()))))
