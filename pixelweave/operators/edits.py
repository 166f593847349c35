"""Edits of ties by hand: a log replayed in order, with undo and redo; and inputs of which the last of a burst counts."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Steps that can be undone, and the pause after which an input counts.
STEPS = 60
PAUSE = "110 milliseconds"
ENDS = ("x1", "y1", "x2", "y2", "width")


class Drawing:
    """The ties of one drawing, and the states that undo and redo lead to (the oldest go beyond ``steps``)."""

    def __init__(self, steps: int = STEPS) -> None:
        self.steps, self.ties, self.before, self.after, self.done = steps, (), [], [], 0

    def edit(self, action: str | None, place: int | None, tie: tuple) -> None:
        """``add`` a tie at the end, ``move`` or ``delete`` the one at a place, ``undo``, ``redo``; what can't be done changes nothing."""
        n = len(self.ties)
        if action in ("undo", "redo"):
            take, give = (self.before, self.after) if action == "undo" else (self.after, self.before)
            if not take:
                return
            give.append(self.ties)
            self.ties = take.pop()
        elif action == "add" or (action in ("move", "delete") and place is not None and 0 <= place < n):
            self.before = [*self.before, self.ties][-self.steps :]
            self.after = []
            at = n if action == "add" else place
            self.ties = self.ties[:at] + (() if action == "delete" else (tie,)) + self.ties[at + 1 :]
        else:
            return
        self.done += 1

    def row(self, key) -> tuple:
        text = "\n".join(" ".join("-" if v is None else f"{v:.6f}" for v in t) for t in self.ties)
        return (key, len(self.ties), hashlib.sha256(text.encode()).hexdigest(), self.done, len(self.before), len(self.after), [dict(zip(ENDS, t)) for t in self.ties])


def replay(log: DataFrame, steps: int = STEPS) -> DataFrame:
    """The state of each drawing after its log(drawing, at, seq, action, place, x1, y1, x2, y2, width).

    Edits count in the order of ``at``, then ``seq``, then action, place and ends, whenever they came in;
    nulls come first; a row that comes twice counts twice. Columns: drawing, n_ties, ties_sha256, done
    (edits that changed something), undoable, redoable, ``ties``. One task reads a drawing's log as a
    sorted stream and holds its ties and ``steps`` earlier states.
    """
    order = ["drawing", "at", "seq", "action", "place", *ENDS]
    rows = log.select(*order).repartition("drawing").sortWithinPartitions(*order)
    kind = log.schema["drawing"]
    tie = T.StructType([T.StructField(c, T.DoubleType()) for c in ENDS])
    schema = T.StructType([kind, T.StructField("n_ties", T.LongType()), T.StructField("ties_sha256", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("done", "undoable", "redoable")), T.StructField("ties", T.ArrayType(tie))])
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([(c, pa.float64()) for c in ENDS]))]

    def run(batches):
        now, key, arrow = None, None, pa.int64()
        for batch in batches:
            arrow, done = batch["drawing"].type, []
            for own, action, place, *ends in zip(*(batch[c].to_pylist() for c in ("drawing", "action", "place", *ENDS))):
                if now is None or own != key:
                    if now is not None:
                        done.append(now.row(key))
                    now, key = Drawing(steps), own
                now.edit(action, place, tuple(ends))
            if done:
                yield batch_of(done, arrow)
        if now is not None:
            yield batch_of([now.row(key)], arrow)

    def batch_of(done: list[tuple], arrow: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), [arrow, *types])], names=schema.names)

    return rows.mapInArrow(run, schema)


def settled(inputs: DataFrame, pause: str = PAUSE, late: str = "0 seconds") -> DataFrame:
    """Of inputs(control, at, value…), batch or stream, the last of each burst: a run of inputs of a control less than ``pause`` apart.

    Columns: control, begun, due (when the pause was over), inputs (how many), and ``last``, the latest
    input as a struct (of equal times the greatest). The others were superseded. On a stream inputs up
    to ``late`` out of order are waited for, later ones are dropped, and a burst comes out once no
    input can join it any more.
    """
    kept = F.struct("at", *[c for c in inputs.columns if c not in ("control", "at")])
    rows = inputs.filter("at is not null").withColumn("input", kept).withWatermark("at", late)
    bursts = rows.groupBy("control", F.session_window("at", pause).alias("burst")).agg(F.count("*").alias("inputs"), F.max("input").alias("last"), F.min("at").alias("begun"), F.max("at").alias("end"))
    # not the window's own ends: Spark pushes filters on these below the aggregate, where bursts are not whole yet
    return bursts.select("control", "begun", (F.col("end") + F.expr(f"interval {pause}")).alias("due"), "inputs", "last")
