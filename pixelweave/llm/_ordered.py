"""Running sums in a global order, without a task that sees a whole group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweave.llm._common import stage


def running(rows: DataFrame, group: list[str], order: list[str], sums: list[str], name: str) -> DataFrame:
    """``rows`` with ``before_<s>`` for each column s of ``sums``: its sum over the rows of the group that come earlier.

    Rows are dealt by ranges of group and order, so a large group lies in many partitions; each
    partition is summed as a stream and staged. Of every partition its first and last group go to
    the driver (a row for each partition), which finds what a partition takes over from those
    before it. Rows equal in ``group`` and ``order`` stay together: add a column that differs if
    there may be many. Nulls come first and are a group like any other.
    """
    base = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    fields = [*rows.schema.fields, *(T.StructField(f"before_{s}", T.LongType()) for s in sums), T.StructField("_part", T.LongType()), T.StructField("_row", T.LongType())]
    schema = T.StructType(fields)
    names = [f.name for f in fields]

    def run(batches):
        part, row, last, seen = TaskContext.get().partitionId(), 0, None, dict.fromkeys(sums, 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            first = np.zeros(n, np.bool_)
            for g in group:
                first[1:] |= ~_same(batch[g].slice(1), batch[g].slice(0, n - 1))
            key = [batch[g][0].as_py() for g in group]
            first[0] = last is None or key != last
            starts = np.flatnonzero(first)
            of = np.cumsum(first) - 1  # the group that begins at starts[of]; -1: that of the batch before
            new = []
            for s in sums:
                ends = np.cumsum(batch[s].to_numpy(zero_copy_only=False).astype(np.int64))
                before = np.append(0, ends[:-1])
                base = np.where(of < 0, -seen[s], before[starts][np.maximum(of, 0)] if len(starts) else 0)
                new.append(pa.array(before - base, pa.int64()))
                seen[s] = int(ends[-1] - base[-1])
            last = [batch[g][n - 1].as_py() for g in group]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new, pa.array(np.full(n, part), pa.int64()), pa.array(np.arange(row, row + n), pa.int64())], names=names)
            row += n

    kept = stage(base.mapInArrow(run, schema), name)
    after = [(F.col(f"before_{s}") + F.col(s)).alias(f"after_{s}") for s in sums]
    ends = kept.groupBy("_part").agg(F.min_by(F.struct(*group), "_row").alias("first"), F.max_by(F.struct(*group, *after), "_row").alias("last")).orderBy("_part").collect()
    over, carried, key = [], None, None
    for e in ends:
        first, last = tuple(e["first"]), tuple(e["last"])[: len(group)]
        total = [e["last"][f"after_{s}"] for s in sums]
        if carried is not None and first == key:
            over.append((e["_part"], *first, *carried))
            if last == first:  # the partition holds nothing else
                total = [a + b for a, b in zip(carried, total)]
        carried, key = total, last
    types = {f.name: f.dataType for f in rows.schema.fields}
    taken = T.StructType([T.StructField("_p", T.LongType()), *(T.StructField(f"_g{i}", types[g]) for i, g in enumerate(group)), *(T.StructField(f"_over_{s}", T.LongType()) for s in sums)])
    more = F.broadcast(rows.sparkSession.createDataFrame(over, taken))  # a row for each partition at most
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    full = [(F.col(f"before_{s}") + F.coalesce(f"_over_{s}", F.lit(0))).alias(f"before_{s}") for s in sums]
    return kept.join(more, on, "left").select(*rows.columns, *full)


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    equal = pc.fill_null(pc.equal(a, b), False)
    return np.asarray(pc.or_(equal, pc.and_(a.is_null(), b.is_null())))
