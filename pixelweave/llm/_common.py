"""What the corpus operators share: column attachment by Arrow batches, staged tables, folds."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text handed to a kernel at once, in bytes; a longer single text goes alone.
CHUNK_BYTES = 6 << 20

WHITE = b" \t\n\x0b\x0c\r"


def fold(doc_id: str = "doc_id", parts: int = 3) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts, F.lit(0))


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns that an operator is about to add (names compare without case)."""
    new = {n.lower() for n in names}
    return df.select([column(c) for c in df.columns if c.lower() not in new])


def chunks(batch: pa.RecordBatch, by: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most`` bytes in column ``by``, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(by)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths + 16)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def attach(
    df: DataFrame,
    fields: list[T.StructField],
    kernel: Callable[[], Callable[[pa.RecordBatch], list]],
    text: str = "text",
    most: int = CHUNK_BYTES,
) -> DataFrame:
    """``df`` with the new ``fields``, which the kernel computes for slices of Arrow batches.

    ``kernel()`` runs once in each task and returns the function for slices; that gives one
    array or list for each field. An input column that has a new field's name is replaced.
    """
    base = without(df, [f.name for f in fields])
    by = base.columns.index(text)
    out = T.StructType(base.schema.fields + fields)
    types = [_arrow(f.dataType) for f in fields]
    names = [f.name for f in out.fields]

    def run(batches):
        each = kernel()
        for batch in batches:
            for part in chunks(batch, by, most):
                new = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(each(part), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=names)

    return base.mapInArrow(run, out)


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    return {
        T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(),
        T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary(),
    }[type(t)]


def encoded(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text, empty for null."""
    return [x if x is not None else b"" for x in texts.cast(pa.binary()).to_pylist()]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only where that is unset and everything runs on one machine (local tests) a temporary folder is taken instead.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="pixelweave-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", "false").parquet(path)  # mostly hashes and numbers that differ
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the folder's owner clears it
        pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sampled(rows: Column, share: float, seed: int = 7) -> Column:
    """True for about ``share`` of the values of ``rows``, the same ones each time."""
    return F.pmod(F.xxhash64(rows, F.lit(seed)), F.lit(1_000_000)) < int(round(1_000_000 * min(1.0, share)))
