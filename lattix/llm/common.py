"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Fixed value: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of one call of a Python function at most, and bytes of text after which a smaller lot ends.
LOT_ROWS, LOT_BYTES = 512, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.  A temporary one serves only where that is unset and all
    of Spark runs on this machine; elsewhere executors would write where nobody else can read."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = sc.getConf().get("spark.checkpoint.dir")
        if not configured and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lattix-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table with a reliable checkpoint, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of megabytes are measured one by one, as a page is compressed, and a row group is read, in one piece.
GROUPS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def stored(df: DataFrame, name: str, *, large_rows: bool = False) -> DataFrame:
    """Write a table to the shared folder as Parquet and read it back: column pruning and sizes stay known."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.options(**(GROUPS if large_rows else {})).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def remove(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; others are left alone."""
    for t in tables:
        if path := getattr(t, "_stored_at", None):
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def lots(column: pa.Array, rows: int = LOT_ROWS, size: int = LOT_BYTES) -> Iterator[tuple[int, list]]:
    """A text column as (start, values) lots of bounded rows and bytes, so that few texts are Python objects at a time; a
    text that is larger than a lot is one by itself."""
    start, held, n = 0, [], 0
    for i, x in enumerate(column):
        held.append(x.as_py())
        n += len(held[-1] or "")
        if len(held) >= rows or n >= size:
            yield start, held
            start, held, n = i + 1, [], 0
    if held:
        yield start, held


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int, size: int | None = None) -> Iterator[None]:
    """Arrow batches of at most so many rows, and bytes after which a smaller one ends, while a table is written; the
    session's own settings come back after it."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k, v in keys.items() if v is not None}
    for k in before:
        spark.conf.set(k, str(keys[k]))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def bounded_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """For applications: the session sends texts to Python in batches of at most so many rows.  Operators that return a plan
    can't set this for the time when it runs; they work with any batches, of which larger ones take more memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def release_memory() -> None:
    """Give what a Python worker has freed back to the system: workers live on between stages."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_table(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A small table of the driver's own values.  From rows, Spark would make it by Python workers on the executors, of
    another kind than those of the operators, so that either kind lives on there."""
    names = T.StructType.fromDDL(schema)
    arrays = [pa.array(columns[f.name], to_arrow_type(f.dataType)) for f in names]
    return spark.createDataFrame(pa.table(arrays, names.names), names)


def fold_of(column: str, folds: int):
    """The fold of an id: crc32 of its decimal text, modulo ``folds``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(folds)


def lower_ascii(column):
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
