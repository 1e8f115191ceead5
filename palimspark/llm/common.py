"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space; everything else is part of a word.
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Characters of text that a worker turns into Python objects at a time.
CHUNK_CHARS = 1 << 19
#: Upper bound of entries in a worker's memo tables; a full table is emptied, results don't change.
MEMO_ENTRIES = 80_000
#: Rows of an Arrow batch; whole texts are long, and a batch is in memory on both sides.
BATCH_ROWS = 1_000
#: Memo tables of this process, emptied when a task ends.
memos: list[dict] = []

_own_dirs: list[str] = []
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); an own one only where that is unset."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dirs:
        _own_dirs.append(tempfile.mkdtemp(prefix="palimspark-"))
        atexit.register(shutil.rmtree, _own_dirs[0], True)
    return f"file://{_own_dirs[0]}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds the rows of Arrow batches for what is run inside; the session's setting is as before afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def integer_id(df: DataFrame, column: str) -> Column:
    """The id as a long; TypeError for a column of another kind than integers, whose order or division wouldn't be that of its values."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{column} must be an integer column, not {kind.simpleString()}")
    return F.col(column).cast("long")


def tidy() -> None:
    """Gives a worker's memory back between tasks: workers live on, and a stage without Python may need it."""
    for m in memos:
        m.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: a short lineage that outlives lost executors.

    The folder goes when the session ends, as a result that was returned lazily may still read it.
    """
    return cut_at(df, name)[0]


def cut_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """cut(), and the folder, for delete() once nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path), path


def delete(path: str) -> None:
    """Deletes a folder of cut_at()."""
    _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clear() -> None:
    """Deletes what cut() wrote, if the session is still up; the cluster's own clean-up is for the rest."""
    for path, spark in _written.items():
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with about CHUNK_CHARS bytes of text (one row at least), and their texts (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False) if batch.num_rows else []
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > CHUNK_CHARS:
                yield batch.slice(start, i - start), [t or "" for t in column.slice(start, i - start).to_pylist()]
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start), [t or "" for t in column.slice(start).to_pylist()]
    tidy()


def held_out(column: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves remainder. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def blocks(rows: int, per_block: int) -> int:
    return max(1, -(-rows // per_block))
