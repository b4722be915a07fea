"""What the operators share: table access, the shared work folder, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space as the word contracts mean it: blank and the bytes 09 to 0D.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"

#: Rows that a kernel works on at a time; bounds a Python worker's memory.
SLICE_ROWS = 512

#: Bytes of text that a kernel works on at a time, but for one longer row.
SLICE_BYTES = 4 << 20

#: Whether Spark deletes a query's shuffle files as it ends; else they stay until the
#: driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset in a local
    session, as in tests, a folder of this machine is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quirelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries begun inside go when those end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and
    an executor that is lost takes nothing of it along. What was shuffled for it is
    deleted at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    with _own_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _folders[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables, as ``written`` gave them, that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(_folders.pop(table))
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def map_rows(
    df: DataFrame,
    kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    return df.mapInArrow(kernel, schema)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut to SLICE_ROWS rows and about SLICE_BYTES bytes of ``text``."""
    for batch in batches:
        sizes = batch.column(text).nbytes
        rows = SLICE_ROWS
        if batch.num_rows and sizes > SLICE_BYTES:
            rows = max(1, min(rows, int(batch.num_rows * SLICE_BYTES / sizes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]
