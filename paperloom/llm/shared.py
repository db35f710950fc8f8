"""Scratch tables in the cluster's shared folder, and Arrow helpers used by the operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: Bytes of an Arrow batch that a Python worker is sent, and the setting that bounds them (its default is 64 MB).
BATCH_BYTES, BATCH_SETTING = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: What this process has stored and not discarded, by session folder.
_stored: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where the session names none, a temporary folder serves a local master (tests), and
    is gone when the process ends; on a cluster that is an error, as each executor would
    write to its own disk.
    """
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError(f"set {SETTING} to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="paperloom-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/paperloom/{what}-{uuid.uuid4().hex}"
    _stored.add(path)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """df as a written table: cuts its lineage, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    _stored.discard(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what was made from them is stored itself."""
    for table in tables:
        _delete(table.sparkSession, table.stored_at)


def discard_all(spark: SparkSession) -> None:
    """Delete every scratch table of this process; for callers that have consumed the operators' results."""
    for path in list(_stored):
        _delete(spark, path)


def reused(df: DataFrame) -> DataFrame:
    """df, kept on the executors' disks while several steps read it; what a lost executor held is computed again.

    The plan is made unlike any other, by a test that the optimiser drops: else Spark would
    answer a later call over the same paths from what an earlier one kept, though the files
    may have changed. What results still read stays kept until spark.catalog.clearCache().
    """
    return df.filter(F.lit(uuid.uuid4().hex) != F.lit("")).persist(StorageLevel.DISK_ONLY)


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files that nothing reads any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def lean(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, so that neither JVM nor worker holds thousands of long texts at once."""
    if int(spark.conf.get(BATCH_SETTING).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def released(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, after which a worker gives freed memory back to the system: workers are reused, and keep the most that any task took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return run


def free(docs: DataFrame, name: str) -> str:
    """A column name that docs lacks, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column's values, without making Python strings."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py()


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
