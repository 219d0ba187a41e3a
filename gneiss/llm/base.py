"""Shared plumbing: durable intermediate tables, Arrow batch slicing, column selection."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once by the vectorised scans; one longer text makes a slice of its own.
SLICE_BYTES = 1_000_000
#: Rows of an Arrow batch sent to a Python worker, for sessions that keep Spark's default of 10000: a
#: batch is bounded in rows only, and rows are whole texts.
BATCH_ROWS = 500
#: A table is broadcast only if it was counted to take at most so many bytes.
BROADCAST_BYTES = 48_000_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SWEEP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _return_large_arrays() -> None:
    """Workers are kept between tasks: arrays of eight megabytes and more go back to the system at once
    when they are freed, instead of staying in the heap (glibc only)."""
    try:
        ctypes.CDLL("libc.so.6").mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD, fixed
    except (OSError, AttributeError):
        pass


_return_large_arrays()


def scratch(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir of the session, which driver and
    executors share; only where that is unset (local tests) a temporary folder is made and set."""
    sc = spark.sparkContext
    there = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="gneiss-")
        atexit.register(shutil.rmtree, there, ignore_errors=True)
        sc.setCheckpointDir(f"file://{there}")
        there = sc.getCheckpointDir()
    return there


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back, so a lost
    executor costs a re-read and not a recomputation.  The files go when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/gneiss-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what durable() wrote for these tables, which nothing reads any more."""
    for table in tables:
        path = table._written_to
        jvm = table.sparkSession._jvm
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@contextmanager
def swept(spark: SparkSession):
    """Within it, the shuffle files of a query go when the query ends, and not when the driver's JVM
    happens to collect its plan.  Tables made within should be durable."""
    before = spark.conf.get(_SWEEP_SETTING, "false")
    spark.conf.set(_SWEEP_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(_SWEEP_SETTING, before)


def if_small(table: DataFrame, bound: int = BROADCAST_BYTES) -> DataFrame:
    """table, marked to be broadcast if its rows, as counted, take at most `bound` bytes: eight for each
    number, and the bytes of strings and binaries.  Its plan should be a read of a durable table."""
    size: Column = F.lit(16)
    for f in table.schema.fields:
        text = f.dataType.typeName() in ("string", "binary")
        size = size + (F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 16 if text else F.lit(8))
    return F.broadcast(table) if (table.agg(F.sum(size.cast("long"))).first()[0] or 0) <= bound else table


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under internal names: other columns of df, whatever they are called,
    cannot clash with what an operator adds.  Sees to it that the session bounds its Arrow batches."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING) == "10000":
        conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus (null for a null id)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds about limit bytes of text at most (or one row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(size, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a column, null as empty."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base modulo 2^64, and of its inverse."""
    if not _powers or len(_powers[0]) <= n:
        base = 0x9E3779B97F4A7C15
        size = max(n + 1, SLICE_BYTES + 1)
        _powers[:] = [
            np.cumprod(np.where(np.arange(size) > 0, np.uint64(b), np.uint64(1)), dtype=np.uint64)
            for b in (base, pow(base, -1, 2**64))
        ]
    return _powers[0], _powers[1]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] for many spans, from one prefix sum.  values: uint64, mixed."""
    up, down = powers(len(values))
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return splitmix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
