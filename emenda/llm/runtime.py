"""Shared folder, written intermediate tables, and packed shuffles."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of packed rows that a task gathers before it hands them on.
FLUSH_BYTES = 8 << 20
BATCH_BYTES = 8 << 20
#: Bytes of stored input that one packed partition stands for, at most.
PART_BYTES = 32 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset (as in
    tests on one machine) a temporary folder that goes with the process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="emenda-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and any executor can be lost.  The
    shuffle files of the write go when it has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() gave, once nothing reads them any more, and has the driver drop the
    plans and broadcasts that went with them."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        spark._jvm.System.gc()


def tune(spark: SparkSession) -> SparkSession:
    """Bounds the bytes of an Arrow batch, so that long texts don't add up in the Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def passed(df: DataFrame, batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """df through a function of Arrow batches that keeps its columns, whatever their names: inside they
    are c0, c1, ..."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(batches, plain.schema).toDF(*df.columns)


def release() -> None:
    """Gives freed memory back to the system: workers are used again by the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def partitions(spark: SparkSession, docs: DataFrame | None = None) -> int:
    """Partitions of a packed shuffle: spark.sql.shuffle.partitions, or more where the files of docs
    are more than so many can hold."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if docs is None:
        return least
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # a plan without files has no size, and says 2 ** 63 - 1 or a multiple of it
    return least if size >= 1 << 60 else max(least, -(-size // PART_BYTES))


class Packer:
    """Gathers numpy columns and yields them as one binary value per partition of the shuffle.

    A row (part, blob) holds all that a task has for a partition, so that a shuffle of many small
    records costs the JVM a few rows.  Rows go by their key without its lowest bits to the partitions
    first, first + 1, ..., first + parts - 1."""

    def __init__(self, parts: int, dtype: np.dtype, lowest: int = 0, first: int = 0):
        self.parts, self.dtype, self.held, self.size = parts, dtype, [], 0
        self.lowest, self.first = np.uint64(lowest), first

    def add(self, key: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key):
            rows = np.empty(len(key), self.dtype)
            rows["key"] = key
            for name, values in columns.items():
                rows[name] = values
            self.held.append(rows)
            self.size += rows.nbytes
        if self.size >= FLUSH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            held, self.held, self.size = self.held, [], 0
            rows = np.concatenate(held)
            del held
            part = part_of(rows["key"] >> self.lowest, self.parts) + np.int32(self.first)
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            blobs = [_encode(rows[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.record_batch([pa.array(part[cuts[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def _encode(rows: np.ndarray) -> bytes:
    """Column by column: repeated values as runs where that is shorter, else byte plane by byte
    plane, which the shuffle's compression likes better than rows."""
    out = [np.uint32(len(rows)).tobytes()]
    for name in rows.dtype.names:
        x = np.ascontiguousarray(rows[name])
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        if len(first) * (x.itemsize + 4) < x.nbytes:
            run = np.diff(np.r_[first, len(x)]).astype(np.uint32)
            out += [np.uint32(len(first)).tobytes(), _planes(x[first]), _planes(run)]
        else:
            out += [np.uint32(0).tobytes(), _planes(x)]
    return b"".join(out)


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _decode(blob: np.ndarray, dtype: np.dtype) -> np.ndarray:
    at = 0

    def take(n: int, kind: np.dtype) -> np.ndarray:
        nonlocal at
        part = blob[at : at + n * kind.itemsize]
        at += len(part)
        return np.ascontiguousarray(part.reshape(kind.itemsize, n).T).view(kind).ravel()

    u4 = np.dtype("<u4")
    rows = np.empty(int(take(1, u4)[0]), dtype)
    for name in dtype.names:
        runs = int(take(1, u4)[0])
        if runs:
            values = take(runs, dtype[name])
            rows[name] = np.repeat(values, take(runs, u4))
        else:
            rows[name] = take(len(rows), dtype[name])
    return rows


def unpack(blobs: pa.ChunkedArray | pa.Array, dtype: np.dtype) -> np.ndarray:
    parts = [_decode(np.frombuffer(b.as_buffer(), np.uint8), dtype) for b in blobs]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
